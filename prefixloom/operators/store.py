"""What a store does with a batch of requests: gates, first writers, checks of identities and the log entries that follow, composed.

Every operator takes tables and gives a table with an outcome a request; what the store holds afterwards, and what it announces, are filters of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.functions import keys
from prefixloom.operators import catalog, integrity
from prefixloom.operators.numbering import numbered

MEMORY, DISK = 1, 2


def ingested(requests: DataFrame, stored: DataFrame, arrival: str) -> DataFrame:
    """requests (block_id, seq, length, checksum, payload) with `outcome`: why one is refused, or stored, duplicate or conflict.

    A block that is stored, or that an earlier valid request stores, is a duplicate if length and checksum agree, else a conflict.
    """
    bad = integrity.ingest_problem(F.col("block_id"), F.col("seq"), F.col("length"), F.col("payload"), F.col("checksum"))
    x = requests.withColumn("__bad", bad)
    held = stored.groupBy("block_id").agg(F.min(F.struct("length", "checksum")).alias("__held"))
    own = F.struct("length", "checksum")
    # refused requests are no writers: they come after all valid ones
    w = Window.partitionBy("block_id").orderBy(F.col("__bad").isNotNull(), arrival)
    x = x.join(held, "block_id", "left").withColumns({"__first": F.first(own).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "__n": F.row_number().over(w)})
    lead = F.coalesce("__held", "__first")
    outcome = F.when(F.col("__bad").isNotNull(), F.col("__bad")).when(F.col("__held").isNull() & (F.col("__n") == 1), "stored").when(own.eqNullSafe(lead), "duplicate").otherwise("conflict")
    return x.withColumn("outcome", outcome).drop("__bad", "__held", "__first", "__n")


def announcements(blocks: DataFrame, node: str, tiers: tuple[int, ...] = (MEMORY,), kind: int = catalog.UPSERT) -> DataFrame:
    """(block_id, node_id, tier, kind, length, checksum) of blocks, an entry a tier."""
    return blocks.select("block_id", F.lit(node).alias("node_id"), F.explode(F.array(*[F.lit(t) for t in tiers])).alias("tier"), F.lit(kind).alias("kind"), "length", "checksum")


def appended(log: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """events with the versions at which they go to the log: from its clock on, in this order."""
    x = numbered(events, order, "__k").crossJoin(F.broadcast(catalog.clock(log).withColumnRenamed("version", "__clock")))
    return x.withColumn("version", F.col("__clock") + F.col("__k")).drop("__clock", "__k")


def deleted(requests: DataFrame, memory: DataFrame, disk: DataFrame, pinned: DataFrame) -> DataFrame:
    """requests (block_id) with (outcome, from_memory, from_disk): zero id, busy where a lease pins the block, deleted, or absent.

    Of a block asked for twice, both requests have the outcome of the first.
    """
    has = lambda t, c: t.select("block_id").distinct().withColumn(c, F.lit(True))
    x = requests.join(has(memory, "__m"), "block_id", "left").join(has(disk, "__d"), "block_id", "left").join(has(pinned, "__p"), "block_id", "left")
    outcome = F.when(F.coalesce("block_id", F.lit(0)) == 0, "zero id").when(F.col("__p"), "busy").when(F.col("__m") | F.col("__d"), "deleted").otherwise("absent")
    x = x.withColumn("outcome", F.coalesce(outcome, F.lit("absent")))
    gone = F.col("outcome") == "deleted"
    return x.withColumns({"from_memory": gone & F.coalesce("__m", F.lit(False)), "from_disk": gone & F.coalesce("__d", F.lit(False))}).drop("__m", "__d", "__p")


def deletions(outcomes: DataFrame, node: str) -> DataFrame:
    """The log's deletes of blocks that went: (block_id, node_id, tier, kind)."""
    tiers = F.concat(F.when(F.col("from_memory"), F.array(F.lit(MEMORY))).otherwise(F.array().cast("array<int>")), F.when(F.col("from_disk"), F.array(F.lit(DISK))).otherwise(F.array().cast("array<int>")))
    gone = outcomes.select("block_id", "from_memory", "from_disk").distinct()
    return gone.select("block_id", F.lit(node).alias("node_id"), F.explode(tiers).alias("tier"), F.lit(catalog.DELETE).alias("kind"))


def committed(commits: DataFrame, blocks: DataFrame, index: DataFrame, domain: str = keys.DOMAIN) -> DataFrame:
    """commits (scope_digest, prefix_digest, token_count, object_id, block_id, length, checksum) with `outcome`.

    digest mismatch and block id mismatch: the identity computed anew isn't the one supplied; not found and metadata mismatch: of
    blocks (block_id, length, checksum); conflict: index (object_id, block_id, length, checksum) binds the object otherwise; same: it
    is bound so already; else committed.
    """
    object_ = keys.object_id(F.col("scope_digest"), F.col("prefix_digest"), F.col("token_count"), domain)
    b = blocks.groupBy("block_id").agg(F.min(F.struct(F.col("length"), F.col("checksum"))).alias("__b"))
    i = index.groupBy("object_id").agg(F.min(F.struct(F.col("block_id"), F.col("length"), F.col("checksum"))).alias("__i"))
    x = commits.withColumn("__object", object_).join(b, "block_id", "left").join(i, "object_id", "left")
    outcome = (
        F.when(~F.col("__object").eqNullSafe(F.col("object_id")), "digest mismatch")
        .when(~keys.block_id(F.col("__object")).eqNullSafe(F.col("block_id").cast(keys.U64)), "block id mismatch")
        .when(F.col("__b").isNull(), "not found")
        .when(~F.struct("length", "checksum").eqNullSafe(F.col("__b")), "metadata mismatch")
        .when(F.col("__i").isNotNull() & ~F.struct("block_id", "length", "checksum").eqNullSafe(F.col("__i")), "conflict")
        .when(F.col("__i").isNotNull(), "same")
        .otherwise("committed")
    )
    return x.withColumn("outcome", outcome).drop("__object", "__b", "__i")


def manifests_put(manifests: DataFrame, existing: DataFrame, blocks: DataFrame, arrival: str) -> DataFrame:
    """manifests (object_id, block_id, length, checksum, ...) with `outcome`: no block, metadata mismatch, same, conflict, owned or stored.

    conflict: the object has another manifest; owned: the block is another object's. Earlier manifests of the batch count as existing.
    """
    value = F.struct("block_id", "length", "checksum")
    b = blocks.groupBy("block_id").agg(F.min(F.struct(F.col("length"), F.col("checksum"))).alias("__b"))
    x = manifests.join(b, "block_id", "left").withColumn("__bad", F.when(F.col("__b").isNull(), "no block").when(~F.struct("length", "checksum").eqNullSafe(F.col("__b")), "metadata mismatch"))
    fine = x.where("__bad is null").drop("__b", "__bad").withColumn("__old", F.lit(False))
    old = existing.select(*[c for c in existing.columns if c in manifests.columns]).withColumn("__old", F.lit(True))
    both = old.unionByName(fine, allowMissingColumns=True)
    by_object = Window.partitionBy("object_id").orderBy(F.desc("__old"), arrival)
    by_block = Window.partitionBy("block_id").orderBy(F.desc("__old"), arrival)
    both = both.withColumns({"__first": F.first(value).over(by_object), "__lead": F.row_number().over(by_object) == 1})
    both = both.withColumn("__owner", F.first(F.when(F.col("__lead"), F.col("object_id")), ignorenulls=True).over(by_block))
    mine = F.coalesce(F.col("__owner") == F.col("object_id"), F.lit(False))
    same = value.eqNullSafe(F.col("__first"))
    outcome = F.when(F.col("__lead") & mine, "stored").when(~same, "conflict").when(mine, "same").otherwise("owned")
    good = both.where("not __old").withColumn("outcome", outcome).select(*manifests.columns, "outcome")
    return good.unionByName(x.where("__bad is not null").withColumnRenamed("__bad", "outcome").select(*manifests.columns, "outcome"))


def restored(manifests: DataFrame, blocks: DataFrame, arrival: str, domain: str = keys.DOMAIN) -> DataFrame:
    """manifests with `outcome` when a store starts: invalid where the identity isn't its key's, orphan without its block, else as bound."""
    x = manifests.withColumn("__bad", ~keys.object_id(F.col("scope_digest"), F.col("prefix_digest"), F.col("token_count"), domain).eqNullSafe(F.col("object_id")))
    on = ["block_id", "length", "checksum"]
    x = x.join(blocks.select(*on).distinct().withColumn("__here", F.lit(True)), on, "left")
    why = F.when(F.col("__bad"), "invalid").when(F.col("__here").isNull(), "orphan")
    x = x.withColumn("__why", why).drop("__bad", "__here")
    bound = integrity.bind(x.where("__why is null").drop("__why"), arrival)
    return bound.unionByName(x.where("__why is not null").withColumnRenamed("__why", "outcome"))


def by_block(index: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (block_id, object_id) with the entry of their block; a block id is a projection, so the object must agree as well."""
    return requests.join(index, ["block_id", "object_id"], "left")


def transport_problem(wanted: Column, got: Column) -> Column:
    """Why a transport's answer is refused: it is of another block than the one asked for. Without one asked for any will do."""
    return F.when((F.coalesce(wanted, F.lit(0)) != 0) & ~got.eqNullSafe(wanted), "block id mismatch")


def stale(loaded: Column, now: Column) -> Column:
    """Why a load isn't kept: the tier was reset while it ran."""
    return F.when(~loaded.eqNullSafe(now), "generation changed")


def eligible(consumer: Column, prompt_tokens: Column, features: Column, embeds: Column) -> Column:
    """Whether a scheduler's request may be looked up: by a consumer, with tokens, of text only."""
    return F.coalesce(consumer, F.lit(False)) & prompt_tokens.isNotNull() & (F.coalesce(features, F.lit(0)) == 0) & ~F.coalesce(embeds, F.lit(False))


def model_problem(groups: Column, full_attention: Column, head: Column, head_v: Column, tp: Column, pp: Column) -> Column:
    """Why a model can't use the cache, null if it can."""
    return F.when(groups != 1, "cache groups").when(~full_attention, "attention").when(head != head_v, "head sizes").when((tp != 1) | (pp != 1), "parallelism")


def zipped(rows: DataFrame, keep: list[str], **arrays: str) -> DataFrame:
    """A row a position of arrays of one length: (keep, idx, names). Rows whose arrays differ in length are left out, as an error of theirs."""
    sizes = [F.size(c) for c in arrays.values()]
    whole = F.lit(True)
    for s in sizes[1:]:
        whole = whole & (s == sizes[0])
    each = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return rows.where(whole).select(*keep, F.posexplode(each).alias("idx", "__e")).select(*keep, "idx", *[F.col(f"__e.{n}").alias(n) for n in arrays])


def lease_id(clock: Column, counter: Column) -> Column:
    """A lease's number from a clock and a counter; never 0, which means none."""
    x = clock.cast("bigint").bitwiseXOR(counter.cast("bigint"))
    return F.when(x == 0, F.lit(1).cast("bigint")).otherwise(x)


STATES = ("unknown", "alive", "suspect", "down", "tombstone")
TIERS = ("unspecified", "memory", "disk")


def named(code: Column, names: tuple[str, ...]) -> Column:
    """The name of a code; the first for codes that there aren't."""
    out = F.lit(names[0])
    for i, n in enumerate(names[1:], 1):
        out = F.when(code == i, n).otherwise(out)
    return out


def coded(name: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for i, n in enumerate(names[1:], 1):
        out = F.when(name == n, i).otherwise(out)
    return out


def disk_announcements(headers: DataFrame, index: DataFrame, node: str) -> DataFrame:
    """What a store that starts tells of its disk: an entry a valid block file, with the object that a manifest binds to it, if one does.

    headers: of scan_headers(); index (object_id, block_id). (block_id, node_id, tier, kind, length, checksum, object_id)
    """
    o = index.groupBy("block_id").agg(F.min("object_id").alias("object_id"))
    x = headers.where("problem is null").join(o, "block_id", "left")
    return x.select("block_id", F.lit(node).alias("node_id"), F.lit(DISK).alias("tier"), F.lit(catalog.UPSERT).alias("kind"), "length", "checksum", "object_id")


def fanned_out(events: DataFrame, planes: list[str]) -> DataFrame:
    """events, one row a control plane that hears of them; a plane named twice hears once, and one without a name not at all."""
    names = [p for p in dict.fromkeys(planes) if p]
    return events.select("*", F.explode(F.array(*[F.lit(p) for p in names]).cast("array<string>")).alias("plane"))
