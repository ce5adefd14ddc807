"""The catalogue of block locations and of nodes: replay of an append-only log, views, tombstones, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPSERT, DELETE = 1, 2
ALIVE, SUSPECT, DOWN, TOMBSTONE = 1, 2, 3, 4
KEY = ["block_id", "node_id", "tier"]
TOMBSTONE_TTL_S = 600


def replay(events: DataFrame) -> DataFrame:
    """The last write per (block, node, tier) by version; version 0 is skipped. Deletes stay, as tombstones. Combines before the shuffle."""
    rest = [c for c in events.columns if c not in KEY]
    x = events.where("version > 0").groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("last"))
    return x.select(*KEY, "last.*")


def clock(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def prune(state: DataFrame, now: Column, ttl_s: int = TOMBSTONE_TTL_S) -> DataFrame:
    """state without tombstones older than the time to live."""
    return state.where(~((F.col("kind") == DELETE) & (F.unix_timestamp(now) - F.unix_timestamp("event_time") > ttl_s)))


def locations(state: DataFrame, nodes: DataFrame) -> DataFrame:
    """Live locations with the nodes' present addresses, '' for unknown nodes. As a table they have no order; a list of one block's is by node and tier."""
    live = state.where(F.col("kind") == UPSERT)
    return live.join(nodes.select("node_id", "addr"), "node_id", "left").withColumn("addr", F.coalesce("addr", F.lit("")))


def all_replicas(*lists: DataFrame) -> DataFrame:
    """The lists of several coordinators one after another, repeats kept."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionAll(x)
    return out


def announced(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests with a `status`: the checks of announcing or forgetting a block."""
    known = nodes.select("node_id", F.lit(True).alias("known"))
    x = requests.join(known, "node_id", "left")
    status = (
        F.when(F.coalesce("node_id", F.lit("")) == "", "INVALID_ARGUMENT")
        .when(F.coalesce(F.col("block_id"), F.lit(0)) == 0, "INVALID_ARGUMENT")
        .when(~F.col("tier").isin(1, 2), "INVALID_ARGUMENT")
        .when((F.col("kind") == UPSERT) & ~F.coalesce(F.octet_length("object_id"), F.lit(0)).isin(0, 32), "INVALID_ARGUMENT")
        .when((F.col("kind") == UPSERT) & F.col("known").isNull(), "NOT_FOUND")
        .otherwise("OK")
    )
    return x.withColumn("status", status).drop("known")


def membership(commands: DataFrame, key: str = "node_id") -> DataFrame:
    """Nodes after replaying commands (node, seq, op, version, state, at) in order of seq; a fold, as every step depends on the one before.

    op: upsert, register, heartbeat, mark, leave. (node, state, version, last_heartbeat, applied, rejected)
    """
    none = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("last"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"))

    def step(s: Column, c: Column) -> Column:
        new, dead = s["version"] == 0, s["state"] == TOMBSTONE
        wanted = F.when(c["op"] == "register", ALIVE).otherwise(F.when(c["state"] == 0, ALIVE).otherwise(c["state"]))
        number = F.when((c["op"] == "register") & ~new & (c["version"] <= s["version"]), s["version"] + 1).otherwise(c["version"])
        writes = c["op"].isin("upsert", "register")
        ok = (
            F.when(writes, new | (number > s["version"]))
            .when(c["op"] == "heartbeat", ~new & ~dead)
            .when(c["op"] == "mark", ~new & (~dead | (c["state"] == TOMBSTONE)))
            .otherwise(c["op"] == "leave")
        )
        state = F.when(writes, wanted).when(c["op"] == "heartbeat", ALIVE).when(c["op"] == "mark", c["state"]).otherwise(TOMBSTONE)
        version = F.when(writes, number).otherwise(s["version"] + 1)
        # a mark keeps the heartbeat
        last = F.when(c["op"] == "mark", s["last"]).otherwise(c["at"])
        return F.struct(
            F.when(ok, state).otherwise(s["state"]).cast("int").alias("state"), F.when(ok, version).otherwise(s["version"]).cast("bigint").alias("version"),
            F.when(ok, last).otherwise(s["last"]).cast("bigint").alias("last"), (s["applied"] + ok.cast("int")).alias("applied"), (s["rejected"] + (~ok).cast("int")).alias("rejected"),
        )

    each = F.struct("seq", "op", "version", "state", "at")
    x = commands.groupBy(key).agg(F.sort_array(F.collect_list(each)).alias("log"))
    x = x.select(key, F.aggregate("log", none, step).alias("s"))
    return x.select(key, F.col("s.state").alias("state"), F.col("s.version").alias("version"), F.col("s.last").alias("last_heartbeat"), F.col("s.applied").alias("applied"), F.col("s.rejected").alias("rejected")).where("version > 0")


def merge_members(rows: DataFrame) -> DataFrame:
    """Synchronised member lists: the greatest version per node, of equal versions the one that came first; unknown states are alive."""
    rest = [c for c in rows.columns if c != "node_id"]
    x = rows.where("node_id <> ''").withColumn("state", F.when(F.col("state") == 0, ALIVE).otherwise(F.col("state")))
    return x.groupBy("node_id").agg(F.max_by(F.struct(*rest), F.struct(F.col("version"), (-F.col("seq")).alias("s"))).alias("m")).select("node_id", "m.*")


def listed(nodes: DataFrame, tombstones: bool = False) -> DataFrame:
    return nodes if tombstones else nodes.where(F.col("state") != TOMBSTONE)


def node_problem(node_id: Column, addr: Column, state: Column) -> Column:
    return F.when(F.coalesce(node_id, F.lit("")) == "", "empty id").when((state != TOMBSTONE) & (F.coalesce(addr, F.lit("")) == ""), "empty address")


def route_affecting(history: DataFrame) -> DataFrame:
    """history (node, seq, state, addr) with `reroutes`: whether the change alters routing."""
    from pyspark.sql import Window

    w = Window.partitionBy("node_id").orderBy("seq")
    was, where_ = F.lag("state").over(w), F.lag("addr").over(w)
    alive, before = F.col("state") == ALIVE, was == ALIVE
    return history.withColumn("reroutes", F.when(was.isNull(), alive).otherwise((alive != before) | (alive & (F.col("addr") != where_))))


STATUS = {"empty id": "INVALID_ARGUMENT", "not found": "NOT_FOUND", "tombstoned": "FAILED_PRECONDITION", "no alive nodes": "UNAVAILABLE"}


def status(error: Column) -> Column:
    """The status code that an error is reported as."""
    out = F.when(error.isNull(), "OK")
    for e, code in STATUS.items():
        out = out.when(error == e, code)
    return out.otherwise("INTERNAL")
