"""Routing of block ids to nodes: equal ranges of the unsigned 64-bit space in node order, and the older hash ring.

Ranges are disjoint and equally wide, so locating is arithmetic: the range's number is floor(block / step). The nodes are a dimension of fixed,
checked size; the data side is never shuffled while they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.functions.binary import U64, murmur_finaliser, ring_hash, signed64

SPAN = 1 << 64
MOST_BROADCAST_NODES = 100_000
REPLICAS = 100


def ranges(nodes: DataFrame) -> DataFrame:
    """(node_id, number, nodes, start, end) of the alive nodes, ranked by id. Of a node's rows the greatest version counts."""
    alive = nodes.groupBy("node_id").agg(F.max_by("state", "version").alias("state")).where("state = 1")
    n = alive.agg(F.count(F.lit(1)).alias("nodes"))
    # one row per node of a cluster: the global order is of a small table
    ranked = alive.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("bigint").alias("number")).crossJoin(F.broadcast(n))
    top = F.lit(str(SPAN - 1)).cast("decimal(21,0)")
    start = (F.col("number").cast("decimal(20,0)") * _step("nodes")).cast("decimal(38,0)")
    end = F.when(F.col("number") == F.col("nodes") - 1, top.cast("decimal(38,0)")).otherwise(start + _step("nodes") - 1)
    return ranked.select("node_id", "number", "nodes", start.cast(U64).alias("start"), end.cast(U64).alias("end"))


def _step(nodes: str) -> Column:
    """floor((2^64 - 1) / n) + 1, exact. `div` gives a BIGINT, which holds it from two nodes on; one node's range needs no step."""
    return (F.expr(f"{SPAN - 1}BD div greatest({nodes}, 2)").cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")).cast(U64)


def locate(blocks: DataFrame, block: str, routes: DataFrame, candidates: int = 1) -> DataFrame:
    """blocks with (rank, node_id, is_primary): the range's owner and the next ones round the circle, each node once; no alive nodes give no rows."""
    few = routes.limit(MOST_BROADCAST_NODES + 1).count() <= MOST_BROADCAST_NODES
    near = F.broadcast if few else (lambda x: x)
    n = routes.agg(F.count(F.lit(1)).alias("__n"))
    x = blocks.crossJoin(F.broadcast(n)).where("__n > 0")
    own = F.when(F.col("__n") == 1, F.lit(0).cast("bigint")).otherwise(F.expr(f"cast({block} as decimal(20,0)) div cast(cast({SPAN - 1}BD div greatest(__n, 2) as decimal(20,0)) + 1 as decimal(20,0))"))
    x = x.withColumn("__own", own).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(max(candidates, 1)), F.col("__n")) - 1)))
    x = x.withColumn("__number", F.pmod(F.col("__own") + F.col("__k"), F.col("__n")))
    right = near(routes.select(F.col("number").alias("__number"), "node_id"))
    return x.join(right, "__number").select(*blocks.columns, (F.col("__k") + 1).cast("int").alias("rank"), "node_id", (F.col("__k") == 0).alias("is_primary"))


def owns(blocks: DataFrame, block: str, routes: DataFrame, self_node: str, candidates: int = 1) -> DataFrame:
    """blocks with (owner, owns, involved): whether self is the primary, whether it is any candidate."""
    x = locate(blocks, block, routes, candidates)
    keep = blocks.columns
    return x.groupBy(*keep).agg(F.max(F.when(F.col("is_primary"), F.col("node_id"))).alias("owner"), F.max((F.col("node_id") == self_node) & F.col("is_primary")).alias("owns"), F.max(F.col("node_id") == self_node).alias("involved"))


def range_cover(routes: DataFrame) -> DataFrame:
    """(node_id, prefix, prefix_len): the least set of binary prefixes that covers each range, as a table function would list it."""

    def cover(batches):
        import pyarrow as pa

        for b in batches:
            out: list[tuple] = []
            for name, lo, hi in zip(*(b.column(i).to_pylist() for i in range(3))):
                lo, hi = int(lo), int(hi)
                while lo <= hi:
                    size = (lo & -lo) or SPAN
                    while size > hi - lo + 1:
                        size >>= 1
                    out.append((name, f"{lo:016x}", 65 - size.bit_length()))
                    lo += size
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.string(), pa.int32()))], ["node_id", "prefix", "prefix_len"])

    return routes.select("node_id", F.col("start").cast("string"), F.col("end").cast("string")).mapInArrow(cover, "node_id string, prefix string, prefix_len int")


def changed_routes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node_id, change) between two routings: added, removed or moved."""
    a = before.select("node_id", F.struct("start", "end").alias("a"))
    b = after.select("node_id", F.struct("start", "end").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "moved")
    return a.join(b, "node_id", "full").select("node_id", change.alias("change")).where("change is not null")


def ring(nodes: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """(hash, node_id): each alive node's points on the ring."""
    x = nodes.where("state = 1").select("node_id", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("r"))
    return x.select(ring_hash(F.concat("node_id", F.lit("#"), F.col("r").cast("string"))).alias("hash"), "node_id")


def locate_ring_n(blocks: DataFrame, block: str, points: DataFrame, n: int) -> DataFrame:
    """blocks with (rank, node_id): the first n distinct nodes clockwise, all there are if fewer."""
    x = _walked(blocks, block, points, n)
    return x.select(*blocks.columns, F.posexplode("__nodes").alias("rank", "node_id")).withColumn("rank", F.col("rank") + 1)


def route_version(history: DataFrame) -> DataFrame:
    """(version): how many changes of the history (node_id, seq, state, addr) altered the routes."""
    from prefixloom.operators import catalog

    return catalog.route_affecting(history).agg(F.count(F.when(F.col("reroutes"), 1)).alias("version"))


def routed(blocks: DataFrame, block: str, routes: DataFrame, version: DataFrame, candidates: int = 1) -> DataFrame:
    """locate() with the version of the routes, by which a client knows when what it keeps is stale."""
    return locate(blocks, block, routes, candidates).crossJoin(F.broadcast(version))


def locate_ring(blocks: DataFrame, block: str, points: DataFrame) -> DataFrame:
    """blocks with the node of the first point at or after the block's hash, round the circle; null without points."""
    return _walked(blocks, block, points, 1).select(*blocks.columns, F.get("__nodes", F.lit(0)).alias("node_id"))


def _walked(blocks: DataFrame, block: str, points: DataFrame, n: int) -> DataFrame:
    """blocks with __nodes, the list of the first n distinct nodes at or after the block's hash, round the circle.

    An as-of join without a self-join: points and blocks are sorted together in each of 4,096 slices of the circle and read from its end, as a point's
    list is its own node and then the next point's list without it. A slice begins with the list at the start of the next one. These lists
    come of a pass over the points alone, at most 4,096 of them; a task holds a batch of rows and a list.
    """
    h = murmur_finaliser(F.col(block).cast(U64))
    # BIGINT in the order of the unsigned numbers
    order, part = signed64(F.col("__h")).bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), F.shiftrightunsigned(signed64(F.col("__h")), 52).cast("int")
    placed = lambda x: x.withColumns({"__s": part, "__o": order}).drop("__h")
    # at equal hashes the points come before the blocks, and the least node id, which is first on the ring, last
    read = lambda x: x.repartition("__s").sortWithinPartitions("__s", F.desc("__o"), F.desc_nulls_last("__node"))
    one, two = placed(points.select(F.col("hash").alias("__h"), F.col("node_id").alias("__node"))), placed(blocks.select(*blocks.columns, h.alias("__h")))

    def follow(after: list[str], node: str) -> list[str]:
        return after if after and after[0] == node else [node, *[x for x in after if x != node]][:n]

    def heads(batches):
        at, after = None, []
        for b in batches:
            done = []
            for s, node in zip(b.column("__s").to_pylist(), b.column("__node").to_pylist()):
                if s != at:
                    if at is not None:
                        done.append((at, after))
                    at, after = s, []
                after = follow(after, node)
            yield _lists(*zip(*done)) if done else _lists([], [])
        if at is not None:
            yield _lists([at], [after])

    def _lists(s, nodes):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(nodes, pa.list_(pa.string()))], ["__s", "__nodes"])

    first = {r[0]: r[1] for r in read(one).mapInArrow(heads, "__s int, __nodes array<string>").collect()}
    ends: dict[int, list[str]] = {}
    after: list[str] = []
    for _ in range(2):  # the second time round the list at the end is known
        for s in range((1 << 12) - 1, -1, -1):
            ends[s] = after
            after = list(dict.fromkeys([*first.get(s, []), *after]))[:n]
    keep = blocks.columns

    def walk(batches):
        import pyarrow as pa

        at, after = None, []
        for b in batches:
            out, mine = [], []
            for i, (s, node) in enumerate(zip(b.column("__s").to_pylist(), b.column("__node").to_pylist())):
                if s != at:
                    at, after = s, ends.get(s, [])
                if node is not None:
                    after = follow(after, node)
                else:
                    mine.append(i)
                    out.append(after)
            rows = b.select(keep).take(pa.array(mine, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.list_(pa.string()))], [*keep, "__nodes"])

    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    schema = StructType([*[StructField(f.name, f.dataType) for f in blocks.schema.fields], StructField("__nodes", ArrayType(StringType()))])
    return read(two.unionByName(one, allowMissingColumns=True)).mapInArrow(walk, schema)
