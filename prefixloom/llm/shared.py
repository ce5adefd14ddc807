"""Lineage cuts in the cluster's shared folder, and connected components of an edge list."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.sources.shared import delete, materialise, scratch, shared_folder

__all__ = ["components", "drop_ids", "grouped", "materialise", "scratch", "set_aside", "shared_folder", "small_ids", "streamed", "trimmed"]

#: Rows that leave a task at once: the engine holds them outside its heap.
SENT = 1 << 15


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable. Null ends and self-loops are ignored; no edges give no rows.

    Alternates large-star and small-star until nothing changes: O(log n) rounds on the chains and stars met here.
    Each round is written to the shared folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u itself, points at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, e = e, materialise(small.where("u <> v").distinct(), "edges")
        delete(e.sparkSession, old.inputFiles()[0].rsplit("/", 1)[0]) if old.inputFiles() else None
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def trim() -> None:
    """Give what this process has freed back to the system: neither the C library nor Arrow does so by itself."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if free := getattr(ctypes.CDLL(None), "malloc_trim", None):
        free(0)


def trimmed(run: Callable) -> Callable:
    """run, for mapInArrow, with trim() at the end of a task: its process waits for others, and what it keeps counts as the executor's."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def grouped(df: DataFrame, keys: list[str], order: list[str], fn, schema: str, rows_at_once: int = 200_000) -> DataFrame:
    """Run fn over pyarrow tables made of whole groups of `keys` (non-null), sorted by keys and order.

    Many small groups share one call, so fn can be vectorised; a group is never split. It is for groups whose size the data's nature
    bounds: while a group is longer than a call, its end is looked for each time that what is held has doubled, so time grows with its length.
    """
    import pyarrow as pa

    def run(batches):
        held, n, goal = [], 0, rows_at_once
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            n += b.num_rows
            if n < goal:
                continue
            t = pa.Table.from_batches(held)
            at = _last_group(t, keys)
            if at:
                yield from fn(t.slice(0, at).combine_chunks()).to_batches(max_chunksize=SENT)
            held = t.slice(at).to_batches()
            n = t.num_rows - at
            goal = max(rows_at_once, 2 * n)
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches(max_chunksize=SENT)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(trimmed(run), schema)


def _last_group(t, keys: list[str]) -> int:
    """The row at which the last group of a sorted table begins."""
    import pyarrow.compute as pc

    at, last = 0, t.num_rows - 1
    for k in keys:
        other = (~pc.equal(t.column(k), t.column(k)[last]).to_numpy()).nonzero()[0]
        if len(other):
            at = max(at, int(other[-1]) + 1)
    return at


def streamed(df: DataFrame, keys: list[str], order: list[str], fn, schema: str, rows_at_once: int = 200_000) -> DataFrame:
    """Run fn over pyarrow tables in the order of keys and order, wherever a group is cut: groups may be of any size, a task holds one piece.

    fn(table, held) -> (table, held): held is what it wants to know of the rows before, None at first.
    """
    import pyarrow as pa

    def run(batches):
        pieces, n, held = [], 0, None
        for b in batches:
            pieces.append(b)
            n += b.num_rows
            if n >= rows_at_once:
                out, held = fn(pa.Table.from_batches(pieces).combine_chunks(), held)
                yield from out.to_batches(max_chunksize=SENT)
                pieces, n = [], 0
        if n:
            yield from fn(pa.Table.from_batches(pieces).combine_chunks(), held)[0].to_batches(max_chunksize=SENT)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(trimmed(run), schema)


def small_ids(df: DataFrame, column: str, most: int = 4_000_000):
    """Sorted numpy array of the column's distinct values if there are at most `most` (8 bytes each), else None."""
    import numpy as np

    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    if ids.limit(most + 1).count() > most:
        return None
    return np.sort(ids.toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64))


def drop_ids(docs: DataFrame, losers: DataFrame, column: str = "doc_id", most: int = 500_000) -> DataFrame:
    """docs without the rows whose id is in losers; broadcast while losers has at most `most` ids, else a shuffled anti-join."""
    own = f"__px_{uuid.uuid4().hex}"
    losers = losers.select(F.col(column).alias(own)).distinct()
    if losers.limit(most + 1).count() <= most:
        losers = F.broadcast(losers)
    return docs.join(losers, docs[column] == F.col(own), "left_anti")


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns named as our own, __px_..., renamed; and what gives a result their names back."""
    names = {c: f"__own_{i}_{uuid.uuid4().hex}" for i, c in enumerate(docs.columns) if c.startswith("__px_")}
    return docs.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})
