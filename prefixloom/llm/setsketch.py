"""Operator 8: near-duplicate documents by SetSketch registers.

A document is the set of its k-word shingles. Every shingle throws points of a Poisson process, each point falling in one of M
registers; a register keeps the least point x of the set, as floor(1 - log_B(x)) truncated to 16 bits, so a larger value is
a lesser point. Union of sets is the registers' maximum (merge). Register values are banded to find candidates; a
pair's Jaccard index is estimated jointly by maximum likelihood from how many registers are greater, less and equal;
pairs whose estimate could reach the threshold are verified on the exact sets, and verified pairs are joined into groups.

Nothing is capped, yet copies of one text, or of several, make no pairs of each with each:
* documents with equal sets are one node from the start, named by a 64-bit fingerprint of the set;
* in a band's bucket every node is paired with the least one, its lead, and verified with it if the estimate lets it. A node that isn't
  verified is paired with those that are only where the triangle inequality of Jaccard distances lets them be near: J(lead, x) is at most
  J(lead, y) + 1 - threshold, within the estimates' errors. Those that aren't verified get a lead of their own, in ROUNDS rounds; what is left
  then is paired each with each. So every bucket mate is compared, linked through a lead, or too far by the lead's account;
* pairs of such mates are estimated and verified only if they still join two different components. Other edges could not
  change the groups.
So a bucket of a few families costs their number times its size. Only one of many unlike documents, each near its lead but not near enough, is compared
pair by pair.

Defined cases: texts without words, null or empty, and rows with a null doc_id are in no group. Texts of fewer than k words
are one shingle of all their words. Rows of one doc_id are one document that is in the groups of all its rows. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.llm import text
from prefixloom.llm.shared import components, drop_ids, grouped, materialise, small_ids
from prefixloom.llm.text import U

K = 3
M = 160
ROWS = 4
B = 1.01
RATE = 20.0
THRESHOLD = 0.5
ROUNDS = 3
MOST_IDS = 4_000_000
_GOLD = U(0x9E3779B97F4A7C15)


def sets(w: text.Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, by row, and each row's first."""
    h, at = text.shingles(w, k)
    row = w.row[at] if len(at) else np.zeros(0, np.int64)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.concatenate([text.run_hash(w.hash[w.first[i] : w.first[i + 1]]) for i in short])
        h, row = np.concatenate([h, own]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(w.row1 - w.row0 + 1))


def sketch(h: np.ndarray, first: np.ndarray, m: int = M, b: float = B, a: float = RATE) -> np.ndarray:
    """Registers (rows, m) of sets given as concatenated hashes; an empty set has zeros."""
    n = np.diff(first)
    rows = len(n)
    least = np.full(rows * m, np.inf)
    todo = np.flatnonzero(n > 0)
    reach = np.log(m) + 5.0
    done_to = np.zeros(rows)
    while len(todo):
        limit = np.zeros(rows)
        limit[todo] = reach / (n[todo] * a)
        owner = np.repeat(todo, n[todo])
        x = h[np.concatenate([np.arange(first[i], first[i + 1]) for i in todo])] if len(todo) < rows else h
        t = np.zeros(len(x))
        step = U(0)
        top = limit[owner]
        while len(x):
            width = int(min(256, max(1, 65536 // len(x))))
            j = np.arange(width, dtype=U) + step + U(1)
            r = text.mix((x[:, None] + j[None, :] * _GOLD).ravel())
            gap = -np.log(((r >> U(20)).astype(np.float64) + 0.5) * 2.0**-44) / (m * a)
            at = np.cumsum(gap.reshape(len(x), width), axis=1) + t[:, None]
            keep = at < top[:, None]
            register = (r & U((1 << 20) - 1)).astype(np.int64) % m
            slot = (owner[:, None] * m + register.reshape(len(x), width))[keep]
            np.minimum.at(least, slot, at[keep])
            alive = keep[:, -1]
            x, owner, t, top = x[alive], owner[alive], at[alive, -1], top[alive]
            step += U(width)
        done_to[todo] = limit[todo]
        open_rows = np.isinf(least.reshape(rows, m)).any(axis=1) & (n > 0)
        todo = np.flatnonzero(open_rows)
        reach *= 2
    value = np.floor(1.0 - np.log(least.reshape(rows, m)) / np.log(b), where=n[:, None] > 0, out=np.zeros((rows, m)))
    return np.clip(value, 0, 65535).astype("<u2")


def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(x, y)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, b: float = B) -> np.ndarray:
    """Maximum-likelihood Jaccard index of row pairs, given registers and set sizes."""
    m = x.shape[1]
    up, down = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = m - up - down
    u = nx / np.maximum(nx + ny, 1)
    v = 1.0 - u
    hi = np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)
    lo = np.zeros_like(hi)

    def p(z):
        return -np.log1p(-np.clip(z, 0, 1) * (b - 1) / b) / np.log(b)

    def fit(j):
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return up * np.log(np.maximum(more, tiny)) + down * np.log(np.maximum(less, tiny)) + equal * np.log(np.maximum(1 - more - less, tiny))

    g = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = fit(c) > fit(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array of equally long rows."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def _matrix(column: pa.ChunkedArray, m: int) -> np.ndarray:
    c = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    off = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]].view("<u2").reshape(len(c), m)


def _fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    one = np.concatenate([np.zeros(1, U), np.cumsum(text.mix(h ^ U(0xA0761D6478BD642F)))])
    n = np.diff(first).astype(U)
    return text.mix(one[first[1:]] - one[first[:-1]] + n * _GOLD)


def sketches(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(doc_id, node, n, registers) of the documents with words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for w in text.words(batch.column(1)):
                h, first = sets(w, k)
                n = np.diff(first)
                has = np.flatnonzero(n > 0)
                if len(has):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(w.row0 + has)), pa.array(_fingerprints(h, first)[has].view(np.int64)), pa.array(n[has].astype(np.int32)), _binary(sketch(h, first, m)[has])], ["doc_id", "node", "n", "registers"])

    return _plain(docs).mapInArrow(run, "doc_id long, node long, n int, registers binary")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _bands(nodes: DataFrame, m: int, rows: int) -> DataFrame:
    """(band, node): the band's number is part of its hash."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), m)
            parts = x[:, : m // rows * rows].reshape(len(x), m // rows, rows).astype(U)
            h = np.full(parts.shape[:2], U(0), U) + np.arange(m // rows, dtype=U)[None, :]
            for r in range(rows):
                h = text.mix(h * _GOLD + parts[:, :, r])
            node = np.repeat(b.column(0).to_numpy(), m // rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(node)], ["band", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "band long, node long")


def _estimated(pairs: DataFrame, nodes: DataFrame, m: int, keep: float) -> DataFrame:
    """pairs with the estimate j, and `close`: whether it reaches keep."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    rows = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches):
        for b in batches:
            if b.num_rows:
                na, nb = b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float)
                j = estimate(_matrix(b.column(4), m), _matrix(b.column(5), m), na, nb)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j), pa.array(j >= keep)], ["a", "b", "j", "close"])

    return rows.mapInArrow(run, "a long, b long, j double, close boolean")


def _leads(t: pa.Table) -> pa.Table:
    """(band, lead, node) of the buckets with two nodes or more, sorted by band and node."""
    band, node = t.column("band").to_numpy(), t.column("node").to_numpy()
    new = np.ones(len(band), bool)
    new[1:] = band[1:] != band[:-1]
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(band)))
    lead = np.repeat(node[heads], size)
    keep = ~new & (node != lead)
    return pa.table({"band": band[keep], "lead": lead[keep], "node": node[keep], "size": np.repeat(size, size)[keep]})


def bucket_links(nodes: DataFrame, m: int = M, rows: int = ROWS) -> DataFrame:
    """(band, lead, node, size) of the buckets with two nodes or more."""
    return grouped(_bands(nodes, m, rows), ["band"], ["node"], _leads, "band long, lead long, node long, size long")


def lead_pairs(links: DataFrame, nodes: DataFrame, m: int, threshold: float) -> DataFrame:
    """(a, b, close) of every node b with the least node a of a bucket. close: the estimate is within three standard errors or above."""
    pairs = links.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    return _estimated(pairs, nodes, m, _least(m, threshold))


def _least(m: int, threshold: float) -> float:
    return threshold - 3 * float(np.sqrt(threshold * (1 - threshold) / m))


def _mates(near: DataFrame, far: DataFrame, m: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes far from their lead with those near it, (band, lead, node, j) both, that may be near each other.

    j is compared in tenths: a far node meets the tenths that it can reach, so that what it can't is never paired.
    """
    slack = 2 * (threshold - _least(m, threshold))
    top = F.least(F.floor((F.col("j") + 1 - threshold + slack) * 10), F.lit(10))
    y = far.select("band", "lead", F.col("node").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), top.cast("bigint"))).alias("tenth"))
    x = near.select("band", "lead", F.col("node").alias("x"), F.floor(F.col("j") * 10).alias("tenth"))
    return y.join(x, ["band", "lead", "tenth"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def rounds(links: DataFrame, first: DataFrame, sure: DataFrame, own: DataFrame, nodes: DataFrame, m: int, threshold: float, most: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(verified pairs, pairs (a, b) still to be compared) of all buckets, given those of the first leads."""
    open_, known = links.where("size > 2").select("band", "lead", "node"), first
    every, todo = sure, []
    for r in range(most):
        on = [F.col("lead") == F.col("a"), F.col("node") == F.col("b")]
        good = every.select("a", "b", F.lit(True).alias("sure"))
        x = open_.join(known.select("a", "b", "j"), on).drop("a", "b").join(good, on, "left").drop("a", "b")
        x = materialise(x, "round")
        near, far = x.where("sure"), x.where("sure is null")
        todo.append(_mates(near, far, m, threshold))
        lead = far.groupBy("band").agg(F.min("node").alias("next"), F.count(F.lit(1)).alias("n")).where("n > 1")
        open_ = far.select("band", "node").join(lead, "band").where("node <> next").select("band", F.col("next").alias("lead"), "node")
        if not open_.limit(1).count():
            return every, _all(todo)
        if r == most - 1:
            break
        pairs = open_.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        known = materialise(pairs.join(known, ["a", "b"], "left_semi").join(known, ["a", "b"]).unionByName(_estimated(pairs.join(known, ["a", "b"], "left_anti"), nodes, m, _least(m, threshold))), "known")
        fresh = known.where("close").select("a", "b").join(every, ["a", "b"], "left_anti")
        every = every.unionByName(materialise(_verified(fresh, own, threshold), "sure"))
    # what no lead has sorted out: the last lead's mates each with each
    rest = open_.select("band", F.col("lead").alias("node")).union(open_.select("band", "node")).distinct()
    x, y = rest.select("band", F.col("node").alias("a")), rest.select("band", F.col("node").alias("b"))
    todo.append(x.join(y, "band").where("a < b").select("a", "b").distinct())
    return every, _all(todo)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def mate_pairs(todo: DataFrame, every: DataFrame, part: DataFrame, nodes: DataFrame, m: int, threshold: float) -> DataFrame:
    """Of the pairs to be compared, those that the estimate leaves. Pairs that part, the components of the verified pairs, holds together are left out."""
    rest = todo.join(every, ["a", "b"], "left_anti")
    a, b = (part.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    rest = rest.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    return _estimated(rest, nodes, m, _least(m, threshold)).where("close").select("a", "b")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))


def exact_sets(docs: DataFrame, names: DataFrame, k: int = K, most: int = MOST_IDS) -> DataFrame:
    """(node, shingles) of the nodes in names. The scan filters by a sorted array while there are at most `most` names, else by a join."""
    ids = small_ids(names, "node", most)
    held = docs.sparkSession.sparkContext.broadcast(ids) if ids is not None else None

    def run(batches):
        for batch in batches:
            for w in text.words(batch.column(1)):
                h, first = sets(w, k)
                node = _fingerprints(h, first).view(np.int64)
                keep = np.diff(first) > 0
                if held is not None:
                    keep &= np.isin(node, held.value)
                at = np.flatnonzero(keep)
                if len(at):
                    raw = [h[first[i] : first[i + 1]].tobytes() for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(raw, pa.binary())], ["node", "shingles"])

    found = _plain(docs).mapInArrow(run, "node long, shingles binary")
    if ids is None:
        found = found.join(names.select("node").distinct(), "node", "left_semi")
    return found


def _verified(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    rows = pairs.join(own.withColumnRenamed("node", "a").withColumnRenamed("shingles", "sa"), "a").join(own.withColumnRenamed("node", "b").withColumnRenamed("shingles", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            good = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), U) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= threshold * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, k: int = K, m: int = M, rows: int = ROWS, threshold: float = THRESHOLD, most_ids: int = MOST_IDS) -> DataFrame:
    """(doc_id, group_id) of the documents in a group of two or more; group_id is the group's least doc_id."""
    every = materialise(sketches(docs, k, m), "sketches")
    nodes = materialise(every.groupBy("node").agg(F.first("n").alias("n"), F.first("registers").alias("registers")), "nodes")
    links = materialise(bucket_links(nodes, m, rows), "links")
    first = materialise(lead_pairs(links, nodes, m, threshold), "first")
    close = first.where("close").select("a", "b")
    # sets of all that is close to a lead, and of those that will get another: one scan
    odd = links.where("size > 2").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct().join(close, ["a", "b"], "left_anti").select(F.col("b").alias("node"))
    own = materialise(exact_sets(docs, _ends(close).union(odd), k, most_ids).dropDuplicates(["node"]), "sets")
    sure = materialise(_verified(close, own, threshold), "sure")
    sure, todo = rounds(links, first, sure, own, nodes, m, threshold)
    part = materialise(components(sure), "parts")
    more = materialise(mate_pairs(todo, sure, part, nodes, m, threshold), "mates")
    new = materialise(_ends(more).distinct().join(own, "node", "left_anti"), "new")
    if new.limit(1).count():
        own = own.unionByName(materialise(exact_sets(docs, new, k, most_ids).dropDuplicates(["node"]), "sets"))
    part = materialise(components(sure.union(_verified(more, own, threshold))), "groups")
    of = every.select("doc_id", "node").join(part, "node", "left").select("doc_id", F.coalesce("component", "node").alias("g")).distinct()
    of = materialise(of, "members")
    size = of.groupBy("g").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return of.join(size, "g").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the least doc_id of each group; rows outside groups stay."""
    return drop_ids(docs, materialise(groups(docs, **options).where("doc_id <> group_id"), "copies"))
