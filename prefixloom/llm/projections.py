"""Operator 5: near-duplicate embeddings by sorted projection passes.

Each pass hashes a vector by BITS random hyperplanes and sorts all vectors lexicographically by the concatenated bits; each vector is
compared with the WINDOW vectors before it. Passes use different hyperplanes, so neighbours torn apart by an early bit of one
meet in another. A 256-bit signature that travels with the sort drops neighbours whose Hamming distance says that the cosine can't
reach the threshold (five standard errors of slack); the rest are verified on the vectors and the verified pairs of all
passes united into groups. Vectors are centred on a sample's mean before the key's hashes, and the number of passes follows the row
count and the sample's crowding, PASSES at least, so that by the model of plan() RECALL of the pairs at the threshold is found.

Equal directions are one node before the sort, so groups of exact copies, however large, take one place in a window. All passes
are sorted by one range shuffle of 52-byte rows; windows that cross a range border are completed from the rows at the borders.

Defined cases: rows with a null id or embedding, with a null, NaN or infinite element, with no elements or of length zero are in
no group. Vectors of different dimension are never duplicates. Rows that repeat an id are one item with several vectors, in the
groups of each; ties in the sort go by node. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.llm.shared import components, materialise
from prefixloom.llm.text import U, mix

THRESHOLD = 0.95
PASSES = 20
BITS = 64
WINDOW = 32
SEED = 5
SAMPLE = 1000
RECALL = 0.95
_SIGN_WORDS = 4
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_planes: dict[tuple, np.ndarray] = {}


def planes(dim: int, bits: int, seed: int) -> np.ndarray:
    if (dim, bits, seed) not in _planes:
        _planes[dim, bits, seed] = np.random.default_rng((seed, dim, bits)).standard_normal((dim, bits)).astype(np.float32)
    return _planes[dim, bits, seed]


def _packed(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """(rows, bits / 64) unsigned words of the signs of the projections, the first hash in the highest bit."""
    s = x @ planes(x.shape[1], bits, seed) >= 0
    return np.packbits(s, axis=1).view(">u8").astype(U)


def vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, node, dim, unit): unit vectors as little-endian floats; node is a hash of their direction."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.values.slice(lists.offsets[0].as_py(), int(n.sum()))
            v = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
            first = np.append(0, np.cumsum(n))
            valid = np.array(lists.is_valid())
            for d in np.unique(n[valid & (n > 0)]):
                at = np.flatnonzero(valid & (n == d))
                x = v[first[at][:, None] + np.arange(d)]
                ok = np.isfinite(x).all(axis=1)
                top = np.abs(np.where(np.isfinite(x), x, 0)).max(axis=1)
                ok &= top > 0
                at, x = at[ok], x[ok] / top[ok][:, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                unit = x.astype("<f4") + np.float32(0)  # no negative zeros
                h = np.full(len(at), U(int(d)))
                for j, w in enumerate(unit.view("<u4").T.astype(U)):
                    h = mix(h * U(0x9E3779B97F4A7C15) + w + U(j))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(h.view(np.int64)), pa.array(np.full(len(at), d, np.int32)), pa.array([r.tobytes() for r in unit], pa.binary())], ["id", "node", "dim", "unit"])

    x = table.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return x.mapInArrow(run, "id long, node long, dim int, unit binary")


def plan(nodes: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, window: int = WINDOW) -> tuple[int, dict[int, np.ndarray]]:
    """(passes, centre by dimension) that find RECALL of the pairs at the threshold, modelled on SAMPLE nodes.

    For each sampled vector: t, the bits after which at most half a window of the table's farther vectors still agree with it, and the odds
    that a vector at the threshold agrees in t bits. Angles are those of the centred vectors. At least PASSES.
    """
    count = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}
    sample: dict[int, list] = {}
    for r in nodes.select("dim", "unit").orderBy("node").limit(SAMPLE).collect():
        sample.setdefault(r[0], []).append(np.frombuffer(r[1], "<f4"))
    most, centres = PASSES, {}
    for d, rows in sample.items():
        n, u = len(rows), np.stack(rows).astype(float)
        if n < 2:
            continue
        centres[d] = u.mean(axis=0).astype(np.float32)
        c = u - centres[d]
        r = np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-9)
        agree = 1 - np.arccos(np.clip(c @ c.T / (r[:, None] * r), -1, 1)) / np.pi
        agree[u @ u.T >= threshold] = 0
        near = 1 - 2 * np.arcsin(np.clip(np.sqrt(max(0.0, 2 - 2 * threshold)) / (2 * r), 0, 1)) / np.pi
        t, left, power = np.zeros(n), np.ones(n, bool), np.ones_like(agree)
        for _ in range(bits):
            left &= count[d] * power.sum(axis=1) / n > window / 2
            if not left.any():
                break
            t += left
            power *= agree
        odds = np.maximum(near**t, 1e-6)
        passes = 1
        while np.mean((1 - odds) ** passes) > 1 - RECALL:
            passes = passes + 1 + passes // 16
        most = max(most, passes)
    return most, centres


def keys(nodes: DataFrame, passes: int, bits: int, seed: int, centres: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(pass, key, node, sign): one row a pass. key sorts as the unsigned word does; its hashes are of the vectors less their centre."""

    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                c = b.column(2).take(pa.array(at))
                x = np.frombuffer(b"".join(c.to_pylist()), "<f4").reshape(len(at), d)
                sign = _packed(x, 64 * _SIGN_WORDS, seed).astype("<u8")
                sign = pa.array([r.tobytes() for r in sign], pa.binary())
                node = b.column(0).take(pa.array(at))
                k = _packed(x - centres[d] if centres and d in centres else x, bits * passes, seed + 1)
                words = bits // 64
                for p in range(passes):
                    # dimensions sort apart, as do passes
                    own = [pa.array((k[:, p * words + w] ^ U(1 << 63)).view(np.int64)) for w in range(words)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), d, np.int32)), *own, node, sign], ["pass", "dim", *[f"key{w}" for w in range(words)], "node", "sign"])

    schema = "pass int, dim int, " + "".join(f"key{w} long, " for w in range(bits // 64)) + "node long, sign binary"
    return nodes.select("node", "dim", "unit").mapInArrow(run, schema)


def near(group: np.ndarray, node: np.ndarray, sign: np.ndarray, window: int, most: int, new_from: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most `window` apart in one group within `most` differing bits; the later row is at new_from or after."""
    a, b = [], []
    for step in range(1, min(window, len(node) - 1) + 1):
        lo = max(0, new_from - step)
        i = np.flatnonzero(group[lo + step :] == group[lo : len(group) - step]) + lo
        x = sign[i] ^ sign[i + step]
        apart = _ONES[x.view(np.uint16).reshape(len(i), 4 * _SIGN_WORDS)].sum(axis=1)
        i = i[apart <= most]
        a.append(node[i])
        b.append(node[i + step])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    return np.minimum(a, b), np.maximum(a, b)


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, _SIGN_WORDS).astype(U)


def candidates(nodes: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, bits: int = BITS, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes that are window neighbours in some pass and whose signatures are close.

    Without passes, plan() sets their number and the centres; given passes hash the vectors as they are.
    """
    centres = None
    if passes is None:
        passes, centres = plan(nodes, threshold, bits, window)
    total = 64 * _SIGN_WORDS
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    most = int(np.ceil(total * p + 5 * np.sqrt(total * max(p * (1 - p), 1.0 / total))))
    spark = nodes.sparkSession
    rows = keys(nodes, passes, bits, seed, centres)
    order = ["pass", "dim", *[f"key{w}" for w in range(bits // 64)], "node"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held, seen, at = None, 0, TaskContext.get().partitionId()
        edge = lambda kind, t, first: pa.RecordBatch.from_arrays([pa.array(np.full(t.num_rows, kind, np.int32)), pa.array(np.full(t.num_rows, at, np.int32)), pa.array(np.arange(first, first + t.num_rows)), t.column("node").combine_chunks(), pa.nulls(t.num_rows, pa.int64()), t.column("group").combine_chunks(), t.column("sign").combine_chunks()], _COLUMNS)
        for b in batches:
            t = pa.table({"group": pa.array(b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()), "node": b.column("node"), "sign": b.column("sign")})
            if not t.num_rows:
                continue
            if seen < window:
                yield edge(1, t.slice(0, window - seen), seen)
            kept = held.num_rows if held is not None else 0
            t = pa.concat_tables([held, t]) if kept else t
            seen += t.num_rows - kept
            a, c = near(t.column("group").to_numpy(), t.column("node").to_numpy(), _signs(t.column("sign")), window, most, kept)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(c), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], _COLUMNS)
            held = t.slice(max(0, t.num_rows - window))
        if held is not None:
            yield edge(2, held, seen - held.num_rows)

    found = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _FOUND)
    found = materialise(found, "neighbours")

    def across(batches):
        # the first and last rows of every partition, in order: joined up over each border
        t = pa.Table.from_batches(list(batches))
        part, row = t.column("part").to_numpy(), t.column("row").to_numpy()
        node, group = t.column("a").to_numpy(), t.column("group").to_numpy()
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        part, row, node, group, sign = part[new], row[new], node[new], group[new], _signs(t.column("sign"))[new]
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for h in heads[1:]:
            lo, hi = max(0, h - window), h
            stop = heads[np.searchsorted(heads, h) + 1] if h != heads[-1] else len(part)
            hi = min(stop, h + window)
            # rows before the border reach back over whole short partitions; a gap inside a long one ends the reach
            back = lo
            for k in range(h - 1, lo, -1):
                if part[k] == part[k - 1] and row[k] != row[k - 1] + 1:
                    back = k
                    break
            fore = h + int(np.argmax(np.append(np.diff(row[h:hi]) != 1, True))) + 1
            i = slice(back, fore)
            a, b = near(group[i], node[i], sign[i], window, most, h - back)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # 2 * window rows a partition: bounded by the number of partitions, not by the data
    edges = found.where("kind > 0").select("part", "row", "a", "group", "sign")
    ends = edges.coalesce(1).sortWithinPartitions("part", "row").mapInArrow(across, "a long, b long")
    return found.where("kind = 0").select("a", "b").union(ends).where("a <> b").distinct()


_FOUND = "kind int, part int, row long, a long, b long, group long, sign binary"
_COLUMNS = [x.split()[0] for x in _FOUND.split(", ")]


def verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    x, y = (nodes.select(F.col("node").alias(s), F.col("dim").alias(f"d{s}"), F.col("unit").alias(f"u{s}")) for s in "ab")
    rows = pairs.join(x, "a").join(y, "b").where("da = db").select("a", "b", "da", "ua", "ub")

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                u, v = (np.frombuffer(b"".join(b.column(c).take(at).to_pylist()), "<f4").reshape(len(at), d).astype(float) for c in (3, 4))
                good = pa.array((u * v).sum(axis=1) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at).filter(good), b.column(1).take(at).filter(good)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def groups(table: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", column: str = "embedding", **options) -> DataFrame:
    """(vec_id, group_id) of the items in a group of two or more; group_id is the group's least id."""
    every = materialise(vectors(table, id_column, column), "vectors")
    nodes = materialise(every.groupBy("node").agg(F.first("dim").alias("dim"), F.first("unit").alias("unit")), "directions")
    pairs = materialise(verified(candidates(nodes, threshold, **options), nodes, threshold), "pairs")
    part = components(pairs)
    of = every.select("id", "node").join(part, "node", "left").select("id", F.coalesce("component", "node").alias("g")).distinct()
    of = materialise(of, "members")
    size = of.groupBy("g").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return of.join(size, "g").groupBy("id").agg(F.min("group_id").alias("group_id")).select(F.col("id").alias(id_column), "group_id")
