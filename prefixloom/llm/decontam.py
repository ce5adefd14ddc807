"""Operator 4: benchmark decontamination by a prefix-filtered set join.

An item is the set of its k-word shingles. A document leaks it if some window of the item's length holds at least
`threshold` of that set. Shingles of an item are ordered by rarity in the corpus; a window that reaches
a = ceil(threshold * n) of n shingles must hold one of the n - a + 1 rarest, so only occurrences of those open candidates.
Candidates pass a length bound, that the document has room for a shingles. The positional bound, that a window whose rarest shared shingle
is of rank r shares n - r + 1 at most, is where the prefix is cut; a window's own order isn't known before it is counted, so there is none on that
side. Then containment is counted exactly.

One scan of the texts finds every occurrence of every benchmark shingle; rarity, candidates and verification all come from
that small table. The scan holds the benchmark's shingles as a sorted array while there are at most MOST_KEYS of them
(32 MB); beyond that, all shingles of the documents meet them in a shuffled semi-join.

Defined cases: null texts are empty. Items with fewer than k words are one shingle of all their words, found where a document has
these words in a row; items without words match nothing. Rows with a null doc_id or item_id give nothing. Rows of
one doc_id are searched apart and give one result, the best; ties go to the earliest window. Rows that repeat an item_id are
separate items under one name. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.llm import text
from prefixloom.llm.shared import grouped, materialise, small_ids

K = 5
THRESHOLD = 0.6
MOST_KEYS = 4_000_000


def _i64(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def benchmark_shingles(bench: DataFrame, k: int = K) -> DataFrame:
    """(item_id, item, length, width, n, hash): item tells rows apart, width is the shingle's words, n the set's size."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for w in text.words(b.column(1)):
                one, two = text.row_hash(w)
                h, at = text.shingles(w, k)
                row = w.row
                count = np.diff(w.first)
                for i in range(w.row1 - w.row0):
                    if count[i] == 0:
                        continue
                    if count[i] < k:
                        own, width = text.run_hash(w.hash[w.first[i] : w.first[i + 1]]), int(count[i])
                    else:
                        own, width = np.unique(h[row[at] == i]), k
                    m = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[w.row0 + i].as_py()] * m, pa.int64()), pa.array(np.full(m, _i64(one[i : i + 1])[0])), pa.array(np.full(m, count[i], np.int32)), pa.array(np.full(m, width, np.int32)), pa.array(np.full(m, m, np.int32)), pa.array(_i64(own))], ["item_id", "item", "length", "width", "n", "hash"])

    schema = "item_id long, item long, length int, width int, n int, hash long"
    return bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").mapInArrow(run, schema).distinct()


def occurrences(docs: DataFrame, widths: list[int], keys: np.ndarray | None) -> DataFrame:
    """(doc_id, part, words, pos, hash) of shingles of these widths, only those in keys if given. part tells rows apart."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(keys.view(text.U))) if keys is not None else None
    longest = 1 << 20

    def run(batches):
        table = held.value if held is not None else None
        low = None
        if table is not None:
            low = np.zeros(longest, bool)  # a first sieve on 20 bits before the exact search
            low[(table >> text.U(44)).astype(np.int64)] = True
        for b in batches:
            ids = b.column(0)
            for w in text.words(b.column(1)):
                part, row, count = None, None, np.diff(w.first)
                for k in widths:
                    h, at = text.shingles(w, k)
                    if table is not None:
                        c = np.flatnonzero(low[(h >> text.U(44)).astype(np.int64)])
                        near = np.minimum(np.searchsorted(table, h[c]), max(len(table) - 1, 0))
                        c = c[table[near] == h[c]] if len(table) else c[:0]
                        h, at = h[c], at[c]
                    if not len(h):
                        continue
                    if row is None:
                        part, row = text.row_hash(w)[0], w.row
                    r = row[at]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(w.row0 + r)), pa.array(_i64(part)[r]), pa.array(count[r].astype(np.int32)), pa.array((at - w.first[r]).astype(np.int32)), pa.array(_i64(h))], ["doc_id", "part", "words", "pos", "hash"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return x.mapInArrow(run, "doc_id long, part long, words int, pos int, hash long")


def _windows(t: pa.Table) -> pa.Table:
    """The window with most distinct shingles of each (item_id, item, doc_id, part); rows come sorted by these and pos."""
    c = {n: t.column(n).to_numpy() for n in ("item_id", "item", "doc_id", "part", "pos", "hash", "length", "width", "n")}
    key = np.ones(len(c["pos"]), bool)
    key[1:] = False
    for n in ("item_id", "item", "doc_id", "part"):
        key[1:] |= c[n][1:] != c[n][:-1]
    heads = np.flatnonzero(key)
    tails = np.append(heads[1:], len(key))
    group = np.cumsum(key) - 1
    reach = c["pos"].astype(np.int64) + c["length"] - c["width"]
    flat = group * (1 << 40) + c["pos"]
    upto = np.searchsorted(flat, group * (1 << 40) + reach, "right")
    order = np.lexsort((c["pos"], c["hash"], group))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (c["hash"][order[1:]] == c["hash"][order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    score = upto - np.arange(len(key))
    for g in np.unique(group[again]):  # only groups that repeat a shingle need a walk
        a, z = heads[g], tails[g]
        seen: dict[int, int] = {}
        e = a
        for i in range(a, z):
            while e < upto[i]:
                seen[c["hash"][e]] = seen.get(c["hash"][e], 0) + 1
                e += 1
            score[i] = len(seen)
            h = c["hash"][i]
            if seen[h] == 1:
                del seen[h]
            else:
                seen[h] -= 1
    best = np.lexsort((c["pos"], -score, group))
    first = best[np.searchsorted(group[best], np.arange(len(heads)))]
    return pa.table({"item_id": c["item_id"][first], "doc_id": c["doc_id"][first], "found": score[first].astype(np.int32), "n": c["n"][first], "start_word": c["pos"][first]})


def leaks(docs: DataFrame, bench: DataFrame, k: int = K, threshold: float = THRESHOLD, most_keys: int = MOST_KEYS) -> DataFrame:
    """(item_id, doc_id, start_word, found, n, containment) of every item that leaks into a document."""
    items = materialise(benchmark_shingles(bench, k), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    keys = small_ids(items, "hash", most_keys)
    found = occurrences(docs, widths, keys)
    if keys is None:
        found = found.join(items.select("hash").distinct(), "hash", "left_semi")
    found = materialise(found.distinct(), "occurrences")
    rarity = found.groupBy("hash").agg(F.count(F.lit(1)).alias("seen"))
    order = Window.partitionBy("item_id", "item").orderBy(F.coalesce("seen", F.lit(0)), "hash")
    need = F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")
    ranked = items.join(rarity, "hash", "left").withColumn("rank", F.row_number().over(order)).withColumn("need", need)
    prefix = ranked.where("rank <= n - need + 1")
    room = F.expr("words >= need + width - 1 or words >= length")
    opened = found.select("doc_id", "part", "words", "hash").join(prefix, "hash").where(room).select("doc_id", "part", "item_id", "item").distinct()
    hits = opened.join(items, ["item_id", "item"]).join(found, ["doc_id", "part", "hash"])
    same = ["item_id", "item", "doc_id", "part"]
    hits = hits.select(*same, "pos", "hash", "length", "width", "n")
    best = grouped(hits, same, ["pos"], _windows, "item_id long, doc_id long, found int, n int, start_word int")
    best = best.where(F.col("found") >= need)
    one = Window.partitionBy("item_id", "doc_id").orderBy(F.desc(F.col("found") / F.col("n")), F.desc("found"), "start_word")
    best = best.withColumn("r", F.row_number().over(one)).where("r = 1")
    return best.select("item_id", "doc_id", "start_word", "found", "n", (F.col("found") / F.col("n")).alias("containment"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{0080}}-\\x{{10FFFF}}]+')"
SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM {{docs}}),
bw AS (SELECT item_id, {_WORDS} AS w FROM {{bench}}),
ds AS (SELECT doc_id, i AS pos, array_to_string(w[i + 1:i + {K}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - {K - 1})) AS i FROM dw)),
bs AS (SELECT DISTINCT item_id, len, array_to_string(w[i + 1:i + {K}], ' ') AS s FROM (SELECT item_id, len(w) AS len, w, unnest(range(len(w) - {K - 1})) AS i FROM bw)),
sized AS (SELECT *, (count(*) OVER (PARTITION BY item_id))::INTEGER AS n FROM bs),
hits AS (SELECT item_id, doc_id, len, n, s, pos FROM ds JOIN sized USING (s)),
win AS (SELECT a.item_id, a.doc_id, a.n, a.pos, count(DISTINCT b.s)::INTEGER AS found
        FROM hits a JOIN hits b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + a.len - {K}
        GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY found DESC, pos) AS r FROM win WHERE found >= ceil(n * {THRESHOLD} - 1e-9))
SELECT item_id, doc_id, pos::INTEGER AS start_word, found, n, found::DOUBLE / n AS containment FROM best WHERE r = 1
"""
