"""Operator 2: language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (lower-cased, runs of other bytes as one kind of break), weighted by 1 + log of
their count and by inverse document frequency, normalised to length 1. Document frequencies are counted over all documents. Each language has up to
CLUSTERS centroids from spherical k-means over its labelled sample, less members nearer to another language's mean. A text gets the language of the centroid with the
greatest cosine; it is rejected, as language `und`, if its distance 1 - cosine is beyond the radius: MARGIN times the
farthest distance of a sample member of that language from its centroid, or if it has fewer than LEAST n-grams.

The classifier is fitted on a bounded sample of labelled rows: at most SAMPLE documents per language, those with the least hash of
doc_id, whatever the size of the table. Classification reads whole texts.

Defined cases: null and empty texts and texts without letters are rejected with score 0. Rows with a null label only
count for frequencies. Without labelled rows all are rejected. Rows that repeat are classified each; null doc_ids too. Equal
cosines go to the language first in alphabetical order. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.llm import text
from prefixloom.llm.text import U

SAMPLE = 250
CLUSTERS = 4
DIM = 4096
GRAMS = (1, 2, 3, 4)
MARGIN = 1.25
LEAST = 5
SEED = 11
ROWS_AT_ONCE = 256


def counts(column: pa.Array):
    """(first row, counts (rows, DIM)) of slices of the column."""
    raw, offsets = text.buffers(column)
    for a, b in text.spans(offsets, 1 << 19):
        for c in range(a, b, ROWS_AT_ONCE):
            d = min(b, c + ROWS_AT_ONCE)
            yield c, _count(raw[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])


def _count(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    letter = text._WORD[data] & ~((data >= 48) & (data < 58))
    x = np.where(letter, text._LOWER[data], 32).astype(np.int64)
    keep = np.ones(len(x), bool)
    keep[1:] = letter[1:] | letter[:-1]
    row = np.repeat(np.arange(rows), np.diff(off))
    x, row = x[keep], row[keep]
    first = np.searchsorted(row, np.arange(rows + 1))
    left = first[1:][row] - np.arange(len(x)) if len(x) else x
    code, slot = np.zeros(len(x), np.int64), []
    wide = np.concatenate([x, np.zeros(max(GRAMS), np.int64)])
    for n in range(1, max(GRAMS) + 1):
        code = code * 257 + wide[n - 1 : n - 1 + len(x)] + 1
        if n in GRAMS:
            ok = left >= n
            if n == 1:
                ok &= x != 32
            h = (code[ok].astype(U) + U(n)) * U(0x9E3779B97F4A7C15) >> U(52)
            slot.append(row[ok] * DIM + h.astype(np.int64))
    return np.bincount(np.concatenate(slot), minlength=rows * DIM).reshape(rows, DIM) if len(x) else np.zeros((rows, DIM), np.int64)


def weigh(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(c > 0, np.log1p(c.astype(np.float32)), np.float32(0)) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents; counted in one pass over all texts."""

    def run(batches):
        seen, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, c in counts(b.column(0)):
                seen += (c > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1, dtype=np.int32)), pa.array(np.append(seen, n))], ["bucket", "n"])

    x = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIM + 1, np.int64)
    out[x.column("bucket").to_numpy()] = x.column("n").to_numpy()
    return out[:-1], int(out[-1])


@dataclass
class Centroids:
    idf: np.ndarray
    center: np.ndarray  # (centroids, DIM)
    radius: np.ndarray
    lang: list[str]


def spherical_means(v: np.ndarray, k: int, seed: int = SEED, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centers, member's center) by spherical k-means from farthest-first seeds."""
    k = min(k, len(v))
    at = [int(np.random.default_rng(seed).integers(len(v)))]
    for _ in range(k - 1):
        at.append(int(np.argmin((v @ v[at].T).max(axis=1))))
    c = v[at]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        for i in range(k):
            if (own == i).any():
                m = v[own == i].sum(axis=0)
                c[i] = m / max(np.linalg.norm(m), 1e-9)
    return c, (v @ c.T).argmax(axis=1)


def fit(texts: list[str], langs: list[str], df: np.ndarray, n: int, clusters: int = CLUSTERS, margin: float = MARGIN) -> Centroids | None:
    idf = (np.log((n + 1) / (df + 1)) + 1e-3).astype(np.float32)
    if not texts:
        return None
    v = np.concatenate([weigh(c, idf) for _, c in counts(pa.array(texts, pa.large_string()))])
    langs_, center, radius, names = np.array(langs), [], [], []
    # members nearer to another language's mean are taken for mislabelled and left out of the clusters
    every = sorted(set(langs))
    means = np.stack([v[langs_ == g].sum(axis=0) for g in every])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    langs_ = np.where(np.array(every)[(v @ means.T).argmax(axis=1)] == langs_, langs_, "")
    for lang in every:
        own = v[langs_ == lang]
        own = own[own.any(axis=1)]
        if not len(own):
            continue
        c, who = spherical_means(own, clusters)
        far = 1 - (own * c[who]).sum(axis=1)
        for i in range(len(c)):
            center.append(c[i])
            # the language's farthest member, as a cluster of few members has no radius of its own
            radius.append(min(0.999, margin * float(far.max())))
            names.append(lang)
    return Centroids(idf, np.array(center, np.float32), np.array(radius), names) if center else None


def sampled(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(id, lang, text) of at most `most` documents per language; the limit is applied inside each task first."""
    rows = docs.where("lang is not null and doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(F.col("doc_id").alias("__px_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("__px_d"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # at most `most` ids a language: a bounded broadcast
    got = texts.join(F.broadcast(ids), F.col("__px_d") == F.col("__px_id")).where("lang is not null and text is not null")
    return got.groupBy(F.col("__px_id").alias("id"), "lang").agg(F.min("text").alias("text"))


def fitted(docs: DataFrame, df: np.ndarray, n: int, most: int = SAMPLE) -> Centroids | None:
    """The centroids of the sample, made in one task: the driver gets them, 16 KB each, and no texts."""
    held = docs.sparkSession.sparkContext.broadcast((df, n))  # 32 KB

    def run(batches):
        rows = sorted((lang, i, t) for b in batches for i, lang, t in zip(*(b.column(k).to_pylist() for k in range(3))))
        model = fit([t for *_, t in rows], [lang for lang, *_ in rows], *held.value)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = sampled(docs, most).coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(got.model)) if got else None


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """(doc_id, predicted, score, rejected) of every row; score is the greatest cosine."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            for a, c in counts(b.column(1)):
                n = len(c)
                if m is None:
                    best, lang, bad = np.zeros(n), ["und"] * n, np.ones(n, bool)
                else:
                    cos = weigh(c, m.idf) @ m.center.T
                    i = cos.argmax(axis=1)
                    best = cos[np.arange(n), i].astype(float)
                    bad = (1 - best > m.radius[i]) | (c.sum(axis=1) < LEAST)
                    lang = ["und" if r else m.lang[j] for r, j in zip(bad, i)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, n), pa.array(lang, pa.string()), pa.array(best), pa.array(bad)], ["doc_id", "predicted", "score", "rejected"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(run, "doc_id long, predicted string, score double, rejected boolean")


def languages(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Fit on the table's own labels, then classify all of it."""
    df, n = document_frequencies(docs)
    return identify(docs, fitted(docs, df, n, most))
