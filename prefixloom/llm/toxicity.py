"""Operator 1: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token's vector is the sum of a word embedding and the mean of its character n-gram embeddings (hashed, word
boundaries marked), so unseen inflections of a known stem are read too. Two gated recurrent layers read windows of SPAN
tokens in both directions; attention pools their states into one score. Windows start every STRIDE tokens, half a span, and cover the whole text;
a document's score is its highest window's. Training is by weak labels: first windows bear their document's label, then in every round
the highest-scoring window of each document does, toxic or not. Words and n-grams of fewer than MIN_DOCS training documents have
no embedding, as they could only be learnt by heart.

The threshold is set on scores of documents that the scoring network hasn't seen: FOLDS networks, each trained without a part of the
sample, score that part. It lies where the share of toxic documents caught less FALSE_COST times the share of others flagged is
greatest, with at most MOST_FALSE of the others flagged, in the middle of the widest such gap. The last network is trained on the whole sample.

The classifier is fitted on a bounded sample of labelled rows: at most SAMPLE documents of each class, those with the least hash
of doc_id, whatever the size of the tables; the first pass draws FIRST_WINDOWS windows of each at random, the others score all of their
windows. Scoring covers every window of every document; the model has a fixed size.

Defined cases: texts without words, null or empty, score 0 and aren't toxic. Without labelled documents of both classes nothing is
toxic and every score is 0; with too few of them to hold any out the threshold is a probability of one half. A score at the threshold is toxic. Rows with a null doc_id are scored as any other; rows that repeat are scored
each, alike. Null labels are ignored; a document labelled both ways is toxic in training. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.llm import text
from prefixloom.llm.text import U

SAMPLE = 1200
SPAN = 32
STRIDE = 16
DIM = 16
HIDDEN = 12
BUCKETS = 1 << 14
GRAMS = (3, 5)
ROUNDS = 3
PASSES = 2
BATCH = 32
RATE = 0.05
FIRST_WINDOWS = 32
MIN_DOCS = 3
FOLDS = 4
FALSE_COST = 5.0
MOST_FALSE = 0.02
SEED = 7


@dataclass
class Network:
    """Weights, and the probability from which a document is toxic."""

    words: np.ndarray
    grams: np.ndarray
    w: np.ndarray  # (2, DIM, 3 HIDDEN)
    b: np.ndarray
    u: np.ndarray  # (2, HIDDEN, 3 HIDDEN)
    v: np.ndarray  # attention
    out: np.ndarray
    bias: np.ndarray
    threshold: float = 0.5


def fresh(seed: int = SEED) -> Network:
    r = np.random.default_rng(seed)
    n = lambda s, *d: (r.standard_normal(d) * s).astype(np.float32)
    return Network(n(0.1, BUCKETS, DIM), n(0.1, BUCKETS, DIM), n(0.25, 2, DIM, 3 * HIDDEN), np.zeros((2, 3 * HIDDEN), np.float32), n(0.25, 2, HIDDEN, 3 * HIDDEN), n(0.3, 2 * HIDDEN), n(0.3, 2 * HIDDEN), np.zeros(1, np.float32))


@dataclass
class Tokens:
    """Distinct words: word bucket, and the buckets of their n-grams with each word's first."""

    bucket: np.ndarray
    gram: np.ndarray
    first: np.ndarray


def tokens(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> Tokens:
    size = end - start + 2
    off = np.concatenate([[0], np.cumsum(size)])
    total = int(off[-1])
    flat = np.zeros(total + max(GRAMS), U)
    inner = np.ones(total, bool)
    inner[off[:-1]] = False
    inner[off[1:] - 1] = False
    source = np.arange(total) - np.repeat(off[:-1] - start + 1, size)
    flat[:total][inner] = text._LOWER[data[source[inner]]]
    flat[off[:-1]] = 1
    flat[off[1:] - 1] = 2
    owner = np.repeat(np.arange(len(size)), size)
    left = np.repeat(off[1:], size) - np.arange(total)
    every, who = [], []
    for n in GRAMS:
        code = np.full(total, U(n))
        for j in range(n):
            code = code * U(0x100000001B3) + flat[j : j + total]
        ok = left >= n
        every.append(text.mix(code[ok]))
        who.append(owner[ok])
    gram, who = np.concatenate(every), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return Tokens((hashes >> U(50)).astype(np.int32), (gram[order] >> U(50)).astype(np.int32), np.searchsorted(who[order], np.arange(len(size) + 1)))


def vectors(net: Network, t: Tokens) -> np.ndarray:
    x = np.empty((len(t.bucket), DIM), np.float32)
    for i in range(0, len(x), 8192):
        first = t.first[i : i + 8193]
        s = np.add.reduceat(net.grams[t.gram[first[0] : first[-1]]], first[:-1] - first[0], axis=0)
        x[i : i + 8192] = net.words[t.bucket[i : i + 8192]] + s / np.diff(first)[:, None].astype(np.float32)
    return x


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start token, row) of every window of rows given by their first tokens."""
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(1, -(-(n - SPAN) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(n)), many)
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return first[:-1][row] + k * STRIDE, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.maximum(x, -80, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _projected(net: Network, x: np.ndarray, d: int) -> np.ndarray:
    """Inputs to the gates of each distinct token; one more row, for padding, leaves the state as it is."""
    p = np.empty((len(x) + 1, 3 * HIDDEN), np.float32)
    p[:-1] = x @ net.w[d] + net.b[d]
    p[-1] = 0
    p[-1, :HIDDEN] = 40
    return p


def forward(net: Network, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]:
    """(logits, states, trace, attention, pooled states) of windows ids (windows, SPAN) over distinct token vectors x; id len(x) is padding."""
    n, h_ = len(ids), HIDDEN
    states = np.empty((SPAN, n, 2 * h_), np.float32)
    trace: list = [[None] * SPAN, [None] * SPAN]
    turned = np.ascontiguousarray(ids.T)
    for d in (0, 1):
        p, u = _projected(net, x, d), net.u[d]
        h = np.zeros((n, h_), np.float32)
        for s in range(SPAN):
            t = s if d == 0 else SPAN - 1 - s
            g, gh = p.take(turned[t], axis=0), h @ u
            zr, c = g[:, : 2 * h_], g[:, 2 * h_ :]
            zr += gh[:, : 2 * h_]
            _sigmoid(zr)
            z, r, gn = zr[:, :h_], zr[:, h_:], gh[:, 2 * h_ :]
            c += r * gn
            np.tanh(c, out=c)
            trace[d][t] = (h, z, r, c, gn)
            h = c + z * (h - c)
            states[t, :, d * h_ : (d + 1) * h_] = h
    a = states @ net.v
    a[(ids == len(x)).T] = -1e9
    a -= a.max(axis=0)
    np.exp(a, out=a)
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return pooled @ net.out + net.bias[0], states, trace, a, pooled


def logits(net: Network, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The logits of forward() alone. Attention and output are linear in the states, so of each state only its two products are kept;
    they come out of the next step's multiplication. A sigmoid is a hyperbolic tangent of half its argument."""
    n, h_ = len(ids), HIDDEN
    turned = np.ascontiguousarray(ids.T)
    a, o = np.zeros((SPAN, n), np.float32), np.zeros((SPAN, n), np.float32)
    for d in (0, 1):
        own = slice(d * h_, (d + 1) * h_)
        p = _projected(net, x, d)
        p[:, : 2 * h_] *= 0.5
        u = np.concatenate([net.u[d], net.v[own, None], net.out[own, None]], axis=1)
        u[:, : 2 * h_] *= 0.5
        h = np.zeros((n, h_), np.float32)
        before = -1
        for s in range(SPAN + 1):
            gh = h @ u
            if before >= 0:
                a[before] += gh[:, 3 * h_]
                o[before] += gh[:, 3 * h_ + 1]
            if s == SPAN:
                break
            before = s if d == 0 else SPAN - 1 - s
            g = p.take(turned[before], axis=0)
            zr, c = g[:, : 2 * h_], g[:, 2 * h_ :]
            zr += gh[:, : 2 * h_]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c += zr[:, h_:] * gh[:, 2 * h_ : 3 * h_]
            np.tanh(c, out=c)
            h -= c
            h *= zr[:, :h_]
            h += c
    a[turned == len(x)] = -1e9
    a -= a.max(axis=0)
    np.exp(a, out=a)
    return (a * o).sum(axis=0) / a.sum(axis=0) + net.bias[0]


def gradients(net: Network, t: Tokens, x: np.ndarray, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients by back-propagation through time."""
    logit, states, trace, a, pooled = forward(net, x, ids)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = float(-(weight * (label * np.log(p + 1e-9) + (1 - label) * np.log(1 - p + 1e-9))).sum() / weight.sum())
    dl = ((p - label) * weight / weight.sum()).astype(np.float32)
    g = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True)}
    dpool = dl[:, None] * net.out
    da = np.einsum("nh,tnh->tn", dpool, states)
    ds = a * (da - (a * da).sum(axis=0))
    g["v"] = np.einsum("tn,tnh->h", ds, states)
    dstate = a[:, :, None] * dpool[None] + ds[:, :, None] * net.v
    h_ = HIDDEN
    dx = np.zeros_like(x)
    g["w"], g["b"], g["u"] = np.zeros_like(net.w), np.zeros_like(net.b), np.zeros_like(net.u)
    for d in (0, 1):
        dh = np.zeros((len(ids), h_), np.float32)
        dp = np.zeros((len(x) + 1, 3 * h_), np.float32)
        for s in reversed(range(SPAN)):
            t_ = s if d == 0 else SPAN - 1 - s
            h, z, r, c, gn = trace[d][t_]
            dh = dh + dstate[t_, :, d * h_ : (d + 1) * h_]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], axis=1)
            dgh = np.concatenate([dz, dr, dc * r], axis=1)
            g["u"][d] += h.T @ dgh
            np.add.at(dp, ids[:, t_], dg)
            dh = dh * z + dgh @ net.u[d].T
        dp = dp[:-1]
        g["w"][d], g["b"][d] = x.T @ dp, dp.sum(axis=0)
        dx += dp @ net.w[d].T
    g["words"], g["grams"] = (t.bucket, dx), (t.gram, np.repeat(dx / np.diff(t.first)[:, None].astype(np.float32), np.diff(t.first), axis=0))
    return loss, g


class _Adagrad:
    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate = net, rate
        self.sums = {k: np.full_like(getattr(net, k), 1e-6) for k in ("words", "grams", "w", "b", "u", "v", "out", "bias")}

    def step(self, grads: dict) -> None:
        for k, g in grads.items():
            p, s = getattr(self.net, k), self.sums[k]
            if isinstance(g, tuple):
                at, inverse = np.unique(g[0], return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                starts = np.searchsorted(inverse[order], np.arange(len(at)))
                own = np.add.reduceat(g[1][order], starts, axis=0)
                s[at] += own * own
                p[at] -= self.rate * own / np.sqrt(s[at])
            else:
                s += g * g
                p -= (self.rate * g / np.sqrt(s)).astype(p.dtype)


def _select(t: Tokens, at: np.ndarray) -> Tokens:
    size = np.diff(t.first)[at]
    off = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(int(off[-1])) + np.repeat(t.first[:-1][at] - off[:-1], size)
    return Tokens(t.bucket[at], t.gram[index], off)


def _cut(texts: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray, int]:
    """Distinct tokens of texts, windows of their ids (padded), each window's text, number of texts. Arrays are filled part by part, to keep peaks low."""
    raw, offsets = text.buffers(texts)
    hashes, begins, ends, first = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for w in text.words(texts, 1 << 18):
        base = offsets[w.row0]
        hashes.append(w.hash)
        begins.append(w.start + base)
        ends.append(w.end + base)
        first.append(w.first[1:] + first[-1][-1])
    hashes, begins, ends, first = map(np.concatenate, (hashes, begins, ends, first))
    distinct, where, ids = np.unique(hashes, return_index=True, return_inverse=True)
    padded = np.append(ids, np.full(SPAN, len(distinct))).astype(np.int32)
    del hashes, ids
    begins, ends = begins[where], ends[where]
    parts = [tokens(raw, begins[i : i + 8192], ends[i : i + 8192], distinct[i : i + 8192]) for i in range(0, len(distinct), 8192)]
    size = np.concatenate([np.zeros(1, np.int64), *[np.diff(t.first) for t in parts]])
    none = np.zeros(0, np.int32)
    t = Tokens(np.concatenate([none, *[x.bucket for x in parts]]), np.concatenate([none, *[x.gram for x in parts]]), np.cumsum(size))
    start, row = windows(first)
    last, out = first[1:][row], np.empty((len(start), SPAN), np.int32)
    for i in range(0, len(start), 8192):
        index = start[i : i + 8192, None] + np.arange(SPAN)
        out[i : i + 8192] = np.where(index < last[i : i + 8192, None], padded[np.minimum(index, len(padded) - 1)], len(distinct))
    return t, out, row, len(offsets) - 1


@dataclass
class Cut:
    """Texts cut into windows: distinct tokens, token ids of each window (padded), each window's text, number of texts."""

    tokens: Tokens
    ids: np.ndarray
    row: np.ndarray
    n: int


def _rare(cut: Cut, windows_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which word and which n-gram buckets occur in fewer than MIN_DOCS texts of these windows, which come text by text."""
    t, row = cut.tokens, cut.row[windows_]
    words, grams = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    heads = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) if len(row) else np.zeros(1, np.int64)
    for lo, hi in zip(heads[:-1], heads[1:]):
        own = np.unique(cut.ids[windows_[lo:hi]])
        own = _select(t, own[own < len(t.bucket)])
        words[np.unique(own.bucket)] += 1
        grams[np.unique(own.gram)] += 1
    return words < MIN_DOCS, grams < MIN_DOCS


def learn(cut: Cut, label: np.ndarray, mine: np.ndarray, seed: int = SEED) -> Network:
    """A network trained on the texts in mine."""
    t, ids, row = cut.tokens, cut.ids, cut.row
    rng, net = np.random.default_rng(seed), fresh(seed)
    own = np.flatnonzero(mine[row])
    no_word, no_gram = _rare(cut, own)
    net.words[no_word] = 0
    net.grams[no_gram] = 0
    fit_ = _Adagrad(net)

    def once(every: np.ndarray) -> None:
        """A pass over these windows, both classes of the same weight."""
        good = ~label[row[every]]
        heavy = good.sum() / max((~good).sum(), 1)
        for i in range(0, len(every), BATCH):
            part = every[i : i + BATCH]
            at, inverse = np.unique(ids[part], return_inverse=True)
            some = _select(t, at[at < len(t.bucket)])
            y = label[row[part]]
            _, g = gradients(net, some, vectors(net, some), inverse.reshape(len(part), SPAN), y.astype(np.float32), np.where(y, heavy, 1.0).astype(np.float32))
            for name, rare in (("words", no_word), ("grams", no_gram)):
                at, dx = g[name]
                g[name] = at, np.where(rare[at][:, None], 0, dx)
            fit_.step(g)

    order = own[np.lexsort((rng.random(len(own)), row[own]))]
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    once(rng.permutation(order[rank < FIRST_WINDOWS]))
    for _ in range(ROUNDS):
        order = own[np.lexsort((-score_windows(net, t, ids[own]), row[own]))]
        top = order[np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))]
        for _ in range(PASSES):
            once(rng.permutation(top))
    return net


def _best(net: Network, cut: Cut, mine: np.ndarray) -> np.ndarray:
    """The highest window's score of the texts in mine; the least there is for texts without a window."""
    own = np.flatnonzero(mine[cut.row])
    best = np.full(cut.n, -30.0)
    np.maximum.at(best, cut.row[own], score_windows(net, cut.tokens, cut.ids[own]))
    return best[mine]


def folds(label: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Each text's part, of FOLDS; the classes are spread evenly."""
    rng, out = np.random.default_rng(seed), np.zeros(len(label), np.int64)
    for side in (True, False):
        own = rng.permutation(np.flatnonzero(label == side))
        out[own] = np.arange(len(own)) % FOLDS
    return out


def _step(cut: Cut, label: np.ndarray, k: int, seed: int) -> tuple[Network | None, np.ndarray, np.ndarray]:
    """(None, scores, labels) of part k by a network trained on the others; for k = FOLDS the network trained on all."""
    part = folds(label, seed)
    if k == FOLDS:
        return learn(cut, label, np.ones(cut.n, bool), seed), np.zeros(0), np.zeros(0, bool)
    if len(set(label[cut.row[part[cut.row] != k]])) < 2:
        return None, np.zeros(0), np.zeros(0, bool)
    return None, _best(learn(cut, label, part != k, seed), cut, part == k), label[part == k]


def _sorted_out(texts: list[str], toxic: list[bool]) -> tuple[Cut, np.ndarray] | None:
    """The texts cut up and their labels; None if a class is missing, or words are."""
    label = np.array(toxic, bool)
    if label.all() or not label.any():
        return None
    cut = Cut(*_cut(pa.array([t or "" for t in texts], pa.large_string())))
    return (cut, label) if len(cut.ids) else None


def _finished(parts: list[tuple[Network | None, np.ndarray, np.ndarray]]) -> Network:
    net = next(n for n, *_ in parts if n is not None)
    score, label = np.concatenate([s for _, s, _ in parts]), np.concatenate([y for *_, y in parts])
    net.threshold = _threshold(score, label) if len(set(label)) > 1 else 0.0
    return net


def train(texts: list[str], toxic: list[bool], seed: int = SEED) -> Network | None:
    """A network, or None without both classes; what fit() does, in one process."""
    if (got := _sorted_out(texts, toxic)) is None:
        return None
    return _finished([_step(*got, k, seed) for k in range(FOLDS + 1)])


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The logit with the most caught less FALSE_COST times the falsely flagged, in the middle of the widest such gap."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order]
    # the first i are left alone
    false = 1 - np.append(0, np.cumsum(~y)) / max((~y).sum(), 1)
    gain = 1 - np.append(0, np.cumsum(y)) / max(y.sum(), 1) - FALSE_COST * false
    gain[false > MOST_FALSE] = -np.inf
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    top = np.flatnonzero(gain >= gain.max() - 1e-12)
    i = top[int(np.argmax(edges[top + 1] - edges[top]))]
    return float((edges[i] + edges[i + 1]) / 2)


def score_windows(net: Network, t: Tokens, ids: np.ndarray, at_once: int = 2048) -> np.ndarray:
    x = vectors(net, t)
    return np.concatenate([logits(net, x, ids[i : i + at_once]) for i in range(0, len(ids), at_once)] or [np.zeros(0, np.float32)])


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(id, toxic, text) of at most `most` documents of each class, those with the least hash of doc_id."""
    per = labels.select(F.col("doc_id").cast("long").alias("__px_id"), (F.col("toxic") != 0).alias("__px_toxic")).where("__px_id is not null and __px_toxic is not null")
    per = per.groupBy("__px_id").agg(F.max("__px_toxic").alias("__px_toxic"))
    order = F.xxhash64("__px_id")
    per = per.where("__px_toxic").orderBy(order, "__px_id").limit(most).union(per.where("not __px_toxic").orderBy(order, "__px_id").limit(most))
    rows = docs.select(F.col("doc_id").cast("long").alias("__px_d"), F.col("text").cast("string").alias("text")).where("text is not null")
    # at most 2 * most ids: a bounded broadcast
    got = rows.join(F.broadcast(per), F.col("__px_d") == F.col("__px_id")).groupBy("__px_id", "__px_toxic").agg(F.min("text").alias("text"))
    return got.select(F.col("__px_id").alias("id"), F.col("__px_toxic").alias("toxic"), "text")


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[bool]]:
    got = sampled(docs, labels, most).toArrow().sort_by("id")
    return got.column("text").to_pylist(), got.column("toxic").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, seed: int = SEED) -> Network | None:
    """The network of the sample. Each part of the work, the networks for the threshold and the last, is a task; the driver gets
    2,400 scores at most and the weights, 2 MB, and no texts."""
    rows = sampled(docs, labels, most).select("id", "toxic", "text", F.explode(F.array(*[F.lit(k) for k in range(FOLDS + 1)])).alias("k"))

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for i, toxic, x, k in zip(*(b.column(c).to_pylist() for c in range(4))):
                held.setdefault(k, []).append((i, toxic, x))
        for k, own in held.items():
            own.sort()
            got = _sorted_out([x for *_, x in own], [toxic for _, toxic, _ in own])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got and _step(*got, k, seed))], pa.binary())], ["part"])

    # this number of partitions parts the values of k
    parts = [pickle.loads(bytes(x.part)) for x in rows.repartition(11, "k").mapInArrow(run, "part binary").collect()]
    return _finished(parts) if parts and all(parts) else None


def _scorer(docs: DataFrame, net: Network | None):
    held = docs.sparkSession.sparkContext.broadcast(net)

    def scored(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of windows) of each text; the score is a probability moved so that 0.5 is the threshold."""
        score, many = np.zeros(len(column)), np.zeros(len(column), np.int32)
        net = held.value
        for w in text.words(column):
            distinct, where, ids = np.unique(w.hash, return_index=True, return_inverse=True)
            if not len(distinct):
                continue
            start, row = windows(w.first)
            many[w.row0 : w.row1] = np.bincount(row, minlength=w.row1 - w.row0)
            if net is None:
                continue
            x = vectors(net, tokens(w.data, w.start[where], w.end[where], distinct))
            best = np.full(w.row1 - w.row0, -np.inf)
            last = w.first[1:][row]
            for i in range(0, len(start), 2048):
                index = start[i : i + 2048, None] + np.arange(SPAN)
                own = np.where(index < last[i : i + 2048, None], ids[np.minimum(index, len(ids) - 1)], len(distinct))
                np.maximum.at(best, row[i : i + 2048], logits(net, x, own).astype(float))
            score[w.row0 : w.row1] = np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best - net.threshold, -30, 30))), 0)
        return score, many

    return scored


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score, n_windows, toxic) of every row."""
    scored = _scorer(docs, net)

    def run(batches):
        for b in batches:
            s, many = scored(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(many), pa.array(s >= 0.5)], ["doc_id", "score", "n_windows", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_windows int, toxic boolean")


def is_toxic(docs: DataFrame, net: Network | None) -> Column:
    """A boolean column over docs' text, for filters that keep whole rows."""
    scored = _scorer(docs, net)

    @F.pandas_udf("boolean")
    def flag(t: pd.Series) -> pd.Series:
        return pd.Series(scored(pa.array(t, pa.large_string()))[0] >= 0.5)

    return flag(F.col("text").cast("string"))


def reject(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs without the toxic ones."""
    return docs.where(~is_toxic(docs, fit(docs, labels, most)))
