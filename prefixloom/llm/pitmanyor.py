"""Operator 7: language-model scoring by a hierarchical Pitman-Yor model of byte sequences.

Every context of up to ORDER - 1 bytes is a Chinese restaurant; the restaurant of a context less its earliest byte is its parent, and
each table a customer opens sends a customer there, down to the empty context, whose parent is uniform. Seating is sampled by Gibbs
sweeps: all customers of a dish are seated anew, one after another, given the rest of the restaurant and the parent's predictive
probability as it was before the sweep; a new table is opened with odds (strength + discount * tables) * parent : customers - discount * own
tables. A restaurant's dishes take their turns in BLOCKS rounds; of more dishes than that, those of one round see each other as they were.

One rule seats customers at every size: they come in blocks of a sixteenth of those seated, at least one, and the number of tables a block
opens is that of as many independent draws with the odds at its middle. A block of one is a draw of its own, so up to 32 customers nothing is approximated.

Each context length has one discount and one strength, sampled by griddy Gibbs: after every round of sweeps their joint likelihood, given how
customers came to sit, is summed over all restaurants on a grid, and a point of it is drawn. Predictive probabilities are averaged over SAMPLES sweeps.

Counts are taken over all bytes of all documents, without a bound on distinct n-grams, and added up before they meet. Restaurants are distributed by
the last two bytes of their context, so that a context and its parents down to length 2 share a task, at most 2^24 n-grams; the contexts of one byte and none,
256 * 256 dishes whatever the corpus, are sampled between ROUNDS on the driver. Random numbers are hashes of dish, sweep and step: the result
doesn't depend on partitioning and a lost task repeats itself.

A document is scored in one scan while the model has at most MOST_MODEL rows (it is then broadcast, 21 bytes a row), else each block
of BLOCK bytes of text gets the part of the model that it needs. Unseen n-grams are scored by the parents' probabilities.

Defined cases: a text starts in the context of NUL bytes. Null and empty texts have 0 bytes, 0 bits and no perplexity. Rows that repeat are
counted and scored each; null doc_ids too. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.llm import text
from prefixloom.llm.shared import grouped, materialise
from prefixloom.llm.text import U, mix

ORDER = 5
#: By context length, at first.
DISCOUNT = (0.2, 0.4, 0.6, 0.7, 0.8)
STRENGTH = (1.0, 1.0, 0.5, 0.5, 0.5)
GRID_D = np.arange(1, 20) / 20
GRID_S = np.array([0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0])
ROUNDS = 3
BURN = 2
SAMPLES = 4
BLOCKS = 8
MOST_MODEL = 4_000_000
HELD = 4_000_000
ROWS_AT_ONCE = 400_000
BLOCK = 1 << 24
_GOLD = U(0x9E3779B97F4A7C15)


def grams(column: pa.Array):
    """(first row, rows, each byte's packed n-gram, each row's first) of slices of the column."""
    raw, offsets = text.buffers(column)
    for a, b in text.spans(offsets, 1 << 20):
        off = offsets[a : b + 1] - offsets[a]
        n, pad = int(off[-1]), ORDER - 1
        at = np.arange(n) + np.repeat(np.arange(1, b - a + 1) * pad, np.diff(off))
        wide = np.zeros(n + pad * (b - a), np.int64)
        wide[at] = raw[offsets[a] : offsets[b]]
        g = wide.copy()
        for k in range(1, ORDER):
            g[k:] |= wide[:-k] << (8 * k)
        yield a, b, g[at], off


def _merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def counts(docs: DataFrame) -> DataFrame:
    """(suffix, gram, c) of the whole corpus; suffix is the last two bytes of the context."""

    def run(batches):
        keys, own, n = [], [], 0

        def out(k, c):
            for i in range(0, len(k), 1 << 18):
                s = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(k[s]), pa.array(c[s])], ["gram", "c"])

        for b in batches:
            for _, _, g, _ in grams(b.column(0)):
                g.sort()
                at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
                keys.append(g[at])
                own.append(np.diff(np.append(at, len(g))))
                n += len(at)
                if n > HELD:
                    k, c = _merged(keys, own)
                    if len(k) > HELD // 2:
                        yield from out(k, c)
                        k, c = k[:0], c[:0]
                    keys, own, n = [k], [c], len(k)
        if keys:
            yield from out(*_merged(keys, own))

    x = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "gram long, c long")
    # the engine adds up what the tasks of a stage bring before it is sent
    return x.groupBy("gram").agg(F.sum("c").alias("c")).select(F.expr("cast(shiftright(gram, 8) & 65535 as int)").alias("suffix"), "gram", "c")


def _uniform(key: np.ndarray, salt: int, step: int) -> np.ndarray:
    h = mix(key ^ U((salt * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _normal(u: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal, by a rational approximation good to 1e-4."""
    low = np.minimum(u, 1 - u)
    t = np.sqrt(-2 * np.log(low))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return np.where(u < 0.5, -z, z)


def _binomial(n: np.ndarray, q: np.ndarray, key: np.ndarray, salt: int, step: int) -> np.ndarray:
    """How many of n draws of odds q succeed: by the distribution for means below 6, else by a normal of the same mean and variance, rounded at random."""
    u, mean = _uniform(key, salt, 2 * step), n * q
    out = np.zeros(len(n))
    low = np.flatnonzero(mean < 6)
    m, x, v = n[low], np.minimum(q[low], 1 - 1e-12), u[low]
    p = (1 - x) ** m
    total, ratio = p.copy(), x / (1 - x)
    for i in range(1, int(min(m.max(initial=0), 40)) + 1):
        on = v >= total
        if not on.any():
            break
        out[low] += on
        p *= ratio * np.maximum(m - i + 1, 0) / i
        total += p
    high = np.flatnonzero(mean >= 6)
    mean, part = mean[high], mean[high] % 1
    spread = np.sqrt(np.maximum(mean * (1 - q[high]) - part * (1 - part), 0))
    out[high] = np.floor(mean + u[high] + spread * _normal(_uniform(key[high], salt, 2 * step + 1)))
    return np.clip(out, 0, n)


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive arguments: Stirling's series eight steps up."""
    y = x + 8
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y - np.log(low)


def seat(key: np.ndarray, c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, s: float, salt: int, fit: np.ndarray | None = None) -> np.ndarray:
    """Tables of each dish after seating its c customers anew; others: tables of other dishes in its restaurant.

    fit, if given, has the log-likelihood of joining tables that were there, for every discount of GRID_D, added to it.
    """
    out = np.minimum(c, 1)
    live = np.flatnonzero(c > 1)
    key = key.astype(U)
    j, step = 1, 0
    k, left, now, rest, p = key[live], c[live], np.ones(len(live)), others[live].astype(float), parent[live]
    while len(live):
        block = max(1, j // 16)
        size = np.minimum(block, left - j).astype(float)
        # odds at the middle of the block, where about half of its tables are open
        a = (s + d * (rest + now)) * p
        middle = j + (size - 1) / 2
        q = a / (a + middle - d * now)
        if block > 1:
            then = now + (size - 1) / 2 * q
            a = (s + d * (rest + then)) * p
            q = a / (a + middle - d * then)
        new = _binomial(size, q, k, salt, step)
        if fit is not None:
            old = size - new
            own = old > 0
            tables = (now + new / 2 if block > 1 else now)[own]
            for i, e in enumerate(GRID_D):
                x = j - e * tables
                # of a block, the share that opens no table
                fit[i] += (np.log(x) if block == 1 else (lgamma(x + size[own]) - lgamma(x)) * old[own] / size[own]).sum()
        now = now + new
        j += block
        step += 1
        on = left > j
        if not on.all():
            out[live[~on]] = now[~on]
            live, k, left, now, rest, p = live[on], k[on], left[on], now[on], rest[on], p[on]
    return out


class Restaurants:
    """The restaurants of one context length: dishes sorted by packed context and byte."""

    def __init__(self, key: np.ndarray, length: int, hyper: np.ndarray):
        self.key, self.length = key, length
        self.rest, self.of = np.unique(key >> 8, return_inverse=True)
        self.c = np.zeros(len(key), np.int64)
        self.t = np.zeros(len(key), np.int64)
        self.d, self.s = hyper[length]

    def per(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, x, len(self.rest))

    def sample(self, c: np.ndarray, parent: np.ndarray, salt: int, fit: np.ndarray | None = None) -> None:
        """A sweep: the dishes of several customers take turns, BLOCKS of them at least."""
        self.c = c
        self.t = np.where(c > 1, np.clip(self.t, 1, c), np.minimum(c, 1))
        total = self.per(self.t)
        live = np.flatnonzero(c > 1)
        of = self.of[live]
        turn = (np.arange(len(live)) - np.searchsorted(of, of)) % BLOCKS
        for b in range(min(BLOCKS, int(turn.max(initial=-1)) + 1)):
            at = live[turn == b]
            new = seat(self.key[at], c[at], total[self.of[at]] - self.t[at], parent[at], self.d, self.s, salt * 16 + self.length, fit)
            total += np.bincount(self.of[at], new - self.t[at], len(total))
            self.t[at] = new

    def fits(self, joined: np.ndarray) -> np.ndarray:
        """Log-likelihood of the seating over GRID_D and GRID_S, but for what doesn't depend on them; joined: what seat() noted."""
        tables, customers = self.per(self.t), self.per(self.c)
        on = customers > 0
        tables, customers = tables[on], customers[on]
        out = np.repeat(joined[:, None], len(GRID_S), axis=1)
        for y, s in enumerate(GRID_S):
            least = (lgamma(s + customers) - lgamma(np.array(s + 1))).sum()
            for x, d in enumerate(GRID_D):
                out[x, y] += ((tables - 1) * np.log(d) + lgamma(s / d + tables) - lgamma(np.array(s / d + 1))).sum() - least
        return out

    def backoff(self) -> np.ndarray:
        return (self.s + self.d * self.per(self.t)) / (self.s + self.per(self.c))

    def predict(self, parent: np.ndarray) -> np.ndarray:
        return (self.c - self.d * self.t) / (self.s + self.per(self.c))[self.of] + self.backoff()[self.of] * parent


def subtrees(key: np.ndarray, c: np.ndarray, one: np.ndarray, sweeps: int, samples: int, salt: int, hyper: np.ndarray, fit: bool = False):
    """Gibbs sampling of contexts of length 4, 3 and 2, given the predictive probabilities `one` of (byte, next byte).

    (levels, mean predictive probabilities by level, mean back-off weights by level, likelihoods by level), longest first.
    """
    levels, links = [Restaurants(key, ORDER - 1, hyper)], []
    for length in range(ORDER - 2, 1, -1):
        low, link = np.unique(levels[-1].key & ((1 << 8 * (length + 1)) - 1), return_inverse=True)
        levels.append(Restaurants(low, length, hyper))
        links.append(link)
    base = one[levels[-1].key & 0xFFFF]
    top = c
    for i, x in enumerate(levels):
        x.c, x.t = top, np.minimum(top, 1)
        if i < len(links):
            top = np.bincount(links[i], x.t, len(levels[i + 1].key)).astype(np.int64)
    p_sum, w_sum = [np.zeros(len(x.key)) for x in levels], [np.zeros(len(x.rest)) for x in levels]
    fits = []

    def parents() -> list[np.ndarray]:
        down, p = [base], base
        for x, link in zip(reversed(levels[1:]), reversed(links)):
            p = x.predict(p)[link]
            down.append(p)
        return down[::-1]

    for sweep in range(sweeps + samples):
        top, p = c, parents()
        for i, x in enumerate(levels):
            joined = np.zeros(len(GRID_D)) if fit and sweep == sweeps + samples - 1 else None
            x.sample(top, p[i], salt + sweep, joined)
            if joined is not None:
                fits.append(x.fits(joined))
            if i < len(links):
                top = np.bincount(links[i], x.t, len(levels[i + 1].key)).astype(np.int64)
        if sweep >= sweeps:
            for i, (x, q) in enumerate(zip(levels, parents())):
                p_sum[i] += x.predict(q) / samples
                w_sum[i] += x.backoff() / samples
    return levels, p_sum, w_sum, fits


def short_contexts(tables: np.ndarray, salt: int, hyper: np.ndarray, sweeps: int = BURN + SAMPLES) -> tuple[np.ndarray, list[np.ndarray]]:
    """(predictive probabilities (256 * 256) of contexts of one byte, likelihoods of lengths 1 and 0), given the customers that longer ones send.

    The probabilities are the mean of the later sweeps.
    """
    key = np.arange(1 << 16)
    x, root = Restaurants(key, 1, hyper), Restaurants(np.arange(256), 0, hyper)
    x.c, x.t = tables, np.minimum(tables, 1)
    out, kept, flat = np.zeros(1 << 16), 0, np.full(256, 1 / 256)
    for sweep in range(sweeps):
        joined = [np.zeros(len(GRID_D)) if sweep == sweeps - 1 else None for _ in range(2)]
        root.sample(np.bincount(key & 255, x.t, 256).astype(np.int64), flat, salt + sweep, joined[1])
        p0 = root.predict(flat)
        x.sample(tables, p0[key & 255], salt + sweep, joined[0])
        if sweep >= sweeps // 2:
            out, kept = out + x.predict(p0[key & 255]), kept + 1
    return out / max(kept, 1), [x.fits(joined[0]), root.fits(joined[1])]


def drawn(fits: list[np.ndarray], salt: int) -> np.ndarray:
    """(discount, strength) of each length, drawn from its likelihoods on the grid."""
    out = []
    for length, f in enumerate(fits):
        w = np.exp(f - f.max()).ravel()
        u = float(_uniform(np.array([length], U), salt, 0)[0])
        i = int(np.searchsorted(np.cumsum(w) / w.sum(), u))
        out.append((GRID_D[i // len(GRID_S)], GRID_S[i % len(GRID_S)]))
    return np.array(out)


_MODEL = "n int, weight boolean, key long, value float"


def train(docs: DataFrame, rounds: int = ROUNDS, burn: int = BURN, samples: int = SAMPLES, hyper: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """The model: (n, weight, key, value), probabilities of n-grams and back-off weights of contexts of n bytes, and those of byte pairs.

    Discounts and strengths, by length, are sampled unless given.
    """
    spark = docs.sparkSession
    c = materialise(counts(docs).repartition("suffix").sortWithinPartitions("suffix", "gram"), "grams")
    one, fixed = np.full(1 << 16, 1 / 256), hyper is not None
    hyper = np.array(hyper) if fixed else np.stack([DISCOUNT, STRENGTH], axis=1)
    for r in range(rounds):
        held = spark.sparkContext.broadcast((one, hyper))  # 512 KB, whatever the corpus

        def send(t: pa.Table, r=r, held=held) -> pa.Table:
            levels, _, _, fits = subtrees(t.column("gram").to_numpy(), t.column("c").to_numpy(), held.value[0], burn, 0, 1000 * r, held.value[1], not fixed)
            low = np.bincount(levels[-1].key & 0xFFFF, levels[-1].t, 1 << 16).astype(np.int64)
            at = np.flatnonzero(low)
            # likelihoods come under numbers from 2^16 on: length, then cell of the grid
            cell = [(1 << 16) + (ORDER - 1 - i) * 1024 + np.arange(f.size) for i, f in enumerate(fits)]
            return pa.table({"pair": np.concatenate([at, *cell]).astype(np.int32), "n": np.concatenate([low[at].astype(float), *[f.ravel() for f in fits]])})

        got = grouped(c, ["suffix"], ["gram"], send, "pair int, n double", ROWS_AT_ONCE).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        pair, n = got.column("pair").to_numpy(), got.column("n").to_numpy()
        tables = np.zeros(1 << 16, np.int64)
        tables[pair[pair < 1 << 16]] = np.round(n[pair < 1 << 16]).astype(np.int64)
        one, short = short_contexts(tables, 1000 * r, hyper)
        if not fixed and len(pair):
            fits = [short[1], short[0]]
            for length in range(2, ORDER):
                f = np.zeros(len(GRID_D) * len(GRID_S))
                at = (pair >> 10) == 64 + length
                f[pair[at] & 1023] = n[at]
                fits.append(f.reshape(len(GRID_D), len(GRID_S)))
            hyper = drawn(fits, 1000 * r)
    held = spark.sparkContext.broadcast((one, hyper))

    def final(t: pa.Table) -> pa.Table:
        levels, p, w, _ = subtrees(t.column("gram").to_numpy(), t.column("c").to_numpy(), held.value[0], burn, samples, 1000 * rounds, held.value[1])
        rows = [(x.length + 1, False, x.key, v) for x, v in zip(levels, p)] + [(x.length, True, x.rest, v) for x, v in zip(levels, w)]
        return pa.table({"n": np.concatenate([np.full(len(k), n, np.int32) for n, _, k, _ in rows]), "weight": np.concatenate([np.full(len(k), f) for _, f, k, _ in rows]), "key": np.concatenate([k for _, _, k, _ in rows]), "value": np.concatenate([v for *_, v in rows]).astype(np.float32)})

    return materialise(grouped(c, ["suffix"], ["gram"], final, _MODEL, ROWS_AT_ONCE), "model"), one


class Lookup:
    """A hash table from integers to floats with vectorised probing."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(4, int(2 * len(key)).bit_length())
        self.mask = (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        slot = self.home(key)
        while len(key):
            free = np.flatnonzero(self.key[slot] == -1)
            self.key[slot[free]] = key[free]
            mine = self.key[slot] == key
            self.value[slot[mine]] = value[mine]
            key, value, slot = key[~mine], value[~mine], (slot[~mine] + 1) & self.mask

    def home(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(U) * _GOLD
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        return (h >> U(32)).astype(np.int64) & self.mask

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        slot = self.home(key)
        have = self.key[slot]
        out = np.where(have == key, self.value[slot], np.float32(np.nan))
        todo = np.flatnonzero((have != key) & (have != -1))
        slot, key = slot[todo], key[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            have = self.key[slot]
            hit = have == key
            out[todo[hit]] = self.value[slot[hit]]
            on = ~hit & (have != -1)
            todo, slot, key = todo[on], slot[on], key[on]
        return out


def bits(model: dict, g: np.ndarray) -> np.ndarray:
    """-log2 of the probability of each n-gram's last byte."""
    p = model["p", ORDER].get(g).astype(np.float64)
    todo = np.flatnonzero(np.isnan(p))
    w = np.ones(len(todo))
    for n in range(ORDER - 1, 1, -1):
        if not len(todo):
            break
        # the context of n bytes may be new as well: it then leaves all to its parent
        w *= np.nan_to_num(model["w", n].get(g[todo] >> 8 & ((1 << 8 * n) - 1)), nan=1.0)
        low = g[todo] & ((1 << 8 * n) - 1)
        q = model["p", n].get(low).astype(np.float64) if n > 2 else model["one"][low & 0xFFFF]
        hit = ~np.isnan(q)
        p[todo[hit]] = w[hit] * q[hit]
        todo, w = todo[~hit], w[~hit]
    return -np.log2(p)


def _tables(rows: pa.Table, one: np.ndarray) -> dict:
    n, weight, key, value = (rows.column(c).to_numpy() for c in ("n", "weight", "key", "value"))
    out: dict = {"one": one}
    for i in range(2, ORDER + 1):
        for name, flag in (("p", False), ("w", True)):
            at = (n == i) & (weight == flag)
            out[name, i] = Lookup(key[at], value[at])
    return out



def score(docs: DataFrame, model: DataFrame, one: np.ndarray, most_model: int = MOST_MODEL, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, bits, perplexity) of every row; perplexity is two to the bits per byte."""
    spark = docs.sparkSession
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    perplexity = F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes"))).alias("perplexity")
    if model.limit(most_model + 1).count() > most_model:
        return _blockwise(x, model, one, block).select("doc_id", "n_bytes", "bits", perplexity)
    rows = model.toArrow()
    held = spark.sparkContext.broadcast((rows.column("n").to_numpy().astype(np.int8), rows.column("weight").to_numpy(), rows.column("key").to_numpy(), rows.column("value").to_numpy(), one))

    def run(batches):
        n, weight, key, value, pairs = held.value
        m = _tables(pa.table({"n": n, "weight": weight, "key": key, "value": value}), pairs)
        for b in batches:
            for lo, hi, g, off in grams(b.column(1)):
                sums = np.append(0.0, np.cumsum(bits(m, g)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(sums[off[1:]] - sums[off[:-1]])], ["doc_id", "n_bytes", "bits"])

    return x.mapInArrow(run, "doc_id long, n_bytes long, bits double").select("doc_id", "n_bytes", "bits", perplexity)


def _blockwise(x: DataFrame, model: DataFrame, one: np.ndarray, size: int) -> DataFrame:
    """Scores where the model is too large to send: texts are cut into blocks, each block's distinct n-grams and contexts are joined with the model,
    and what it has of them is brought to the block. A row of the join is an n-gram of a block, however often it is there.
    """

    def cut(batches):
        done, at = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            ends = done + np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            done = int(ends[-1]) if len(ends) else done
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at | ends // size)], ["doc_id", "text", "block"])

    rows = materialise(x.mapInArrow(cut, "doc_id long, text string, block long"), "blocks")

    def needed(batches):
        for b in batches:
            block = b.column(1).to_numpy()
            for k in np.unique(block):
                for _, _, g, _ in grams(b.column(0).filter(pa.array(block == k))):
                    for weight, n in [(False, n) for n in range(ORDER, 2, -1)] + [(True, n) for n in range(ORDER - 1, 1, -1)]:
                        key = np.unique((g >> 8 if weight else g) & ((1 << 8 * n) - 1))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k)), pa.array(np.full(len(key), n, np.int32)), pa.array(np.full(len(key), weight)), pa.array(key)], ["block", "n", "weight", "key"])

    known = rows.select("text", "block").mapInArrow(needed, "block long, n int, weight boolean, key long").join(model, ["n", "weight", "key"]).select("block", "n", "weight", "key", "value")
    held = x.sparkSession.sparkContext.broadcast(one)

    def score_(texts: pa.Table, own: pa.Table) -> pa.Table:
        ids, t = texts.column("doc_id").combine_chunks(), texts.column("text").combine_chunks()
        m, out = _tables(own, held.value), []
        for lo, hi, g, off in grams(t):
            sums = np.append(0.0, np.cumsum(bits(m, g)))
            out.append(pa.table({"doc_id": ids.slice(lo, hi - lo), "n_bytes": np.diff(off), "bits": sums[off[1:]] - sums[off[:-1]]}))
        return pa.concat_tables(out)

    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score_, "doc_id long, n_bytes long, bits double")


def perplexities(docs: DataFrame, **options) -> DataFrame:
    """Train on the whole table and score all of it."""
    return score(docs, *train(docs, **options))
