"""Operator 3: main-content extraction by a site style tree.

The DOMs of one host's pages are merged: elements on the same path of tags and classes are one node, holding style nodes, the sequences of
labels in which its children appear (runs collapsed), each with its share of the occurrences, and the content features of its own text
(sentences, link targets, image sources). Style nodes of one element have children of the same label in common, so that a sequence that only one page
has doesn't cut its elements off from the site's. A node's presentation importance is the entropy of its styles over its occurrences; its content
importance is 1 less the mean entropy of its features over the pages that have it, so what repeats across a site weighs little. Importance is
composed upwards: a style node's is the mean of its children's, own content counting as one; a node's is
(1 - GAMMA^styles) * presentation + GAMMA^styles * the mean of its style nodes' by their shares. A text is removed from each page where its own
content and its element both fall below THRESHOLD, so a branch goes if all of it is unimportant.

Entropies are sums over (node, feature), which distribute: no task holds a site, however many pages it has. Only the merged tree, one
row per node, is brought together by host. What is to go, two numbers a node, reaches a scan of the pages by one broadcast while it has at most
MOST_BROADCAST rows; beyond, the pages' texts are joined with it, block by block.

Defined cases: null html gives an empty text. A null or odd url has the host '', a site of its own. A node on one page only has
importance 1, as there is nothing to compare, so single-page sites keep all visible text. Unclosed and stray tags are repaired as
browsers mostly do; scripts, styles, comments and titles are never text. Every row of pages gives one row; rows that
repeat a page_id are pages of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.llm.shared import grouped, materialise

GAMMA = 0.9
THRESHOLD = 0.75
MOST_BROADCAST = 1_000_000
ROWS_HELD = 400_000
_SKIP = "script|style|noscript|template|title|svg|iframe|textarea"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_SKIP})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\s+[·|•]\s+|\n+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("b i em strong u s small sub sup span font mark code abbr cite q time".split())
_BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul".split())
#: A tag that opens closes an open one of these, unless a fence lies between.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = frozenset("html body article aside div section table ul ol dl nav main header footer form blockquote td th select".split())
_ROOT = 0x5EED


def _id(parent: int, label: str, known: dict) -> int:
    key = (parent, label)
    if key not in known:
        if len(known) > 200_000:
            known.clear()
        known[key] = xxhash.xxh3_64_intdigest(label, seed=parent & 0xFFFFFFFFFFFFFFFF) >> 1
    return known[key]


class Page:
    """Nodes, styles and texts of one page. Blocks are (node, text) in reading order."""

    __slots__ = ("parent", "depth", "styles", "features", "blocks")

    def __init__(self, source: str, known: dict):
        self.parent: dict[int, int] = {_ROOT: 0}
        self.depth: dict[int, int] = {_ROOT: 0}
        self.styles: Counter = Counter()
        self.features: Counter = Counter()
        self.blocks: list[tuple[int, str]] = []
        # open elements: [tag, node, labels of children, runs collapsed]
        stack: list[list] = [["", _ROOT, []]]
        at, text = 0, []

        def flush() -> None:
            if text:
                whole = " ".join(_html.unescape("".join(text)).split())
                if whole:
                    self.blocks.append((stack[-1][1], whole))
                text.clear()

        def close(to: int) -> None:
            flush()
            while len(stack) > to:
                _, node, seen = stack.pop()
                self.styles[node, tuple(seen)] += 1

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            tag, rest = name.lower(), m[4] or m[7] or ""
            if tag in _INLINE:
                continue
            if m[2] or m[5]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                else:
                    if tag in _BREAKS:
                        flush()
                continue
            shut = _CLOSES.get(tag) or ({"p"} if tag in _BREAKS and tag != "br" else None)
            if shut:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in shut:
                        close(i)
                        break
                    if stack[i][0] in _FENCE:
                        break
            flush()
            own = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest else {}
            label = f"{tag}.{'.'.join(sorted(own['class'].split()))}" if own.get("class") else tag
            top = stack[-1]
            if not top[2] or top[2][-1] != label:
                top[2].append(label)
            node = _id(top[1], label, known)
            if node not in self.parent:
                self.parent[node], self.depth[node] = top[1], len(stack)
            if link := own.get("href") or own.get("src"):
                self.features[node, "\x1e" + link] += 1
            if tag not in _VOID and not rest.endswith("/"):
                stack.append([tag, node, []])
        if at < len(source):
            text.append(source[at:])
        close(0)
        for node, whole in self.blocks:
            for s in _SENTENCE.split(whole):
                if s:
                    self.features[node, s] += 1


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sums(key: np.ndarray, kind: np.ndarray, feature: np.ndarray, c: np.ndarray, l: np.ndarray):
    order = np.lexsort((feature, kind, key))
    key, kind, feature, c, l = key[order], kind[order], feature[order], c[order], l[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (feature[1:] != feature[:-1]) | (kind[1:] != kind[:-1])
    at = np.flatnonzero(new)
    return key[at], kind[at], feature[at], np.add.reduceat(c, at), np.add.reduceat(l, at)


_RAW = "key long, kind int, feature long, c long, l double, host string, node long, parent long, depth int, children array<bigint>"


def merged(pages: DataFrame) -> DataFrame:
    """Rows of the merged trees, partly summed. kind 0: a node and its pages; 1: a style and its children's keys; 2: a content feature.
    l: sum of c ln c over pages."""

    def run(batches):
        known: dict = {}
        nodes: dict[tuple, int] = {}
        styles: dict[tuple, list] = {}
        lists: list[list] = [[], [], [], []]

        def out():
            if nodes:
                k = list(nodes)
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in k], pa.int64()), pa.array([0] * len(k), pa.int32()), pa.array([0] * len(k), pa.int64()), pa.array(list(nodes.values()), pa.int64()), pa.array([0.0] * len(k)), pa.array([x[0] for x in k], pa.string()), pa.array([x[2] for x in k], pa.int64()), pa.array([x[3] for x in k], pa.int64()), pa.array([x[4] for x in k], pa.int32()), pa.nulls(len(k), _CHILDREN)], _NAMES)
            if styles:
                k, n, none = list(styles), len(styles), pa.nulls(len(styles), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int64()), pa.array([1] * n, pa.int32()), pa.array([x[1] for x in k], pa.int64()), pa.array([v[0] for v in styles.values()], pa.int64()), pa.array([0.0] * n), pa.nulls(n, pa.string()), none, none, pa.nulls(n, pa.int32()), pa.array([v[1] for v in styles.values()], _CHILDREN)], _NAMES)
            if lists[0]:
                c = np.array(lists[3], np.int64)
                key, kind, feature, c, l = _sums(np.array(lists[0], np.int64), np.array(lists[1], np.int32), np.array(lists[2], np.int64), c, c * np.log(c))
                n = len(key)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(feature), pa.array(c), pa.array(l), pa.nulls(n, pa.string()), none, none, pa.nulls(n, pa.int32()), pa.nulls(n, _CHILDREN)], _NAMES)
            nodes.clear()
            styles.clear()
            for x in lists:
                x.clear()

        for b in batches:
            for name, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = Page(source or "", known)
                salt = xxhash.xxh3_64_intdigest(name)
                keys = {n: _signed(xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), seed=salt)) for n in page.parent}
                for n, parent in page.parent.items():
                    k = (name, keys[n], n, parent, page.depth[n])
                    nodes[k] = nodes.get(k, 0) + 1
                for (n, labels), c in page.styles.items():
                    k = (keys[n], _signed(xxhash.xxh3_64_intdigest("\x1f".join(labels))))
                    if k in styles:
                        styles[k][0] += c
                    else:
                        styles[k] = [c, [keys[_id(n, x, known)] for x in labels]]
                for (n, f), c in page.features.items():
                    lists[0].append(keys[n])
                    lists[1].append(2)
                    lists[2].append(_signed(xxhash.xxh3_64_intdigest(f)))
                    lists[3].append(c)
                if len(lists[0]) + len(nodes) + len(styles) > ROWS_HELD:
                    yield from out()
        yield from out()

    return pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, _RAW)


_NAMES = [x.split()[0] for x in _RAW.split(", ")]
_CHILDREN = pa.list_(pa.int64())


def importance(pages: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, node, content, composite): content importance of a node's own text, composite importance of the node."""
    raw = materialise(merged(pages), "trees")
    nodes = raw.where("kind = 0").groupBy("host", "key", "node", "parent").agg(F.sum("c").alias("pages"), F.min("depth").alias("depth"))
    each = raw.where("kind > 0").groupBy("key", "kind", "feature").agg(F.sum("c").alias("c"), F.sum("l").alias("l"), F.first("children", ignorenulls=True).alias("children"))
    each = each.withColumn("n", F.size("children"))
    style = lambda x: F.sum(F.when(F.col("kind") == 1, x))
    stats = each.groupBy("key").agg(
        style(F.col("c")).alias("occurrences"), style(F.col("c") * F.log("c")).alias("style_log"), style(F.lit(1)).alias("styles"),
        # shares of a node's own content, and of styles without children
        style(F.col("c") / (F.col("n") + 1)).alias("own"), style(F.when(F.col("n") == 0, F.col("c")).otherwise(0)).alias("bare"),
        F.sum(F.when(F.col("kind") == 2, F.greatest(F.log("c") - F.col("l") / F.col("c"), F.lit(0.0)))).alias("spread"),
        F.count(F.when(F.col("kind") == 2, 1)).alias("features"),
    )
    # a child's shares in its parent's styles, without and with content of the parent's own; a child has one parent
    shares = each.where("kind = 1").select("c", "n", F.explode("children").alias("key")).groupBy("key").agg(F.sum(F.col("c") / F.col("n")).alias("share"), F.sum(F.col("c") / (F.col("n") + 1)).alias("share_beside"))
    x = nodes.join(stats, "key", "left").join(shares, "key", "left").select(
        "host", "node", "parent", "depth",
        F.when(F.col("features") == 0, None).when(F.col("pages") == 1, 1.0).otherwise(1 - F.col("spread") / F.col("features") / F.log("pages")).alias("content"),
        F.when(F.col("pages") == 1, 1.0).otherwise(F.coalesce((F.log("occurrences") - F.col("style_log") / F.col("occurrences")) / F.log("occurrences"), F.lit(0.0))).alias("presentation"),
        F.greatest(F.coalesce("styles", F.lit(0)), F.lit(1)).cast("int").alias("styles"),
        F.coalesce("occurrences", F.lit(1)).cast("double").alias("occurrences"), # an element that is never open, as an image, has no style: all of it is its content
        *[F.coalesce(c, F.lit(v)).cast("double").alias(c) for c, v in (("own", 1.0), ("bare", 1.0), ("share", 0.0), ("share_beside", 0.0))],
    )

    def compose(t: pa.Table) -> pa.Table:
        c = {n: t.column(n).to_numpy() for n in ("node", "parent", "depth", "content", "presentation", "styles", "occurrences", "own", "bare", "share", "share_beside")}
        site = t.column("host").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((c["node"], site))
        # each row's parent, by the pair of site and node; the root has none
        at = order[np.minimum(_place(site[order], c["node"][order], site, c["parent"]), len(order) - 1)]
        has = (site[at] == site) & (c["node"][at] == c["parent"])
        text = ~np.isnan(c["content"])
        content = np.where(text, c["content"], 0.0)
        below = np.where(text, c["own"] * content, c["bare"] * c["presentation"])
        share = np.where(text[at], c["share_beside"], c["share"])
        result, g = np.zeros(len(site)), gamma ** c["styles"]
        by_depth = np.argsort(-c["depth"], kind="stable")
        for rows in np.split(by_depth, np.flatnonzero(np.diff(c["depth"][by_depth])) + 1):
            result[rows] = (1 - g[rows]) * c["presentation"][rows] + g[rows] * below[rows] / c["occurrences"][rows]
            up = rows[has[rows]]
            np.add.at(below, at[up], share[up] * result[up])
        return pa.table({"host": t.column("host"), "node": t.column("node"), "content": t.column("content"), "composite": pa.array(result)})

    return grouped(x, ["host"], ["node"], compose, "host string, node long, content double, composite double")


def _place(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where each (x, y) stands among the sorted pairs (a, b)."""
    both_a, both_b, kind = np.concatenate([a, x]), np.concatenate([b, y]), np.repeat([1, 0], [len(a), len(x)])
    order = np.lexsort((kind, both_b, both_a))
    before = np.cumsum(kind[order])
    out = np.empty(len(order), np.int64)
    out[order] = before
    return out[len(a) :]


def extract(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(page_id, host, text, kept, removed): the text left of each page, a line per block, and how many blocks stayed and went."""
    noise = importance(pages, gamma).where((F.coalesce("content", F.lit(1.0)) < threshold) & (F.col("composite") < threshold)).select("host", "node").distinct()
    noise = materialise(noise, "noise")
    x = pages.select("page_id", host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    kind = x.schema["page_id"].dataType.simpleString()
    if noise.limit(most_broadcast + 1).count() > most_broadcast:
        return _joined(x, noise, kind)
    rows = noise.toArrow().sort_by("host")
    names, first = np.unique(np.array(rows.column("host").to_pylist(), object), return_index=True)
    held = pages.sparkSession.sparkContext.broadcast((dict(zip(names, zip(first, np.append(first[1:], rows.num_rows)))), rows.column("node").to_numpy()))

    def run(batches):
        known: dict = {}
        where, nodes = held.value
        last, gone = None, frozenset()
        for b in batches:
            texts, kept, removed = [], [], []
            for name, source in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if name != last:
                    last, gone = name, frozenset(nodes[slice(*where[name])].tolist()) if name in where else frozenset()
                blocks = Page(source or "", known).blocks
                stay = [t for n, t in blocks if n not in gone]
                texts.append("\n".join(stay))
                kept.append(len(stay))
                removed.append(len(blocks) - len(stay))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(kept, pa.int32()), pa.array(removed, pa.int32())], ["page_id", "host", "text", "kept", "removed"])

    return x.mapInArrow(run, f"page_id {kind}, host string, text string, kept int, removed int")


def _joined(x: DataFrame, noise: DataFrame, kind: str) -> DataFrame:
    """extract() where noise is too large to broadcast: a row a block, joined with it and put together again. A page without blocks has one row, at -1."""

    def run(batches):
        known: dict = {}
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            at, pos, node, text = [], [], [], []
            for i, source in enumerate(b.column(2).to_pylist()):
                for p, (n, t) in enumerate([(0, None), *Page(source or "", known).blocks]):
                    at.append(i)
                    pos.append(p - 1)
                    node.append(n)
                    text.append(t)
            i = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(at, np.int64) + row), b.column(0).take(i), b.column(1).take(i), pa.array(pos, pa.int32()), pa.array(node, pa.int64()), pa.array(text, pa.string())], ["row", "page_id", "host", "pos", "node", "text"])
            row += b.num_rows

    blocks = materialise(x.mapInArrow(run, f"row long, page_id {kind}, host string, pos int, node long, text string"), "blocks")
    y = blocks.join(noise.withColumn("gone", F.lit(True)), ["host", "node"], "left")
    own = F.col("pos") >= 0
    stay = own & F.col("gone").isNull()
    y = y.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.sort_array(F.collect_list(F.when(stay, F.struct("pos", "text")))).alias("stay"), F.count(F.when(own, 1)).cast("int").alias("blocks"))
    kept = F.size("stay").alias("kept")
    return y.select("page_id", "host", F.array_join("stay.text", "\n").alias("text"), kept, (F.col("blocks") - F.size("stay")).alias("removed"))
