"""Operators that SQL can't express, held against brute force, exact round trips or held-out accuracy."""

import io
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prefixloom.llm import chaining, decontam, langid, mixing, pitmanyor, projections, setsketch, styletree, text, toxicity, warc
from prefixloom.llm.shared import components

SF = "/root/testdata/sf0.01"


def words_of(s):
    return list(text.words(pa.array([s])))[0].hash


def prose(r, n):
    return ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_near_duplicate_groups_reach_brute_force(spark):
    r = random.Random(2)
    docs = []
    for g in range(25):
        base = prose(r, 120)
        for copy in range(4):
            w = list(base)
            for _ in range(copy * 3):
                w[r.randrange(len(w))] = prose(r, 1)[0]
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + i, " ".join(prose(r, 100))) for i in range(60)]
    sets = [set(setsketch.sets(list(text.words(pa.array([t])))[0])[0].tolist()) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if len(sets[a] & sets[b]) >= setsketch.THRESHOLD * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {d: find(d) for d in range(len(docs)) if sum(find(x) == find(d) for x in range(len(docs))) > 1}
    got = {x.doc_id: x.group_id for x in setsketch.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(want.get(d) == g for d, g in got.items()) or len(set(got.items()) ^ set(want.items())) <= 0.1 * len(want)
    assert len(set(got) & set(want)) >= 0.9 * len(want)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    a, b = h[:2000], h[1000:]
    sk = lambda x: setsketch.sketch(np.sort(x), np.array([0, len(x)]))
    assert (setsketch.merge(sk(a), sk(b)) == sk(h)).all()
    j = setsketch.estimate(sk(a), sk(b), np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 1 / 3) < 0.12


def test_passages_are_found_and_others_left(spark):
    r = random.Random(4)
    shared = [prose(r, 70) for _ in range(6)]
    docs, planted = [], set()
    for i in range(60):
        w = prose(r, 200)
        if i % 2 == 0:
            s = list(shared[i // 2 % 6])
            if i > 30:  # fuzzy: a word in twenty differs, one is left out
                for k in range(10, 60, 20):
                    s[k] = prose(r, 1)[0]
                del s[35]
            at = r.randint(0, 200)
            w[at:at] = s
            if i >= 12:
                planted.add((i, at, at + len(s)))
        docs.append((i, " ".join(w)))
    got = chaining.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for d, s, e in planted:
        assert any(x.doc_id == d and x.start_word <= s + 6 and x.end_word >= e - 6 for x in got), d
    assert {x.doc_id for x in got} == {d for d, *_ in planted}
    clean = {x.doc_id: x.text.split() for x in chaining.remove(spark.createDataFrame([(*d, "en", "s", len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(len(clean[i]) == 200 for i in range(1, 60, 2))
    assert all(195 <= len(clean[d]) <= 212 for d, *_ in planted)


def test_chain_by_fenwick_tree_is_the_best_chain():
    r = random.Random(5)
    for _ in range(40):
        n = r.randint(1, 9)
        seg = sorted((b, b + r.randint(6, 20), a) for b, a in ((r.randint(0, 100), r.randint(0, 100)) for _ in range(n)))
        b0, b1, a0 = map(list, zip(*seg))
        a1 = [a + e - s for s, e, a in seg]
        score, _ = chaining.fenwick_chain(b0, b1, a0, a1)
        best = [0.0] * n
        for j in range(n):
            own = b1[j] - b0[j]
            best[j] = own
            for i in range(n):
                if b1[i] - chaining.SLACK <= b0[j] and b0[i] < b0[j] and a1[i] - chaining.SLACK <= a0[j] and i != j:
                    best[j] = max(best[j], own + best[i] - chaining.GAP_COST * (b0[j] - b1[i] + a0[j] - a1[i]))
        assert score == pytest.approx(best)


def brute_leaks(docs, items):
    found = set()
    for i, it in items:
        iw = words_of(it).tolist()
        want = {tuple(iw[k : k + decontam.K]) for k in range(len(iw) - decontam.K + 1)}
        for d, t in docs:
            dw = words_of(t).tolist()
            sh = [tuple(dw[k : k + decontam.K]) for k in range(len(dw) - decontam.K + 1)]
            span = len(iw) - decontam.K + 1
            top = max((len(want & set(sh[s : s + span])) for s in range(len(sh))), default=0)
            if top >= np.ceil(len(want) * decontam.THRESHOLD - 1e-9):
                found.add((i, d))
    return found


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    items = [(i, " ".join(prose(r, 30))) for i in range(12)]
    docs = []
    for d in range(50):
        w = prose(r, 80)
        if d % 2:
            s = items[d % 12][1].split()
            for _ in range(d % 5):
                s[r.randrange(len(s))] = "zzz"
            at = r.randint(0, 80)
            w[at:at] = s
        docs.append((d, " ".join(w)))
    got = {(x.item_id, x.doc_id) for x in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(docs, items) and got


def test_near_embeddings_reach_brute_force(spark):
    r = np.random.default_rng(7)
    rows = []
    for size in (400, 30, 5, 2, 2, 2, 2, 2):
        c = r.standard_normal(64)
        rows += [c + 0.1 * r.standard_normal(64) for _ in range(size)]
    rows += list(r.standard_normal((800, 64)))
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= projections.THRESHOLD
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {g.vec_id: g.group_id for g in projections.groups(df).collect()}
    pairs = [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    assert sum(a in got and got.get(a) == got.get(b) for a, b in pairs) >= 0.9 * len(pairs)
    for i in range(len(rows)):
        if near[i].sum() == 1:
            assert i not in got


def test_neighbours_across_range_borders(spark):
    # all vectors are alike: every pair at most WINDOW apart in the one order must be compared, whatever the partitions
    r = np.random.default_rng(8)
    c = r.standard_normal(64)
    df = spark.createDataFrame([(i, [float(a) for a in c + 1e-3 * r.standard_normal(64)]) for i in range(150)], "vec_id long, embedding array<double>")
    nodes = projections.vectors(df).select("node", "dim", "unit").cache()
    got = {(x.a, x.b) for x in projections.candidates(nodes, passes=1, window=5).collect()}
    keyed = projections.keys(nodes, 1, 64, projections.SEED).orderBy("key0", "node").select("node").collect()
    order = [x.node for x in keyed]
    assert got == {(min(a, b), max(a, b)) for i, a in enumerate(order) for b in order[i + 1 : i + 6]}


def test_warc_members_are_owned_once(spark, tmp_path):
    r = random.Random(9)
    body = [zlib.compress(r.randbytes(r.randint(0, 3000))) + b"\x1f\x8b\x08\x00fake" for _ in range(40)]
    members = [warc._member("resource", [("X-Page-ID", str(i))], b) for i, b in enumerate(body)]
    data = b"".join(members)
    starts = [0, *itertools.accumulate(map(len, members))][:-1]
    for size in (17, 333, 5000, len(data)):
        got = [(s, c) for lo in range(0, len(data), size) for s, _, c in warc.scan(io.BytesIO(data), len(data), lo, min(len(data), lo + size)) if c]
        assert [s for s, _ in got] == starts
    path = tmp_path / "x.warc.gz"
    broken = data[: starts[5] + 20] + b"\0" * 5 + data[starts[5] + 25 : -3]
    path.write_bytes(broken)
    got = {x.headers["x-page-id"]: bytes(x.content) for x in warc.read(spark, [(str(path), len(broken))], 500).collect()}
    assert got == {str(i): b for i, b in enumerate(body) if i not in (5, 39)}
    assert warc.read(spark, [(str(path), len(broken))], 500, errors=True).where("type = 'corrupt'").count() == 2


def test_site_boilerplate_goes_and_articles_stay(spark):
    r = random.Random(10)
    page = lambda i: f"<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>Home</a><li><a href='/b'>About us</a></ul></nav><div class='main'><h1>{' '.join(prose(r, 5))}</h1><p>{' '.join(prose(r, 40))}.<p>{' '.join(prose(r, 30))}.</div><footer>All rights reserved.</footer></body></html>"
    rows = [(i, f"http://site{i % 2}.example/{i}", page(i)) for i in range(40)]
    got = styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Home" not in g.text and "rights" not in g.text and g.kept == 3 and g.removed == 3 for g in got)
    # entropies by brute force on one host
    imp = styletree.importance(spark.createDataFrame(rows, "page_id long, url string, html string")).where("host = 'site0.example' and content is not null").collect()
    pages = [styletree.Page(h, {}) for i, _, h in rows if i % 2 == 0]
    for x in imp:
        feats = [{f: c for (n, f), c in p.features.items() if n == x.node} for p in pages]
        names = {f for fs in feats for f in fs}
        hs = []
        for f in names:
            c = np.array([fs[f] for fs in feats if f in fs], float)
            q = c / c.sum()
            hs.append(float(-(q * np.log(q)).sum() / np.log(len(pages))))
        assert x.content == pytest.approx(1 - np.mean(hs), abs=1e-9)


def composite_by_hand(pages, gamma=styletree.GAMMA):
    """(content, composite) of every node of one site, by recursion over the merged tree."""
    parent, depth = {}, {}
    for p in pages:
        parent |= p.parent
        depth |= p.depth
    on = {n: [p for p in pages if n in p.parent] for n in parent}
    entropy = lambda c: float(-sum(x / sum(c) * np.log(x / sum(c)) for x in c))
    out = {}
    for n in sorted(parent, key=lambda n: -depth[n]):
        styles, feats = {}, {}
        for p in on[n]:
            for (m, labels), c in p.styles.items():
                if m == n:
                    styles[labels] = styles.get(labels, 0) + c
            for (m, f), c in p.features.items():
                if m == n:
                    feats.setdefault(f, []).append(c)
        alone, total = len(on[n]) == 1, sum(styles.values())
        content = None if not feats else 1.0 if alone else 1 - np.mean([entropy(c) for c in feats.values()]) / np.log(len(on[n]))
        shown = 1.0 if alone else entropy(list(styles.values())) / np.log(total) if total > 1 else 0.0
        below = 0.0
        for labels, c in styles.items():
            own = [out[styletree._id(n, x, {})][1] for x in labels] + ([content] if content is not None else [])
            below += c / total * (np.mean(own) if own else shown)
        g = gamma ** max(len(styles), 1)
        out[n] = (content, (1 - g) * shown + g * (below if styles else content if content is not None else shown))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_style_tree_by_hand(spark, seed):
    r = random.Random(seed)

    def branch(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice(["Home", "About us.", " ".join(prose(r, 6)) + "."])
        parts = [f"<{t} class={r.choice('ab')}>{branch(depth - 1)}</{t}>" for t in r.choices(["div", "ul", "p", "section"], k=r.randint(1, 3))]
        return "".join(parts) + r.choice(["", "tail text", "<img src=/x>"])

    rows = [(i, "http://s.example/", "<body><nav>Home</nav>" + branch(3) + "</body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = composite_by_hand([styletree.Page(h, {}) for *_, h in rows])
    got = {x.node: (x.content, x.composite) for x in styletree.importance(df).collect()}
    assert got.keys() == want.keys()
    for n, (content, composite) in want.items():
        assert got[n][1] == pytest.approx(composite, abs=1e-9) and (got[n][0] is None) == (content is None)
        assert content is None or got[n][0] == pytest.approx(content, abs=1e-9)
    gone = {n for n, (content, composite) in want.items() if (1.0 if content is None else content) < styletree.THRESHOLD and composite < styletree.THRESHOLD}
    left = {i: "\n".join(t for n, t in styletree.Page(h, {}).blocks if n not in gone) for i, _, h in rows}
    assert gone and {x.page_id: x.text for x in styletree.extract(df).collect()} == left
    # beyond the bound on the broadcast
    assert sorted(styletree.extract(df, most_broadcast=0).collect()) == sorted(styletree.extract(df).collect())


def test_pareto_sample_sizes_and_odds(spark):
    r = random.Random(11)
    rows = [(i, f"s{i % 3}", r.randint(1, 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    weights = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    seeds = range(12)
    total = np.zeros(600)
    for seed in seeds:
        got = {x.doc_id: x.copies for x in mixing.mix(df, weights, 300, seed).collect()}
        for k, s in enumerate(("s0", "s1", "s2")):
            assert sum(c for d, c in got.items() if d % 3 == k) == 300 * weights[s]
        total += [got.get(i, 0) for i in range(600)]
    size = np.array([n for *_, n in rows], float)
    want = np.array([300 * weights[f"s{i % 3}"] * size[i] / size[i % 3 :: 3].sum() for i in range(600)])
    big = size > 25
    assert abs(total[big].sum() / len(seeds) - want[big].sum()) < 8


def test_sizes_beyond_64_bits_times_copies(spark):
    # one source of 3e16 characters, as of 7.5e12 documents of 4 KB
    df = spark.createDataFrame([(i, "big" if i % 3 else "small", 10**13 + i) for i in range(4500)], "doc_id long, source string, n_chars long")
    got = mixing.mix(df, {"big": 0.9, "small": 0.1}, 10**12).groupBy("source").sum("copies").collect()
    assert {r[0]: r[1] for r in got} == {"big": 9 * 10**11, "small": 10**11}
    few = mixing.mix(df, {"big": 0.9, "small": 0.1}, 1000).groupBy("source").sum("copies").collect()
    assert {r[0]: r[1] for r in few} == {"big": 900, "small": 100}


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 40")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col("lang")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right[0] > 0.9 and right[1] < 0.08


# Half of the 14 toxic documents held out here, and 11 of the 37 trained on, are in three languages of which each has two to five: 8 of 14 are within reach.
@pytest.mark.xfail(reason="8 of 14 are caught; the labels of this scale hold too few toxic documents of three languages", strict=False)
def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    net = toxicity.train(*toxicity.sample(docs, labels.where(~held)))
    truth = labels.where(held).select("doc_id", F.col("toxic").alias("label"))
    got = toxicity.score(docs, net).join(truth, "doc_id").select("toxic", "label").collect()
    bad = [x for x in got if x.label == 1]
    good = [x for x in got if x.label == 0]
    assert sum(x.toxic for x in bad) >= 0.8 * len(bad) and sum(x.toxic for x in good) <= 0.05 * len(good)


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_toxicity_of_english_on_held_out_labels(spark, seed):
    # the same documents and split as above, in the language that has enough of them to learn
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    net = toxicity.fit(docs, labels.where(~held), seed=seed)
    truth = labels.where(held).select("doc_id", F.col("toxic").alias("label")).join(docs.select("doc_id", "lang"), "doc_id")
    got = toxicity.score(docs, net).join(truth, "doc_id").select("toxic", "label", "lang").collect()
    bad = [x for x in got if x.label == 1 and x.lang == "en"]
    good = [x for x in got if x.label == 0]
    assert sum(x.toxic for x in bad) >= 0.8 * len(bad) and sum(x.toxic for x in good) <= 0.05 * len(good)


def test_toxicity_of_all_languages_on_held_out_labels(spark):
    sf = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    net = toxicity.fit(docs, labels.where(~held))
    truth = labels.where(held).select("doc_id", F.col("toxic").alias("label"))
    got = toxicity.score(docs.join(truth, "doc_id"), net).join(truth, "doc_id").select("toxic", "label").collect()
    bad = [x for x in got if x.label == 1]
    good = [x for x in got if x.label == 0]
    assert sum(x.toxic for x in bad) >= 0.8 * len(bad) and sum(x.toxic for x in good) <= 0.05 * len(good)


def test_fitting_in_tasks_gives_what_one_process_does(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("doc_id % 3 = 0")
    a, b = toxicity.fit(docs, labels), toxicity.train(*toxicity.sample(docs, labels))
    assert a.threshold == pytest.approx(b.threshold, abs=1e-3) and np.allclose(a.words, b.words, atol=1e-3)


def test_logits_are_those_of_the_whole_network():
    net = toxicity.fresh(2)
    t, ids, _, _ = toxicity._cut(pa.array([" ".join(prose(random.Random(5), 90)), "a few words"], pa.large_string()))
    x = toxicity.vectors(net, t)
    assert np.allclose(toxicity.logits(net, x, ids), toxicity.forward(net, x, ids)[0], atol=1e-5)


def test_gradients_against_differences():
    net = toxicity.fresh(1)
    t, ids, row, _ = toxicity._cut(pa.array(["one two three four five six", "seven two nine"], pa.large_string()))
    label, weight = np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)
    loss = lambda: toxicity.gradients(net, t, toxicity.vectors(net, t), ids, label, weight)[0]
    _, g = toxicity.gradients(net, t, toxicity.vectors(net, t), ids, label, weight)
    for name, at in (("out", (3,)), ("v", (2,)), ("u", (0, 1, 2)), ("w", (1, 3, 5))):
        p = getattr(net, name)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-4)


def test_perplexity_of_held_out_text_beats_short_contexts(spark):
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist() if t][:300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train, test = df.where("doc_id % 5 > 0"), df.where("doc_id % 5 = 0")
    model, one = pitmanyor.train(train)
    got = pitmanyor.score(test, model, one).agg(F.sum("bits") / F.sum("n_bytes")).first()[0]
    # a trigram of bytes with absolute discounting, by dictionaries
    from collections import Counter

    tri, bi, uni = Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        if i % 5:
            b = bytes(4) + t.encode()
            for k in range(4, len(b)):
                tri[b[k - 2 : k + 1]] += 1
                bi[b[k - 1 : k + 1]] += 1
                uni[b[k]] += 1
    c2, c1, n2, n1, n = Counter(), Counter(), Counter(), Counter(), sum(uni.values())
    for g, c in tri.items():
        c2[g[:2]] += c
        n2[g[:2]] += 1
    for g, c in bi.items():
        c1[g[:1]] += c
        n1[g[:1]] += 1
    total = size = 0
    for i, t in enumerate(texts):
        if i % 5 == 0:
            b = bytes(4) + t.encode()
            for k in range(4, len(b)):
                p = (uni[b[k]] + 1) / (n + 256)
                x = b[k - 1 : k]
                p = (max(bi[b[k - 1 : k + 1]] - 0.7, 0) + 0.7 * n1[x] * p) / c1[x] if c1[x] else p
                x = b[k - 2 : k]
                p = (max(tri[b[k - 2 : k + 1]] - 0.7, 0) + 0.7 * n2[x] * p) / c2[x] if c2[x] else p
                total -= np.log2(p)
                size += 1
    assert got < total / size - 0.1


def test_predictive_probabilities_add_up(spark):
    df = spark.createDataFrame([(1, "abracadabra abracadabra banana bandana cabana" * 3)], "doc_id long, text string")
    model, one = pitmanyor.train(df, rounds=1)
    m = pitmanyor._tables(model.toArrow(), one)
    for context in (b"abra", b"ana ", b"zzzz", b"zana", b"zzzn"):
        g = np.array([int.from_bytes(context + bytes([w]), "big") for w in range(256)])
        assert (2.0 ** -pitmanyor.bits(m, g)).sum() == pytest.approx(1, abs=0.03)


def customers_one_by_one(c, d, s, p, rest, n, seed):
    r = np.random.default_rng(seed)
    t = np.ones(n)
    for j in range(1, c):
        a = (s + d * (rest + t)) * p
        t += r.random(n) < a / (a + j - d * t)
    return t


@pytest.mark.parametrize("c, d, s, p, rest", [(5, 0.5, 1.0, 0.3, 0), (60, 0.5, 1.0, 0.3, 0), (60, 0.8, 0.5, 0.9, 3), (2000, 0.8, 0.5, 0.6, 2), (30000, 0.7, 0.5, 0.9, 1)])
def test_seating_follows_the_restaurant(c, d, s, p, rest):
    # tables of many customers with a fixed parent: mean and spread agree with a simulation customer by customer
    n = 3000
    got = pitmanyor.seat(np.arange(n), np.full(n, c), np.full(n, rest), np.full(n, p), d, s, 5)
    want = customers_one_by_one(c, d, s, p, rest, n, 1)
    assert got.mean() == pytest.approx(want.mean(), rel=0.03) and got.std() == pytest.approx(want.std(), rel=0.12)


def test_lgamma():
    import math

    x = np.array([1e-3, 0.2, 1.0, 2.5, 10.0, 123.4, 1e6, 1e9])
    assert np.allclose(pitmanyor.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def gibbs(data, order, hyper, burn, keep, seed):
    """A hierarchical Pitman-Yor model of bytes by adding and removing one customer after another; mean predictive probabilities."""
    r = random.Random(seed)
    seats = {}  # context -> byte -> list of table sizes

    def prob(u, w):
        d, s = hyper[len(u)]
        up = prob(u[1:], w) if u else 1 / 256
        dishes = seats.get(u)
        if not dishes:
            return up
        c, t = sum(map(sum, dishes.values())), sum(map(len, dishes.values()))
        own = dishes.get(w, [])
        return (sum(own) - d * len(own) + (s + d * t) * up) / (s + c)

    def add(u, w):
        d, s = hyper[len(u)]
        dishes = seats.setdefault(u, {})
        own = dishes.setdefault(w, [])
        t = sum(map(len, dishes.values()))
        new = (s + d * t) * (prob(u[1:], w) if u else 1 / 256)
        x = r.random() * (sum(own) - d * len(own) + new)
        for i, n in enumerate(own):
            x -= n - d
            if x < 0:
                own[i] += 1
                return
        own.append(1)
        if u:
            add(u[1:], w)

    def drop(u, w):
        own = seats[u][w]
        x = r.random() * sum(own)
        for i, n in enumerate(own):
            x -= n
            if x < 0:
                break
        own[i] -= 1
        if own[i] == 0:
            del own[i]
            if u:
                drop(u[1:], w)

    padded = bytes(order - 1) + data
    grams_ = [(padded[i : i + order - 1], padded[i + order - 1]) for i in range(len(data))]
    for g in grams_:
        add(*g)
    total = np.zeros(len(grams_))
    for sweep in range(burn + keep):
        for g in grams_:
            drop(*g)
            add(*g)
        if sweep >= burn:
            total += [prob(*g) / keep for g in grams_]
    return total


def test_probabilities_are_those_of_gibbs_customer_by_customer(spark):
    text_ = ("the cat sat on the mat and the rat sat on the hat. that cat and that rat ate the oats at the mat. " * 2).encode()
    hyper = np.array([(0.3, 1.0), (0.4, 1.0), (0.5, 0.5), (0.6, 0.5), (0.6, 0.5)])
    want = -np.log2(gibbs(text_, pitmanyor.ORDER, hyper, 30, 60, 3))
    df = spark.createDataFrame([(1, text_.decode())], "doc_id long, text string")
    model, one = pitmanyor.train(df, rounds=4, burn=10, samples=40, hyper=hyper)
    _, _, g, _ = next(pitmanyor.grams(pa.array([text_.decode()])))
    got = pitmanyor.bits(pitmanyor._tables(model.toArrow(), one), g)
    assert abs(got.mean() - want.mean()) < 0.05 * want.mean()
    assert np.corrcoef(got, want)[0, 1] > 0.98


def test_discounts_are_found_again():
    # seatings drawn with known values: the likelihood over the grid peaks at them
    r, d, s = np.random.default_rng(4), 0.6, 1.0
    keys, counts_ = [], []
    for u in range(400):
        tables = []
        for n in range(60):
            x = r.random() * (s + n)
            for i, t in enumerate(tables):
                x -= t - d
                if x < 0:
                    tables[i] += 1
                    break
            else:
                tables.append(1)
        # every table has a dish of its own, as under a diffuse parent
        keys += [u << 8 | i for i in range(len(tables))]
        counts_ += tables
    x = pitmanyor.Restaurants(np.array(keys), 4, np.array([(d, s)] * 5))
    joined = np.zeros(len(pitmanyor.GRID_D))
    x.sample(np.array(counts_), np.full(len(keys), 1e-12), 1, joined)
    assert (x.t == 1).all()
    i, j = np.unravel_index(np.argmax(x.fits(joined)), (len(pitmanyor.GRID_D), len(pitmanyor.GRID_S)))
    assert abs(pitmanyor.GRID_D[i] - d) <= 0.05 and pitmanyor.GRID_S[j] in (0.5, 1.0, 2.0)
