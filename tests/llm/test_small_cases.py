"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefixloom.llm import chaining, decontam, langid, mixing, pitmanyor, projections, setsketch, styletree, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, stem=""):
    r = random.Random(seed)
    return " ".join(stem + "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(99, 60_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "...", "en", "a", 3), (None, prose(1, 80), "en", "a", 5), (4, prose(2, 80), None, None, -4), (4, prose(2, 80), "en", "a", 7), (5, prose(2, 80), "en", "b", 7), (6, long, "en", "b", len(long)), (7, "x", "en", "b", 1), (7, "x", "en", "b", 1), (8, "Ünïcode ☃ \U0001f600 text", "fr", "b", 9)]
    return spark.createDataFrame(rows, DOCS).withColumns({"__px_id": F.lit(9), "component": F.lit("c"), "copies": F.lit(1), "words": F.lit(2)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, None, None), (None, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd, none, labels):
    net = toxicity.train(*toxicity.sample(odd, labels))
    rows = toxicity.score(odd, net).collect()
    assert len(rows) == 11 and all(r.n_windows == 0 and not r.toxic for r in rows if r.doc_id in (1, 2, 3))
    assert next(r for r in rows if r.doc_id == 6).n_windows > 2000
    assert toxicity.score(none, net).count() == 0
    assert not any(r.toxic or r.score for r in toxicity.score(odd, None).collect())
    assert toxicity.train(["a"], [True]) is None and toxicity.train([], []) is None
    kept = toxicity.reject(odd, labels.where("toxic = 0"))
    assert kept.columns == odd.columns and kept.count() == 11
    twins = {r.score for r in rows if r.doc_id in (4, 5)}
    assert len(twins) == 1
    # a document at the threshold is toxic
    net.threshold = float(np.median(toxicity.score_windows(net, *toxicity._cut(pa.array(["x"]))[:2])))
    assert all(r.toxic and r.score == 0.5 for r in toxicity.score(odd, net).where("doc_id = 7").collect())


def test_languages(spark, odd, none):
    rows = langid.languages(odd).collect()
    assert len(rows) == 11 and all(r.predicted == "und" and r.rejected for r in rows if r.doc_id in (1, 2, 3))
    assert langid.languages(none).count() == 0
    # two languages of the same texts: equal cosines go to the first by name
    texts = [prose(i, 30) for i in range(6)]
    df, n = np.ones(langid.DIM), 6
    model = langid.fit(texts + texts, ["zz"] * 6 + ["aa"] * 6, df, n, clusters=6)
    same = langid.Centroids(model.idf, np.concatenate([model.center, model.center]), np.ones(2 * len(model.center)), ["aa"] * len(model.center) + ["zz"] * len(model.center))
    got = langid.identify(odd.where("doc_id in (4, 5)"), same).collect()
    assert {r.predicted for r in got} == {"aa"}
    assert all(r.rejected for r in langid.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_near_duplicates(spark, odd, none):
    assert {(r.doc_id, r.group_id) for r in setsketch.groups(odd).collect()} == {(4, 4), (5, 4)}
    assert setsketch.groups(none).count() == 0
    kept = setsketch.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 4, 4, 6, 7, 7, 8], key=str)


def test_passages(spark, odd, none):
    rows = chaining.passages(odd).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(5, 4)}
    assert chaining.passages(none).count() == 0
    kept = chaining.remove(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 4, 4, 6, 7, 7, 8], key=str)


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, prose(2, 80), 0), (1, prose(2, 80), 0), (2, None, 0), (3, "", 0), (None, "a b c", 0), (4, "X", 0), (5, prose(5, 40), 0)], "item_id long, text string, doc_id int")
    got = {(r.item_id, r.doc_id): r for r in decontam.leaks(odd, items).collect()}
    assert set(got) == {(1, 4), (1, 5), (4, 7)}
    assert got[1, 4].containment == 1.0 and got[1, 4].start_word == 0
    assert decontam.leaks(none, items).count() == 0 and decontam.leaks(odd, items.where("false")).count() == 0
    # the joined way, beyond the bound on the broadcast, gives the same
    assert sorted(decontam.leaks(odd, items, most_keys=1).collect()) == sorted(got.values())


def test_mixing(spark, odd, none):
    out = mixing.mix(odd)
    assert out.columns == [c for c in odd.columns if c != "copies"] + ["copies"]
    rows = out.collect()
    assert sum(r.copies for r in rows) == 11 and all(r.copies > 0 for r in rows)
    assert mixing.mix(none).count() == 0
    flat = mixing.mix(odd.withColumn("n_chars", F.lit(None).cast("long")), {"a": 1.0, "b": 1.0}, total=10)
    assert {r.source: r["sum(copies)"] for r in flat.groupBy("source").sum("copies").collect()} == {"a": 5, "b": 5}


def test_perplexity(spark, odd, none):
    model, one = pitmanyor.train(odd, rounds=1)
    got = pitmanyor.score(odd, model, one).collect()
    assert len(got) == 11
    assert all(r.n_bytes == 0 and r.bits == 0 and r.perplexity is None for r in got if r.doc_id in (1, 2))
    assert pitmanyor.score(none, *pitmanyor.train(none, rounds=1)).count() == 0
    # beyond the bound on the broadcast
    key = lambda rows: sorted((str(r.doc_id), r.n_bytes, round(r.bits, 3)) for r in rows)
    for block in (100, 5000, pitmanyor.BLOCK):
        assert key(pitmanyor.score(odd, model, one, most_model=1, block=block).collect()) == key(got)
    # texts that the model hasn't seen
    new = odd.withColumn("text", F.concat(F.lit("q"), "text"))
    assert key(pitmanyor.score(new, model, one, most_model=1).collect()) == key(pitmanyor.score(new, model, one).collect())


PAGES = "page_id long, url string, html string"


def test_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://a.example/x", "<p>Hi &amp; bye"), (3, "http://a.example/x", "<p>Hi &amp; bye"), (None, "http://b.example", "<script>x<p>y</script></b></div>t<ext <"), (4, "http://c.example/", deep), (5, "HTTP://u@D.example:80/", "<p a='" * 50 + "word " * 50_000)]
    df = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("h"), "noise": F.lit(1)})
    got = styletree.extract(df).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert by[1].text == "" and by[1].host == "" and by[2].text == ""
    assert by[4].text == "deep" and by[5].host == "d.example" and by[None].text.startswith("t")
    assert styletree.extract(df.where("false")).count() == 0
    assert sorted(map(str, styletree.extract(df, most_broadcast=-1).collect())) == sorted(map(str, got))
    back = warc.round_trip(df, split=1000)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("page_id", "url", "html").collect()))
    assert warc.round_trip(df.where("false")).count() == 0


def test_embeddings(spark):
    v = [1.0] + [0.0] * 15
    w = [0.99, 0.1] + [0.0] * 14
    rows = [(1, v), (2, [2 * x for x in v]), (3, None), (4, [0.0] * 16), (5, [float("nan")] * 16), (6, []), (None, v), (7, w), (7, [0.0, 1.0] + [0.0] * 14), (8, [1.0]), (9, [5.0]), (10, [None] * 16), (11, [1e300] * 16), (12, [2e300] * 16), (13, [0.0] * 15 + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "node": F.lit(2)})
    got = {r.vec_id: r.group_id for r in projections.groups(df).collect()}
    assert got == {1: 1, 2: 1, 7: 1, 8: 8, 9: 8, 11: 11, 12: 11}
    assert projections.groups(df.where("false")).count() == 0
