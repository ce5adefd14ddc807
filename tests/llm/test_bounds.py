"""What is broadcast or collected below a bound is joined beyond it, with the same result."""

import random

from prefixloom.llm import chaining, mixing, setsketch
from prefixloom.llm.shared import drop_ids, grouped
from tests.llm.test_brute_force import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    r = random.Random(21)
    base, passage = prose(r, 90), prose(r, 60)
    texts = [base, [*base[:85], "a", "b"], prose(r, 80), prose(r, 40) + passage, passage + prose(r, 40), prose(r, 70)]
    rows = [(i, " ".join(t), "en", f"s{i % 3}", 10 + i) for i, t in enumerate(texts * 3)]
    return spark.createDataFrame(rows, DOCS)


def test_near_duplicates_beyond_the_bound(spark):
    df = corpus(spark)
    assert sorted(setsketch.groups(df, most_ids=0).collect()) == sorted(setsketch.groups(df).collect()) != []


def test_passages_beyond_the_bound(spark):
    df = corpus(spark)
    got = chaining.passages(df).collect()
    assert got and sorted(chaining.passages(df, most_ids=0).collect()) == sorted(got)
    assert sorted(chaining.remove(df, most=0).collect()) == sorted(chaining.remove(df).collect())


def test_dropped_ids_beyond_the_bound(spark):
    df = corpus(spark)
    losers = df.where("doc_id % 2 = 0").select("doc_id")
    assert sorted(drop_ids(df, losers, most=0).collect()) == sorted(drop_ids(df, losers).collect())
    assert drop_ids(df, losers, most=0).count() == 9


def test_mixing_beyond_the_bound(spark, monkeypatch):
    df = corpus(spark)
    want = sorted(mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "MOST_BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix(df).collect()) == want


def test_groups_are_whole_whatever_is_held(spark):
    import pyarrow as pa

    r = random.Random(22)
    rows = [(r.randrange(5) if i % 3 else 7, i) for i in range(3000)]

    def count(t):
        keys = t.column("k").to_pylist()
        return pa.table({"k": list(dict.fromkeys(keys)), "n": [keys.count(k) for k in dict.fromkeys(keys)]})

    df = spark.createDataFrame(rows, "k long, v long")
    want = {k: sum(x == k for x, _ in rows) for k, _ in rows}
    for held in (1, 100, 10**6):
        assert {x.k: x.n for x in grouped(df, ["k"], ["v"], count, "k long, n long", held).collect()} == want
