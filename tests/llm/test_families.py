"""Near duplicates among documents that share boilerplate below the threshold."""

import random

from prefixloom.llm import setsketch


def test_mates_of_a_close_but_unverified_lead_are_compared(spark, monkeypatch):
    # all in one bucket; documents of different pairs are at Jaccard 0.48: near enough for the estimate, not for the threshold
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    stock, docs = fresh(300), []
    for i in range(0, 10, 2):
        own = fresh(160)
        docs += [(i, " ".join(stock + own)), (i + 1, " ".join(stock + own[:110] + fresh(50)))]
    monkeypatch.setattr(setsketch, "_bands", lambda nodes, m, rows: nodes.selectExpr("1L as band", "node"))
    got = {x.doc_id: x.group_id for x in setsketch.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(10)}


def test_families_of_one_bucket_get_leads_of_their_own(spark, monkeypatch):
    # ten families of twelve in one bucket: each is grouped whole, and pairs across families are hardly ever made
    r = random.Random(4)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    docs, want = [], {}
    for f in range(10):
        base = fresh(200)
        for _ in range(12):
            w = list(base)
            for _ in range(3):
                w[r.randrange(200)] = fresh(1)[0]
            want[len(docs)] = f * 12
            docs.append((len(docs), " ".join(w)))
    monkeypatch.setattr(setsketch, "_bands", lambda nodes, m, rows: nodes.selectExpr("1L as band", "node"))
    made = []
    counted = setsketch._mates
    monkeypatch.setattr(setsketch, "_mates", lambda *a: made.append(counted(*a)) or made[-1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for rounds in (1, 3, 20):
        monkeypatch.setattr(setsketch, "ROUNDS", rounds)
        monkeypatch.setattr(setsketch.rounds, "__defaults__", (rounds,))
        got = {x.doc_id: x.group_id for x in setsketch.groups(df).collect()}
        assert got == want
    assert sum(m.count() for m in made) < 10 * 120
