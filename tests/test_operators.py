"""Lookup, catalogue, routing, tiering, leases and gates against small brute-force versions."""

import random

import pytest
from pyspark.sql import functions as F

from prefixloom.functions import binary
from prefixloom.operators import catalog, integrity, leases, lookup, routing, tiering


def test_first_miss_against_brute_force(spark):
    r = random.Random(1)
    hits = {q: [r.random() < 0.7 for _ in range(r.randint(1, 8))] for q in range(50)}
    rows = [(q, i, h, (i + 1) * 4) for q, hs in hits.items() for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "q long, idx int, hit boolean, token_end long")
    got = {x.q: (x.hit_blocks, x.matched_tokens) for x in lookup.matched(lookup.first_miss(df, "q", F.col("hit")), "q").collect()}
    for q, hs in hits.items():
        n = hs.index(False) if False in hs else len(hs)
        assert got[q] == (n, 4 * n)


def test_index_forgetting_the_first_chunk_loses_all(spark):
    chunks = spark.createDataFrame([(1, 0, "a", 4), (1, 1, "b", 8), (1, 2, "c", 9)], "q int, idx int, object_id string, token_end long")
    index = spark.createDataFrame([("a",), ("b",)], "object_id string").withColumn("known", F.lit(True))
    find = lambda ix: lookup.matched(lookup.first_miss(chunks.join(ix, "object_id", "left"), "q", F.col("known")), "q").first()
    assert tuple(find(index)) == (1, 2, 8)
    assert tuple(find(integrity.forget(index, index.where("object_id = 'a'"), ["object_id"]))) == (1, 0, 0)


@pytest.mark.parametrize(("texts", "want"), [
    (["0123456789abcdefABCDEFGHIJKLMNOP"] * 2, [(0, 32, 0, 2), (32, 0, 2, 0)]),
    (["0123456789abcdefABCDEFGHIJKLMNOP", "0123456789abcdefABCDEFGHIJKLMNOPdifferent-suffix", "0123456789abcdefABCDEFGHIJKLMNOPdifferent-suffix"], [(0, 32, 0, 2), (32, 16, 2, 1), (48, 0, 3, 0)]),
    (["short", ""], [(0, 5, 0, 0), (0, 0, 0, 0)]),
])
def test_reuse_report_of_the_smoke_runs(spark, texts, want):
    from prefixloom.plans import reuse

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in reuse._report(df, "doc_id").orderBy("doc_id").collect()]
    assert got == want


def test_candidate_order_is_checked(spark):
    df = spark.createDataFrame([(1, 0, "a", 4), (1, 1, "b", 8), (2, 0, "a", 4), (2, 1, "b", 4), (3, 0, "", 4)], "q int, idx int, object_id string, token_end int")
    assert {(r.q, r.reason) for r in lookup.invalid_candidates(df, "q").collect()} == {(2, "unordered"), (3, "empty id")}
    assert {r.q for r in lookup.invalid_candidates(df, "q", most=1).collect()} == {1, 2, 3}


def _resolve(spark, local, remote, busy=False):
    cand = spark.createDataFrame([(1, 0, "x", 4, busy)], "request int, idx int, object_id string, token_end long, busy boolean")
    index = spark.createDataFrame([("x", 4, 10, 7)], "object_id string, token_count long, length long, checksum long")
    loc = spark.createDataFrame(local, "object_id string, tier int, length long, checksum long")
    rem = spark.createDataFrame(remote, "object_id string, node_id string, addr string, tier int, version long, length long, checksum long")
    return lookup.prefix_results(lookup.resolve(cand, index, loc, rem), "request").first()


def test_stop_reasons(spark):
    assert tuple(_resolve(spark, [("x", 2, 10, 7)], [])) == (1, 4, 1, lookup.FULL_MATCH)
    assert _resolve(spark, [("x", 1, 10, 8)], []).stop_reason == lookup.NOT_FOUND
    assert _resolve(spark, [], [("x", "b", "h", 2, 1, 10, 7)]).stop_reason == lookup.FULL_MATCH
    assert _resolve(spark, [("x", 1, 10, 7)], [], True).stop_reason == lookup.BUSY
    # another object of the same block is no match
    assert _resolve(spark, [("y", 1, 10, 7)], [("z", "b", "h", 1, 1, 10, 7)]).stop_reason == lookup.NOT_FOUND


def test_replica_orders(spark):
    df = spark.createDataFrame([("k", "b", "h", 2, 9), ("k", "c", "h", 1, 1), ("k", "a", "h", 1, 5), ("k", "a", "h", 1, 7)], "k string, node_id string, addr string, tier int, version long")
    assert tuple(lookup.best_replica(df, ["k"]).first()) == ("k", "a", "h", 1, 7)
    assert [(r.node_id, r.version) for r in lookup.read_order(df, ["k"]).orderBy("rank").collect()] == [("a", 7), ("a", 5), ("c", 1), ("b", 9)]
    assert {r.node_id for r in lookup.readable(df, "a", "other").collect()} == {"b", "c"}


def test_schedules(spark):
    one = spark.range(1)
    m = lambda matched, n, done: one.select(lookup.scheduled_match(F.lit(matched), F.lit(n), F.lit(done), 16)).first()[0]
    assert (m(48, 48, 0), m(48, 49, 16), m(16, 100, 32), m(0, 0, 0)) == (32, 32, 0, 0)
    ids = F.array(*[F.lit(i) for i in range(10, 16)])
    p = one.select(*[c.alias(k) for k, c in lookup.transfer_plan(ids, 5, F.lit(16), F.lit(48), F.lit(64), 16).items()]).first()
    assert (p.load, p.store) == ([11, 12], [13, 14])


def test_layers_are_joined_in_order(spark):
    df = spark.createDataFrame([(1, 1, b"b"), (1, 0, b"a"), (2, 0, b"a")], "k int, layer int, data binary")
    assert [(r.k, bytes(r.payload)) for r in lookup.saved_blocks(df, ["k"], 2).collect()] == [(1, b"ab")]


def test_failover_and_attempts(spark):
    df = spark.createDataFrame([(1, 1, "a", False, "e1"), (1, 2, "b", True, None), (2, 1, "a", False, "e2")], "k int, rank int, node string, good boolean, error string")
    got = {r.k: (r.node, r.ok, r.last_error) for r in lookup.first_good(df, ["k"], F.col("good")).collect()}
    assert got == {1: ("b", True, None), 2: (None, False, "e2")}


def _events(spark, rows):
    return spark.createDataFrame(rows, "block_id long, node_id string, tier int, kind int, version long, event_time timestamp")


def test_last_writes_and_tombstones(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    e = _events(spark, [(801, "b", 1, 1, 3, t), (801, "b", 1, 2, 5, t), (801, "b", 1, 1, 4, t), (802, "a", 2, 1, 1, t), (803, "a", 1, 1, 0, t)])
    s = catalog.replay(e)
    nodes = spark.createDataFrame([("b", "h:1")], "node_id string, addr string")
    assert [(r.block_id, r.addr) for r in catalog.locations(s, nodes).collect()] == [(802, "")]
    assert catalog.clock(e).first()[0] == 5 and catalog.clock(e.limit(0)).first()[0] == 0
    later = lambda s_: F.lit(t + dt.timedelta(seconds=s_))
    assert catalog.prune(s, later(600)).count() == 2 and catalog.prune(s, later(601)).count() == 1


def test_membership_rules(spark):
    rows = [("a", 1, "register", 0, 1, 10), ("a", 2, "leave", 0, 0, 20), ("a", 3, "heartbeat", 0, 0, 30), ("a", 4, "mark", 0, 2, 40), ("a", 5, "register", 1, 1, 50), ("b", 1, "heartbeat", 0, 0, 5), ("c", 1, "leave", 0, 0, 5), ("d", 1, "upsert", 7, 0, 1), ("d", 2, "upsert", 7, 3, 2), ("d", 3, "mark", 0, 3, 9)]
    df = spark.createDataFrame(rows, "node_id string, seq long, op string, version long, state int, at long")
    got = {r.node_id: (r.state, r.version, r.last_heartbeat, r.rejected) for r in catalog.membership(df).collect()}
    # the first registration of version 0 counts as unseen until a version above 0 is written
    assert got["c"] == (4, 1, 5, 0) and got["d"] == (3, 8, 1, 1) and "b" not in got
    assert got["a"][0] == 1 and got["a"][2] == 50 and got["a"][3] == 2
    assert {r[0] for r in spark.createDataFrame([("", "x", 1), ("n", "", 1), ("n", "", 4)], "i string, a string, s int").select(catalog.node_problem(F.col("i"), F.col("a"), F.col("s"))).collect()} == {"empty id", "empty address", None}


def _nodes(spark, names, state=1):
    return spark.createDataFrame([(n, "h", state, 1) for n in names], "node_id string, addr string, state int, version long")


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_routing_against_brute_force(spark, n):
    r = random.Random(n)
    names = [f"n{i}" for i in range(n)]
    routes = routing.ranges(_nodes(spark, names)).collect()
    assert [int(x.start) for x in routes][0] == 0 and int(routes[-1].end) == (1 << 64) - 1
    assert all(int(a.end) + 1 == int(b.start) for a, b in zip(routes, routes[1:]))
    ids = [0, (1 << 64) - 1, 1 << 63, *(r.getrandbits(64) for _ in range(60))]
    blocks = spark.createDataFrame([(str(i),) for i in ids], "s string").select(F.col("s").cast(binary.U64).alias("b"))
    got = {(int(x.b), x["rank"]): x.node_id for x in routing.locate(blocks, "b", routing.ranges(_nodes(spark, names)), 3).collect()}
    for i in ids:
        at = next(k for k, x in enumerate(routes) if int(x.start) <= i <= int(x.end))
        for k in range(3):
            assert got.get((i, k + 1)) == (routes[(at + k) % n].node_id if k < n else None)
    cover = routing.range_cover(routing.ranges(_nodes(spark, names))).collect()
    spans = sorted((int(c.prefix, 16), int(c.prefix, 16) + (1 << (64 - c.prefix_len)) - 1) for c in cover)
    assert spans[0][0] == 0 and spans[-1][1] == (1 << 64) - 1 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    for x in routes:
        own = sorted(int(c.prefix, 16) for c in cover if c.node_id == x.node_id)
        assert own[0] == int(x.start)


def test_no_alive_node_routes_nothing(spark):
    blocks = spark.createDataFrame([(1,)], "b long")
    assert routing.locate(blocks, "b", routing.ranges(_nodes(spark, ["a"], 3))).count() == 0


def test_ring_against_brute_force(spark):
    from bisect import bisect_left

    points = routing.ring(_nodes(spark, ["a", "b", "c"]), 5)
    ring = sorted((int(p["hash"]), p.node_id) for p in points.collect())
    assert len(ring) == 15
    blocks = spark.range(200).withColumnRenamed("id", "b")
    h = {r.b: int(r.h) for r in blocks.select("b", binary.murmur_finaliser(F.col("b").cast(binary.U64)).alias("h")).collect()}
    got = {r.b: r.node_id for r in routing.locate_ring(blocks, "b", points).collect()}
    for b, v in h.items():
        assert got[b] == ring[bisect_left([x[0] for x in ring], v) % 15][1]


def test_ring_point_at_a_blocks_hash(spark):
    """A point at the very hash is the block's; of two there the lesser node is first. A window from each row to its slice's end isn't used: it is quadratic."""
    blocks = spark.range(1).withColumnRenamed("id", "b")
    h = blocks.select(binary.murmur_finaliser(F.col("b").cast(binary.U64)).alias("hash"))
    points = h.crossJoin(spark.createDataFrame([("y",), ("x",)], "node_id string")).unionAll(h.select((F.col("hash") + 5).cast(binary.U64), F.lit("a")))
    assert routing.locate_ring(blocks, "b", points).first().node_id == "x"
    assert [r.node_id for r in sorted(routing.locate_ring_n(blocks, "b", points, 2).collect(), key=lambda r: r.rank)] == ["x", "y"]
    x = routing.locate_ring(blocks, "b", points)
    assert "unboundedfollowing" not in x._jdf.queryExecution().executedPlan().toString().lower()
    assert routing.locate_ring(blocks, "b", points.limit(0)).first().node_id is None


def test_gates(spark):
    rows = [(1, 1, 2, b"ab", None), (0, 1, 2, b"ab", None), (2, 0, 2, b"ab", None), (3, 1, 0, b"", None), (4, 1, 3, b"ab", None), (5, 1, 2, b"ab", 1)]
    df = spark.createDataFrame(rows, "id long, seq long, n long, p binary, c long").withColumn("c", F.coalesce("c", F.crc32("p")))
    good, bad = integrity.split(df, integrity.ingest_problem(F.col("id"), F.col("seq"), F.col("n"), F.col("p"), F.col("c")))
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.problem for r in bad.collect()} == {0: "zero id", 2: "zero sequence", 3: "zero length", 4: "length mismatch", 5: "checksum mismatch"}


def test_binding_is_once_and_owned(spark):
    rows = [("x", 1, 1024, 77, 1), ("x", 1, 1024, 77, 2), ("x", 1, 2048, 88, 3), ("y", 1, 1024, 77, 4), ("z", 2, 1, 1, 5)]
    df = spark.createDataFrame(rows, "object_id string, block_id long, length long, checksum long, seq int")
    assert [r.outcome for r in integrity.bind(df, "seq").orderBy("seq").collect()] == ["bound", "same", "conflict", "owned", "bound"]
    assert [r.outcome for r in integrity.first_writer(df, "block_id", "seq", ["length", "checksum"]).orderBy("seq").collect()] == ["stored", "duplicate", "conflict", "duplicate", "stored"]


def test_spill_modes(spark):
    for n, want in {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 10: 5}.items():
        df = spark.createDataFrame([("g", i, i, 100) for i in range(n)], "g string, block_id int, last_access int, allocated long")
        head = tiering.spill_plan(df, "g", 50, incoming=10)
        assert head.where("spilled").count() == want
    df = spark.createDataFrame([("g", i, 9 - i, 100) for i in range(10)], "g string, block_id int, last_access int, allocated long")
    # 1,000 allocated, high 900, low 720: the three coldest go
    assert sorted(r.block_id for r in tiering.spill_plan(df, "g", 900).where("spilled").collect()) == [7, 8, 9]
    assert tiering.spill_plan(df, "g", 1000).where("spilled").count() == 0
    assert tiering.watermarks(100, 0, 50) == (50, 40) and tiering.watermarks(1, 1, 0) == (1, 0)
    ev = tiering.spill_events(tiering.spill_plan(df, "g", 900)).collect()
    assert [(e.kind, e.tier) for e in ev[:2]] == [(1, 2), (2, 1)]


def test_eviction_counters(spark):
    df = spark.createDataFrame([(401, 4097, 4104, 1), (402, 8193, 8200, 2)], "block_id long, length long, allocated long, generation int")
    assert tuple(tiering.evict(df, tiering.keep_except([401])).first()) == (2, 12290, 1, 8193, 1)
    assert tuple(tiering.evict(df.limit(0), tiering.keep_all()).first()) == (0, 0, 0, 0, 0)
    assert tiering.compact(df, tiering.keep_generation(2), 64).first().allocated == 8256


def test_leases_against_brute_force(spark):
    r = random.Random(3)
    acq = [(i, r.randint(0, 3), r.randint(0, 50)) for i in range(40)]
    rel = [(i, t + r.randint(-2, 8)) for i, _, t in acq if r.random() < 0.5]
    iv = leases.intervals(spark.createDataFrame(acq, "lease_id long, block_id long, at long"), spark.createDataFrame(rel, "lease_id long, at long"), 5)
    ends = {i: min([t + 5] + [x for j, x in rel if j == i and x >= t]) for i, _, t in acq}
    assert {x.lease_id: x.ends for x in iv.collect()} == ends
    most = {x.block_id: x.most for x in leases.pins(iv).collect()}
    for b in {a[1] for a in acq}:
        want = max(sum(1 for i, k, t in acq if k == b and t <= m < ends[i]) for m in range(60))
        assert most[b] == want or want == 0
    q = [(k, r.randint(0, 3), r.randint(0, 60)) for k in range(60)]
    got = {x.request_id: x.busy for x in leases.mutations(spark.createDataFrame(q, "request_id long, block_id long, at long"), iv).collect()}
    assert got == {k: any(b == c and t <= at < ends[i] for i, c, t in acq) for k, b, at in q}


def test_single_flights(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 5, 6, 20)] + [("b", 3)], "k string, at long")
    assert {r.k: (r.requests, r.flights) for r in leases.single_flights(df, "k", "at", 5).collect()} == {"a": (5, 3), "b": (1, 1)}
