"""Composites of a store against hand-made traces, what no query's SQL can express, and bounded streams."""

import random

from pyspark.sql import functions as F

from prefixloom.functions import binary
from prefixloom.operators import lookup, routing, store
from prefixloom.operators.numbering import numbered
from prefixloom.sources import blockfiles, frames
from prefixloom.streaming import replay


def test_numbers_are_those_of_one_sort(spark):
    r = random.Random(1)
    rows = [(r.randrange(30), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a", "b"]).collect()
    assert sorted((x.a, x.b, x.number) for x in got) == [(a, b, i + 1) for i, (a, b) in enumerate(sorted(rows))]


def test_ring_candidates_by_walking_the_ring(spark):
    r = random.Random(2)
    points = [(r.randrange(1 << 64), f"n{r.randrange(6)}") for _ in range(60)]
    df = spark.createDataFrame([(str(h), n) for h, n in points], "hash string, node_id string").select(F.col("hash").cast(binary.U64).alias("hash"), "node_id")
    keys = spark.range(40)
    hashed = {x.id: int(x.h) for x in keys.select("id", binary.murmur_finaliser(F.col("id").cast(binary.U64)).alias("h")).collect()}
    ring = sorted(points)
    for n in (1, 3, 10):
        want = set()
        for k, h in hashed.items():
            start = next((i for i, (p, _) in enumerate(ring) if p >= h), 0)
            seen = list(dict.fromkeys(ring[(start + i) % len(ring)][1] for i in range(len(ring))))[:n]
            want |= {(k, i + 1, node) for i, node in enumerate(seen)}
        assert {tuple(x) for x in routing.locate_ring_n(keys, "id", df, n).collect()} == want


def test_replies(spark):
    u = F.lit("9").cast(binary.U64)
    x = spark.range(1).select(F.explode(F.array(frames.ack_frame(u), frames.error_frame(u, F.lit("é" * 3000)), frames.error_frame(u, F.lit(None).cast("string")), frames.peer_frame(F.lit(2), u, F.lit(b"x")), frames.peer_frame(F.lit(7), u, F.lit(b"x")))).alias("frame"))
    got = frames.parse_reply(x).collect()
    assert [r.problem for r in got] == [None, None, None, "kind", "payload"]
    assert got[0].acknowledged and got[0].error is None and got[2].error == "unknown error"
    assert len(got[1].error) == 2048 and not got[1].acknowledged


def test_block_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, bytes([i]) * i) for i in range(1, 8)], "block_id long, seq long, payload binary")
    assert blockfiles.write_blocks(rows, str(tmp_path)).count() == 7
    (tmp_path / "short.kvblk").write_bytes(b"abc")
    cut = next(tmp_path.glob("*03.kvblk"))
    cut.write_bytes(cut.read_bytes()[:-1])
    bad = next(tmp_path.glob("*05.kvblk"))
    bad.write_bytes(bad.read_bytes()[:-1] + b"!")
    heads = blockfiles.scan_headers(spark, str(tmp_path))
    assert blockfiles.stats(heads).first()[:] == (6, 25, 2)
    assert {int(r.block_id): len(r.payload) for r in blockfiles.opened(heads, rows).collect()} == {i: i for i in (1, 2, 4, 6, 7)}
    files = heads.where("block_id in (1, 2)").select("path").cache()
    assert [r.deleted for r in blockfiles.delete_files(files).collect()] == [True, True]
    assert [r.deleted for r in blockfiles.delete_files(files).collect()] == [False, False]
    assert blockfiles.stats(blockfiles.scan_headers(spark, str(tmp_path))).first().blocks == 4


def test_reuse_aggregates_before_it_joins(spark):
    keys = spark.createDataFrame([(i, 0, 16, b"%032d" % (i % 2)) for i in range(20)], "r long, idx int, token_end long, object_id binary")
    x = lookup.seen_before(keys, "r")
    assert "Window" not in x._jdf.queryExecution().executedPlan().toString()
    assert {y.r for y in x.where("not hit").collect()} == {0, 1}


def test_zipped_refuses_other_lengths(spark):
    rows = spark.createDataFrame([(1, [1, 2], [3, 4]), (2, [1], [2, 3]), (3, [], [])], "k int, a array<int>, b array<int>")
    assert [tuple(r) for r in store.zipped(rows, ["k"], x="a", y="b").collect()] == [(1, 0, 1, 3), (1, 1, 2, 4)]


def test_pins_end_by_release_and_by_timer(spark, tmp_path):
    schema = "block_id long, lease_id long, op string, at timestamp"
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))

    def put(name, rows):
        out = None
        for b, i, op, s in rows:
            x = spark.range(1).select(F.lit(b).cast("long").alias("block_id"), F.lit(i).cast("long").alias("lease_id"), F.lit(op).alias("op"), at(s).alias("at"))
            out = x if out is None else out.unionAll(x)
        out.coalesce(1).write.parquet(str(tmp_path / "log" / name))

    put("a", [(1, 1, "acquire", 0), (1, 2, "acquire", 1), (2, 3, "acquire", 1)])
    put("b", [(1, 1, "release", 2), (3, 9, "acquire", 100)])  # by then the leases of 1 and 2 are over, but for the watermark
    put("c", [(3, 9, "release", 103), (4, 8, "acquire", 200)])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "log"))
    out = replay.drain(replay.pins(stream, ttl_s=5, late="1 second"), "update", "pins").collect()
    seen = {b: [r.pins for r in out if r.block_id == b] for b in (1, 2, 3)}
    assert {2, 0} <= set(seen[1]) and {1, 0} <= set(seen[2]) and {1, 0} <= set(seen[3]), seen


def test_tombstones_expire(spark, tmp_path):
    schema = "block_id long, node_id string, tier int, kind int, version long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    write([(1, "n", 1, 1, 5), (2, "n", 1, 1, 5)])
    changes: list = []
    x = replay.expiring_locations(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), 3)
    q = x.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").foreachBatch(lambda b, _: changes.extend(b.collect())).start()
    import time

    def until(n):
        end = time.time() + 60
        while len(changes) < n and time.time() < end:
            time.sleep(0.2)

    try:
        until(2)
        write([(1, "n", 1, 2, 9)])
        until(3)
        # while the tombstone lives an older upsert is late; when it has expired, the version is forgotten with it
        write([(1, "n", 1, 1, 7)])
        until(4)
        time.sleep(6)
        write([(1, "n", 1, 1, 8)])
        until(5)
    finally:
        q.stop()
    mine = [(c.kind, c.version) for c in changes if c.block_id == 1]
    assert mine == [(1, 5), (2, 9), (2, 9), (1, 8)]
