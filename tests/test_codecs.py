"""Frames and files against struct and zlib."""

import struct
import zlib

from pyspark.sql import functions as F

from prefixloom.functions import binary
from prefixloom.sources import blockfiles, frames

BIG = 9402384532672800916


def first(df):
    return df.first()


def test_peer_frames(spark):
    data = b"kv-cache" * 5
    raw = struct.pack("<IHHHHIQQ", frames.PEER_MAGIC, 1, 32, 3, 0, zlib.crc32(data), BIG, len(data)) + data
    made = spark.range(1).select(frames.peer_frame(F.lit(3), F.lit(str(BIG)).cast(binary.U64), F.lit(data)).alias("f")).first().f
    assert bytes(made) == raw
    bad = {"short": raw[:20], "magic": b"x" + raw[1:], "version": raw[:4] + b"\2" + raw[5:], "reserved": raw[:10] + b"\1" + raw[11:], "truncated": raw[:-1], "checksum": raw[:-1] + b"x", None: raw}
    got = frames.parse_peer(spark.createDataFrame([(str(k), v) for k, v in bad.items()], "k string, frame binary")).collect()
    assert {r.k: r.problem for r in got} == {str(k): k for k in bad}
    ok = next(r for r in got if r.problem is None)
    assert (int(ok.block_id), ok.kind, bytes(ok.payload)) == (BIG, 3, data)
    assert frames.parse_peer(spark.createDataFrame([(raw,)], "frame binary"), most=3).first().problem == "too large"


def test_listener_and_local_frames(spark):
    data = b"abc"
    raw = struct.pack("<IHHHHIQQQ", frames.LISTENER_MAGIC, 1, 40, 1, 0, zlib.crc32(data), 5, 6, 3) + data
    rows = [(raw,), (raw[:16] + bytes(8) + raw[24:],), (raw[:24] + bytes(8) + raw[32:],)]
    assert [r.problem for r in frames.parse_listener(spark.createDataFrame(rows, "frame binary").coalesce(1)).collect()] == [None, "zero sequence", "zero id"]
    local = struct.pack("<IHHHHIQQ", frames.LOCAL_MAGIC, 1, 32, 2, 1, 3, 9, 0) + data
    u = lambda x: F.lit(str(x)).cast(binary.U64)
    r = spark.range(1).select(frames.local_frame(F.lit(2), F.lit(1), u(9), F.lit(data)).alias("a"), frames.listener_frame(F.lit(1), u(5), u(6), F.lit(data)).alias("b"), frames.ready_payload(u(BIG), F.lit(8), F.lit(3), F.lit(7), F.lit("shm")).alias("c"), frames.allocate_payload(u(4), F.lit(5)).alias("d"), frames.allocation_payload(u(4), F.lit(6), F.lit(5), F.lit("n")).alias("e")).first()
    assert bytes(r.a) == local and bytes(r.b) == raw
    assert bytes(r.c) == struct.pack("<QQQIHH", BIG, 8, 3, 7, 3, 0) + b"shm"
    one = lambda b, col="payload": spark.createDataFrame([(b,)], f"{col} binary")
    assert first(frames.parse_ready(one(r.c))).name == "shm" and first(frames.parse_ready(one(r.c[:-1]))).problem == "size"
    assert first(frames.parse_allocate(one(r.d))).length == 5 and first(frames.parse_allocate(one(bytes(16)))).problem == "zero id"
    assert first(frames.parse_allocation(one(r.e))).name == "n"
    assert first(frames.parse_local(one(local, "frame"))).flags == 1 and first(frames.parse_local(one(local[:-1], "frame"))).problem == "size"


def test_commit_lookup_result_compute(spark):
    a, b, c = bytes([1]) * 32, bytes([2]) * 32, bytes([3]) * 32
    raw = struct.pack("<H6xQQI4x", 1, 4, 10, 7) + a + b + c
    made = spark.range(1).select(frames.commit_payload(F.lit(4), F.lit(10), F.lit(7), F.lit(a), F.lit(b), F.lit(c)).alias("payload"))
    assert bytes(made.first().payload) == raw
    got = frames.parse_commit(made, F.lit(5)).first()
    assert (got.problem, got.token_count, bytes(got.object_id)) == (None, 4, c)
    assert frames.parse_commit(made, F.lit(0)).first().problem == "incomplete"

    q = struct.pack("<HHI", 1, 0, 2) + a + b + struct.pack("<Q", 4) + c + struct.pack("<Q", 8)
    swapped = struct.pack("<HHI", 1, 0, 2) + a + b + struct.pack("<Q", 8) + c + struct.pack("<Q", 8)
    rows = spark.createDataFrame([(1, q), (2, swapped), (3, q[:-1]), (4, struct.pack("<HHI", 1, 0, 0) + a)], "k int, payload binary")
    got = {r.k: r for r in frames.parse_lookup(rows).collect()}
    assert [got[k].problem for k in (1, 2, 3, 4)] == [None, "unordered or empty", "size", "count"]
    assert [(bytes(e.object_id), e.token_end) for e in got[1].candidates] == [(b, 4), (c, 8)]

    entries = F.array(*[F.struct(F.lit(o).alias("object_id"), F.lit(str(BIG)).cast(binary.U64).alias("block_id"), F.lit(t).alias("token_end"), F.lit(9).alias("length"), F.lit(7).alias("checksum"), F.lit(1).alias("tier"), F.lit(2).alias("transport"), F.lit(n).alias("node_id"), F.lit(h).alias("addr")) for o, t, n, h in ((b, 4, "node-é", "h:1"), (c, 8, "", ""))])
    made = spark.range(1).select(frames.result_payload(F.lit(2), F.lit(8), F.lit("12").cast(binary.U64), F.lit(99), entries).alias("payload")).first().payload
    assert len(made) == 40 + 2 * 68 + len("node-é".encode()) + 3
    rows = spark.createDataFrame([(1, made), (2, made + b"x"), (3, made[:-1]), (4, b"")], "k int, payload binary")
    got = {r.k: r for r in frames.parse_result(rows).collect()}
    assert [got[k].problem for k in (1, 2, 3, 4)] == [None, "trailing bytes", "truncated", "header"]
    e = got[1].entries[0]
    assert (e.node_id, e.addr, int(e.block_id), got[1].stop_reason, int(got[1].lease_id)) == ("node-é", "h:1", BIG, 2, 12)

    made = spark.range(1).select(frames.compute_payload(F.lit("byte_sum"), F.lit(b"")).alias("payload"))
    assert frames.parse_compute(made).first().operator == "byte_sum"
    assert frames.parse_compute(spark.createDataFrame([(struct.pack("<HHI", 0, 0, 0),)], "payload binary")).first().problem == "empty operator"
    put = spark.range(1).select(frames.put_payload(F.lit("3").cast(binary.U64), F.lit(b"xy")).alias("payload"))
    assert bytes(frames.parse_put(put).first().data) == b"xy"


def test_block_files_round_trip_and_corruption(spark, tmp_path):
    payload = b"kv" * 4096
    blocks = spark.createDataFrame([(str(BIG), "9", payload), ("602", "1", b"corrupt")], "block_id string, seq string, payload binary")
    assert blockfiles.write_blocks(blocks, str(tmp_path)).count() == 2
    (bad,) = tmp_path.glob("*602.kvblk")
    bad.write_bytes(bad.read_bytes()[:-1] + b"!")
    (tmp_path / "junk.kvblk").write_bytes(b"junk")
    got = blockfiles.read_blocks(spark, str(tmp_path))
    assert sorted(str(r.problem) for r in got.collect()) == ["None", "None", "short header"]
    kept = blockfiles.verified(got).collect()
    assert [(int(r.block_id), int(r.seq), r.checksum) for r in kept] == [(BIG, 9, zlib.crc32(payload))]


def test_manifests(spark):
    a, b, c = bytes([1]) * 32, bytes([2]) * 32, bytes([3]) * 32
    m = {"block_id": F.lit(str(BIG)).cast(binary.U64), "token_count": F.lit(4), "length": F.lit(256), "checksum": F.lit(7), "scope_digest": F.lit(a), "prefix_digest": F.lit(b), "object_id": F.lit(c)}
    raw = bytes(spark.range(1).select(blockfiles.manifest_bytes(m).alias("x")).first().x)
    head = struct.pack("<IHHQQQI4x", blockfiles.MANIFEST_MAGIC, 1, 140, BIG, 4, 256, 7) + a + b + c
    assert raw == head + struct.pack("<I", zlib.crc32(head))
    rows = spark.createDataFrame([(1, raw), (2, raw[:-1]), (3, raw[:50] + b"x" + raw[51:])], "k int, content binary")
    assert {r.k: r.problem for r in blockfiles.parse_manifests(rows).collect()} == {1: None, 2: "header", 3: "checksum"}
