"""Golden vectors and properties of identities."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.functions import binary, keys, kv
from prefixloom.operators import compute

GOLDEN = keys.Scope("tenant-a", "qwen2.5-7b", "abc123", "fp32", 2, 4, 8, 4, adapter_id="lora-a")
# the domain under which the golden vectors were made
DOMAIN = bytes.fromhex("7a65726f6b762e6b7663616368652e").decode()[:-1]
TOKENS = [101, 2023, 2003, 1037, 3231, 102]


def key_rows(spark, scope, tokens, complete_only=False):
    df = spark.createDataFrame([(1, tokens)], "id long, tokens array<long>")
    x = keys.chunk_keys(df, keys.scope_digest(scope.columns(), DOMAIN), scope.chunk_size, keys.packed(F.col("tokens")), complete_only, DOMAIN)
    return keys.shown(x).orderBy("idx").collect()


def by_hand(scope_digest: bytes, tokens, chunk):
    prefix, out = bytes(32), []
    for b in range(0, len(tokens), chunk):
        own = tokens[b : b + chunk]
        prefix = hashlib.sha256(keys.tag("prefix", DOMAIN) + scope_digest + prefix + struct.pack(f"<I{len(own)}I", len(own), *own)).digest()
        out.append(hashlib.sha256(keys.tag("object", DOMAIN) + scope_digest + prefix + struct.pack("<Q", b + len(own))).hexdigest())
    return out


def test_golden_vector(spark):
    a, b = key_rows(spark, GOLDEN, TOKENS)
    assert a.scope_digest == "965a666ddfbc9f1440089bced64913d9ed8d8da784028617ea75042c34b94623"
    assert a.prefix_digest == "656e4d82346551ff6379c043819b1f3a947abea0f85fb64f8b14c42762675731"
    assert a.object_id == "94e8969feafa7b823322771145804d1e37df2a73ac9a47184357aa40c92eb7b7"
    assert int(a.block_id) == 9402384532672800916
    assert b.prefix_digest == "f31e8f16663b1bccae2680d7a6632d2a4f18c78a57243c022205a66fd2622148"
    assert (b.object_id, int(b.block_id)) == ("761c050c27930384a5e85e59274c21905366d39480b94390a50bc5f183009b0f", 9512608633851288694)
    assert (b.token_begin, b.token_end) == (4, 6)
    assert len(key_rows(spark, GOLDEN, TOKENS, True)) == 1
    assert key_rows(spark, GOLDEN, [1, 2, 3], True) == [] and key_rows(spark, GOLDEN, [], False) == []


def test_prefixes_are_shared_up_to_the_first_difference(spark):
    a = key_rows(spark, GOLDEN, [1, 2, 3, 4, 5, 6, 7, 8])
    b = key_rows(spark, GOLDEN, [1, 2, 3, 4, 99, 6, 7, 8])
    assert a[0].object_id == b[0].object_id and a[1].object_id != b[1].object_id
    from dataclasses import replace

    for other in (replace(GOLDEN, model_revision="def456"), replace(GOLDEN, heads=5)):
        assert not {r.object_id for r in key_rows(spark, other, TOKENS)} & {r.object_id for r in key_rows(spark, GOLDEN, TOKENS)}


def test_long_chain_crosses_strides(spark):
    tokens = [int(x) for x in np.random.default_rng(1).integers(0, 1 << 32, 4 * 600 + 3)]
    got = key_rows(spark, GOLDEN, tokens)
    assert [r.object_id for r in got] == by_hand(bytes.fromhex(got[0].scope_digest), tokens, 4)


def test_invalid_scopes_are_named(spark):
    from dataclasses import replace

    bad = {"rank out of range": replace(GOLDEN, tp_rank=1), "empty namespace": replace(GOLDEN, namespace=""), "zero chunk_size": replace(GOLDEN, chunk_size=0), "version": replace(GOLDEN, version=2), None: GOLDEN}
    for why, scope in bad.items():
        assert spark.range(1).select(keys.scope_problem(scope.columns())).first()[0] == why


def test_byte_tokens_and_previews(spark):
    df = spark.createDataFrame([("aé",)], "t string")
    r = df.select(F.hex(keys.byte_tokens(F.col("t"))), binary.hex_preview(F.col("t").cast("binary"), 2)).first()
    assert r[0] == "61000000C3000000A9000000" and r[1] == "61c3..."


def test_unsigned_arithmetic(spark):
    r = np.random.default_rng(2)
    xs = [0, 1, (1 << 64) - 1, 1 << 63, *(int(x) for x in r.integers(0, 1 << 64, 20, dtype=np.uint64))]

    def final(x):
        for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ x >> 33) * f) % (1 << 64)
        return x ^ x >> 33

    df = spark.createDataFrame([(str(x),) for x in xs], "s string").select("s", F.col("s").cast(binary.U64).alias("x"))
    got = df.select("s", binary.murmur_finaliser(F.col("x")).alias("h"), F.hex(binary.le_u64(F.col("x"))).alias("b")).collect()
    assert {int(g.s): int(g.h) for g in got} == {x: final(x) for x in xs}
    assert all(g.b == struct.pack("<Q", int(g.s)).hex().upper() for g in got)

    def fnv(s):
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return final(h)

    names = ["", "node-1#0", "é#99"]
    got = spark.createDataFrame([(n,) for n in names], "s string").select("s", binary.ring_hash(F.col("s")).alias("h")).collect()
    assert {g.s: int(g.h) for g in got} == {n: fnv(n) for n in names}


def test_tensor_values_and_payload(spark):
    def one(token, i, layer, kind, head, dim):
        m = (token * 1664525 + (i + 1) * 1013904223 + (layer + 1) * 2654435761 + head * 2246822519 + dim * 3266489917 + kind * 668265263) % (1 << 32)
        v = np.float32(m & 0xFFFF) / np.float32(65535)
        return v if kind == 0 else -v

    tokens = [7, 4294967295, 0, 99]
    df = spark.createDataFrame([(tokens, 32)], "t array<long>, b long").select(kv.chunk_payload(F.col("t"), F.col("b"), 2, 2, 3).alias("p"), F.crc32(kv.chunk_payload(F.col("t"), F.col("b"), 2, 2, 3)).alias("c"))
    r = df.first()
    want = np.array([one(t, 32 + i, la, k, h, d) for la in range(2) for i, t in enumerate(tokens) for k in range(2) for h in range(2) for d in range(3)], "<f4")
    assert bytes(r.p) == want.tobytes() and r.c == zlib.crc32(want.tobytes())
    v = spark.createDataFrame([(4294967295, 5)], "t long, i long").select(kv.value(F.col("t"), F.col("i"), F.lit(1), F.lit(1), F.lit(1), F.lit(2))).first()[0]
    assert v == pytest.approx(float(one(4294967295, 5, 1, 1, 1, 2)), rel=1e-6)


def test_compute_reports_errors_as_rows(spark):
    df = spark.createDataFrame([(1, "byte_sum", b"", b"\x01\xff"), (2, "nope", b"", b"a"), (3, "byte_sum", b"x", b"a"), (4, "byte_sum", b"", None)], "id int, operator string, params binary, payload binary")
    got = {r.id: (r.result and int(r.result), r.error) for r in compute.compute(df).collect()}
    assert got == {1: (256, None), 2: (None, "unknown operator"), 3: (None, "unexpected parameters"), 4: (None, "not found")}


def test_checksums_and_low_bits_without_a_row_a_byte(spark):
    """Whole texts at once agree with the tensor and the value of each token, over borders of what a task holds; index halves wrap."""
    texts = [(1, "a" * 15), (2, "héllo wörld, again"), (3, "".join(chr(32 + i * i % 90) for i in range(70_000)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    raw = {i: t.encode() for i, t in texts}
    got = kv.chunk_checksums(df.select("doc_id", F.col("text").cast("binary").alias("text")), "text", 16, 2, 2, 4).collect()
    assert {(r.doc_id, r.idx) for r in got} == {(i, c) for i, t in raw.items() for c in range(len(t) // 16)} and {r.length for r in got} == {2048}
    some = [r for r in got if r.idx in (0, 1, 1023, 1024, 4097)]
    rows = spark.createDataFrame([(r.doc_id, r.idx, list(raw[r.doc_id][16 * r.idx : 16 * r.idx + 16]), 16 * r.idx) for r in some], "d long, idx int, t array<long>, b long")
    want = {(r.d, r.idx): r.c for r in rows.select("d", "idx", F.crc32(kv.chunk_payload(F.col("t"), F.col("b"), 2, 2, 4)).alias("c")).collect()}
    assert {(r.doc_id, r.idx): r.checksum for r in some} == want
    low = {r.doc_id: (r.s.low_sum, r.s.low_max) for r in df.select("doc_id", kv.low_bits(F.col("text"), 1, 1, 1, 3).alias("s")).collect()}
    for i, t in raw.items():
        each = [(x * 1664525 + (n + 1) * 1013904223 + 2 * 2654435761 + 2246822519 + 3 * 3266489917 + 668265263) & 0xFFFF for n, x in enumerate(t)]
        assert low[i] == (sum(each), max(each))
    assert spark.createDataFrame([("",), (None,)], "t string").select(kv.low_bits(F.col("t"), 1, 1, 1, 3).alias("s")).where("s.low_sum is not null").count() == 0


def test_chains_are_cut_into_bounded_batches(spark):
    text = "".join(chr(97 + i % 26) for i in range(4 * (keys.CHUNKS_AT_ONCE + 3)))
    df = spark.createDataFrame([(1, "abcd"), (2, None), (3, text)], "id long, text string")
    got = keys.chunk_keys(df, F.lit(bytes(32)), 4, F.col("text").cast("binary"), domain=DOMAIN, width=1, less=("text",)).collect()
    assert [r.object_id.hex() for r in got if r.id == 3] == by_hand(bytes(32), text.encode(), 4) and sum(r.id != 3 for r in got) == 1
    assert got[0].asDict().keys() == {"id", "scope_digest", "idx", "token_begin", "token_end", "prefix_digest", "object_id"}
