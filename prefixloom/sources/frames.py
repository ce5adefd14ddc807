"""Wire frames as BINARY columns: builders and parsers made of built-in expressions. A parser gives a problem, or null and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.binary import U64, le, le_u64, piece, uint

PEER_MAGIC, PEER_HEADER = 0x4E50564B, 32
LISTENER_MAGIC, LISTENER_HEADER = 0x414D4452, 40
LOCAL_MAGIC, LOCAL_HEADER = 0x5043564B, 32
COMMIT_SIZE, LOOKUP_HEADER, CANDIDATE, RESULT_HEADER, ENTRY = 128, 40, 40, 40, 68
MOST_CANDIDATES, MOST_OPERATOR = 8192, 128
MOST_BLOCK = 1 << 30
_ZERO = bytes(32)


def _u64(data: Column, offset: int) -> Column:
    return uint(data, offset, 8)


def peer_frame(kind: Column, block_id: Column, payload: Column) -> Column:
    head = F.concat(le(F.lit(PEER_MAGIC), 4), le(F.lit(1), 2), le(F.lit(PEER_HEADER), 2), le(kind, 2), F.lit(bytes(2)), le(F.crc32(payload), 4), le_u64(block_id), le(F.octet_length(payload), 8))
    return F.concat(head, payload)


def _header(c: Column, magic: int, size: int) -> Column:
    return F.when(F.octet_length(c) < size, "short").when(uint(c, 0, 4) != magic, "magic").when(uint(c, 4, 2) != 1, "version").when(uint(c, 6, 2) != size, "header size")


def _payload(problem: Column, c: Column, size: int, length: Column, checksum: Column, most: int) -> Column:
    own = F.substring(c, F.lit(size + 1), F.octet_length(c))
    return problem.when(length > most, "too large").when(F.octet_length(own) != length, "truncated").when((length > 0) & (F.crc32(own) != checksum), "checksum")


def _parsed(df: DataFrame, problem: Column, fields: dict[str, Column]) -> DataFrame:
    x = df.withColumn("problem", problem)
    return x.withColumns({k: F.when(F.col("problem").isNull(), v) for k, v in fields.items()})


def parse_peer(frames: DataFrame, column: str = "frame", most: int = MOST_BLOCK) -> DataFrame:
    c = F.col(column)
    problem = _header(c, PEER_MAGIC, PEER_HEADER).when(uint(c, 10, 2) != 0, "reserved")
    problem = _payload(problem, c, PEER_HEADER, _u64(c, 24), uint(c, 12, 4), most)
    return _parsed(frames, problem, {"kind": uint(c, 8, 2), "block_id": _u64(c, 16), "checksum": uint(c, 12, 4), "payload": F.substring(c, F.lit(PEER_HEADER + 1), F.octet_length(c))})


def listener_frame(kind: Column, seq: Column, block_id: Column, payload: Column) -> Column:
    head = F.concat(le(F.lit(LISTENER_MAGIC), 4), le(F.lit(1), 2), le(F.lit(LISTENER_HEADER), 2), le(kind, 2), F.lit(bytes(2)), le(F.crc32(payload), 4), le_u64(seq), le_u64(block_id), le(F.octet_length(payload), 8))
    return F.concat(head, payload)


def parse_listener(frames: DataFrame, column: str = "frame", most: int = MOST_BLOCK) -> DataFrame:
    c = F.col(column)
    problem = _header(c, LISTENER_MAGIC, LISTENER_HEADER).when(uint(c, 10, 2) != 0, "reserved").when(_u64(c, 16) == 0, "zero sequence").when(_u64(c, 24) == 0, "zero id").when(_u64(c, 32) == 0, "zero length")
    problem = _payload(problem, c, LISTENER_HEADER, _u64(c, 32), uint(c, 12, 4), most)
    return _parsed(frames, problem, {"kind": uint(c, 8, 2), "seq": _u64(c, 16), "block_id": _u64(c, 24), "checksum": uint(c, 12, 4), "payload": F.substring(c, F.lit(LISTENER_HEADER + 1), F.octet_length(c))})


def put_payload(seq: Column, data: Column) -> Column:
    return F.concat(le_u64(seq), data)


def parse_put(rows: DataFrame, column: str = "payload") -> DataFrame:
    c = F.col(column)
    problem = F.when(F.octet_length(c) < 9, "short").when(_u64(c, 0) == 0, "zero sequence")
    return _parsed(rows, problem, {"seq": _u64(c, 0), "data": F.substring(c, F.lit(9), F.octet_length(c))})


def commit_payload(token_count: Column, length: Column, checksum: Column, scope: Column, prefix: Column, object_: Column) -> Column:
    return F.concat(le(F.lit(1), 2), F.lit(bytes(6)), le(token_count, 8), le(length, 8), le(checksum, 4), F.lit(bytes(4)), scope, prefix, object_)


def parse_commit(rows: DataFrame, block_id: Column, column: str = "payload") -> DataFrame:
    c = F.col(column)
    empty = (F.coalesce(block_id, F.lit(0)) == 0) | (_u64(c, 8) == 0) | (_u64(c, 16) == 0) | (piece(c, 96, 32) == F.lit(_ZERO))
    problem = F.when((F.octet_length(c) != COMMIT_SIZE) | (uint(c, 0, 2) != 1), "header").when(empty, "incomplete")
    return _parsed(rows, problem, {"token_count": _u64(c, 8).cast("bigint"), "length": _u64(c, 16).cast("bigint"), "checksum": uint(c, 24, 4), "scope_digest": piece(c, 32, 32), "prefix_digest": piece(c, 64, 32), "object_id": piece(c, 96, 32)})


def lookup_payload(scope: Column, candidates: Column) -> Column:
    """candidates: ARRAY<STRUCT<object_id BINARY, token_end BIGINT>>."""
    body = F.unhex(F.array_join(F.transform(candidates, lambda e: F.hex(F.concat(e["object_id"], le(e["token_end"], 8)))), ""))
    return F.concat(le(F.lit(1), 2), F.lit(bytes(2)), le(F.size(candidates), 4), scope, body)


def parse_lookup(rows: DataFrame, column: str = "payload") -> DataFrame:
    c = F.col(column)
    n = uint(c, 4, 4)
    bad = F.when((F.octet_length(c) < LOOKUP_HEADER) | (uint(c, 0, 2) != 1), "header").when((n == 0) | (n > MOST_CANDIDATES), "count").when(F.octet_length(c) != n * CANDIDATE + LOOKUP_HEADER, "size").when(piece(c, 8, 32) == F.lit(_ZERO), "zero scope")
    x = rows.withColumn("__bad", bad)
    entry = lambda i: F.struct(piece(c, i * CANDIDATE + LOOKUP_HEADER, 32).alias("object_id"), uint(c, i * CANDIDATE + LOOKUP_HEADER + 32, 8).cast("bigint").alias("token_end"))
    x = x.withColumn("candidates", F.when(F.col("__bad").isNull(), F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), entry)))
    ends = F.col("candidates.token_end")
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    ordered = F.forall(F.zip_with(ends, before, lambda a, b: a > b), lambda ok: ok) & F.forall("candidates", lambda e: e["object_id"] != F.lit(_ZERO))
    problem = F.when(F.col("__bad").isNotNull(), F.col("__bad")).when(~ordered, "unordered or empty")
    x = x.withColumn("problem", problem)
    return x.withColumns({"scope_digest": F.when(F.col("problem").isNull(), piece(c, 8, 32)), "candidates": F.when(F.col("problem").isNull(), F.col("candidates"))}).drop("__bad")


def result_payload(stop_reason: Column, matched: Column, lease_id: Column, expires: Column, entries: Column) -> Column:
    """entries: ARRAY<STRUCT<object_id, block_id, token_end, length, checksum, tier, transport, node_id, addr>>."""

    def one(e: Column) -> Column:
        node, addr = e["node_id"].cast("binary"), e["addr"].cast("binary")
        return F.hex(F.concat(e["object_id"], le_u64(e["block_id"]), le(e["token_end"], 8), le(e["length"], 8), le(e["checksum"], 4), le(e["tier"], 2), le(e["transport"], 2), le(F.octet_length(node), 2), le(F.octet_length(addr), 2), node, addr))

    body = F.unhex(F.array_join(F.transform(entries, one), ""))
    head = F.concat(le(F.lit(1), 2), le(stop_reason, 2), le(F.size(entries), 4), le(matched, 8), le_u64(lease_id), le(expires, 8), F.lit(bytes(8)))
    return F.concat(head, body)


def parse_result(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Entries have variable lengths: a fold that carries the offset."""
    c = F.col(column)
    n, size = uint(c, 4, 4), F.octet_length(c)
    kind = "struct<object_id:binary,block_id:decimal(20,0),token_end:bigint,length:bigint,checksum:bigint,tier:int,transport:int,node_id:string,addr:string>"
    start = F.struct(F.lit(RESULT_HEADER).alias("at"), F.lit(False).alias("bad"), F.array().cast(f"array<{kind}>").alias("entries"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        short = s["bad"] | (size - at < ENTRY)
        node, addr = uint(c, at + 64, 2).cast("int"), uint(c, at + 66, 2).cast("int")
        short = F.coalesce(short | (size - at - ENTRY < node + addr), F.lit(True))
        e = F.struct(
            piece(c, at, 32).alias("object_id"), uint(c, at + 32, 8).alias("block_id"), uint(c, at + 40, 8).cast("bigint").alias("token_end"), uint(c, at + 48, 8).cast("bigint").alias("length"), uint(c, at + 56, 4).alias("checksum"),
            uint(c, at + 60, 2).cast("int").alias("tier"), uint(c, at + 62, 2).cast("int").alias("transport"), piece(c, at + ENTRY, node).cast("string").alias("node_id"), piece(c, at + ENTRY + node, addr).cast("string").alias("addr"),
        ).cast(kind)
        return F.struct(F.when(short, at).otherwise(at + ENTRY + node + addr).cast("int").alias("at"), short.alias("bad"), F.when(short, s["entries"]).otherwise(F.concat(s["entries"], F.array(e))).alias("entries"))

    bad = F.when((size < RESULT_HEADER) | (uint(c, 0, 2) != 1), "header").when(n > MOST_CANDIDATES, "count")
    none = F.array().cast("array<int>")
    x = rows.withColumn("__bad", bad)
    x = x.withColumn("__r", F.when(F.col("__bad").isNull(), F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(none), start, step)))
    problem = F.when(F.col("__bad").isNotNull(), F.col("__bad")).when(F.col("__r.bad"), "truncated").when(F.col("__r.at") != size, "trailing bytes")
    return _parsed(x, problem, {"stop_reason": uint(c, 2, 2), "matched_tokens": _u64(c, 8).cast("bigint"), "lease_id": _u64(c, 16), "expires": _u64(c, 24).cast("bigint"), "entries": F.col("__r.entries")}).drop("__bad", "__r")


def compute_payload(operator: Column, params: Column) -> Column:
    name = operator.cast("binary")
    return F.concat(le(F.octet_length(name), 2), F.lit(bytes(2)), le(F.octet_length(params), 4), name, params)


def parse_compute(rows: DataFrame, column: str = "payload") -> DataFrame:
    c = F.col(column)
    n, p = uint(c, 0, 2).cast("int"), uint(c, 4, 4)
    problem = F.when(F.octet_length(c) < 8, "short").when(uint(c, 2, 2) != 0, "reserved").when(n == 0, "empty operator").when(n > MOST_OPERATOR, "operator too long").when(F.octet_length(c) != n + p + 8, "size")
    return _parsed(rows, problem, {"operator": piece(c, 8, n).cast("string"), "params": piece(c, n + 8, p)})


ERROR, ACK = 3, 7


def error_payload(message: Column) -> Column:
    """At most 4,096 bytes of UTF-8; an error that has no message is unknown."""
    return F.substring(F.coalesce(message, F.lit("unknown error")).cast("binary"), 1, 4096)


def error_frame(block_id: Column, message: Column) -> Column:
    return peer_frame(F.lit(ERROR), block_id, error_payload(message))


def ack_frame(block_id: Column) -> Column:
    return peer_frame(F.lit(ACK), block_id, F.lit(b""))


def parse_reply(frames: DataFrame, column: str = "frame") -> DataFrame:
    """frames with (problem, block_id, acknowledged, error): the replies to a request. An acknowledgement has no payload."""
    x = parse_peer(frames, column)
    problem = F.coalesce(F.col("problem"), F.when(~F.col("kind").isin(ACK, ERROR), "kind"), F.when((F.col("kind") == ACK) & (F.octet_length("payload") > 0), "payload"))
    x = x.withColumn("problem", problem)
    ok = F.col("problem").isNull()
    x = x.withColumns({"acknowledged": ok & (F.col("kind") == ACK), "error": F.when(ok & (F.col("kind") == ERROR), F.col("payload").cast("string"))})
    return x.drop("kind", "checksum", "payload")


def local_frame(kind: Column, flags: Column, seq: Column, payload: Column) -> Column:
    return F.concat(le(F.lit(LOCAL_MAGIC), 4), le(F.lit(1), 2), le(F.lit(LOCAL_HEADER), 2), le(kind, 2), le(flags, 2), le(F.octet_length(payload), 4), le_u64(seq), F.lit(bytes(8)), payload)


def parse_local(frames: DataFrame, column: str = "frame") -> DataFrame:
    c = F.col(column)
    problem = _header(c, LOCAL_MAGIC, LOCAL_HEADER).when(F.octet_length(c) != uint(c, 12, 4) + LOCAL_HEADER, "size")
    return _parsed(frames, problem, {"kind": uint(c, 8, 2), "flags": uint(c, 10, 2), "seq": _u64(c, 16), "payload": F.substring(c, F.lit(LOCAL_HEADER + 1), F.octet_length(c))})


def ready_payload(block_id: Column, offset: Column, length: Column, checksum: Column, name: Column) -> Column:
    raw = name.cast("binary")
    return F.concat(le_u64(block_id), le(offset, 8), le(length, 8), le(checksum, 4), le(F.octet_length(raw), 2), F.lit(bytes(2)), raw)


def parse_ready(rows: DataFrame, column: str = "payload") -> DataFrame:
    c = F.col(column)
    n = uint(c, 28, 2).cast("int")
    problem = F.when(F.octet_length(c) < 32, "short").when(F.octet_length(c) != n + 32, "size").when(n == 0, "empty name")
    return _parsed(rows, problem, {"block_id": _u64(c, 0), "offset": _u64(c, 8).cast("bigint"), "length": _u64(c, 16).cast("bigint"), "checksum": uint(c, 24, 4), "name": piece(c, 32, n).cast("string")})


def allocate_payload(block_id: Column, length: Column) -> Column:
    return F.concat(le_u64(block_id), le(length, 8))


def parse_allocate(rows: DataFrame, column: str = "payload") -> DataFrame:
    c = F.col(column)
    problem = F.when(F.octet_length(c) != 16, "size").when(_u64(c, 0) == 0, "zero id").when(_u64(c, 8) == 0, "zero length")
    return _parsed(rows, problem, {"block_id": _u64(c, 0), "length": _u64(c, 8).cast("bigint")})


def allocation_payload(block_id: Column, offset: Column, length: Column, name: Column) -> Column:
    raw = name.cast("binary")
    return F.concat(le_u64(block_id), le(offset, 8), le(length, 8), le(F.octet_length(raw), 2), F.lit(bytes(6)), raw)


def parse_allocation(rows: DataFrame, column: str = "payload") -> DataFrame:
    c = F.col(column)
    n = uint(c, 24, 2).cast("int")
    problem = F.when(F.octet_length(c) < 32, "short").when(F.octet_length(c) != n + 32, "size").when((_u64(c, 0) == 0) | (_u64(c, 16) == 0), "zero field").when(n == 0, "empty name")
    return _parsed(rows, problem, {"block_id": _u64(c, 0), "offset": _u64(c, 8).cast("bigint"), "length": _u64(c, 16).cast("bigint"), "name": piece(c, 32, n).cast("string")}).withColumn("block_id", F.col("block_id").cast(U64))
