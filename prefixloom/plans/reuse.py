"""Queries about identities and prefix reuse: chunk keys, reuse reports, longest prefixes, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixloom.functions import binary, keys, kv
from prefixloom.operators import compute, lookup
from prefixloom.plans import sql
from prefixloom.plans.registry import query

SCOPE = keys.Scope("tenant-a", "model-7b", "rev-1", "fp16", layers=2, heads=2, head_dim=4, chunk_size=16)
TURNS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scope_column(scope: keys.Scope = SCOPE) -> Column:
    return keys.scope_digest(scope.columns())


def text_keys(texts: DataFrame, scope: keys.Scope = SCOPE, complete_only: bool = True) -> DataFrame:
    """Chunk keys of (request, text), byte by byte."""
    x = keys.spread(texts.where("text is not null"))
    return keys.chunk_keys(x, scope_column(scope), scope.chunk_size, F.col("text").cast("binary"), complete_only, width=1, less=("text",))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, conv_id, turn, text): the conversation up to each user turn."""
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    x = c.withColumn("text", F.array_join(F.collect_list(line).over(w), ""))
    return x.where("role = 'user'").select((F.col("conv_id") * TURNS + F.col("turn")).alias("request_id"), "conv_id", "turn", "text")


TURNS_SQL = f"""SELECT request_id, conv_id, turn, text FROM (SELECT conv_id * {TURNS} + turn AS request_id, conv_id, turn, role,
 string_agg(coalesce(role, '') || ': ' || coalesce(text, '') || chr(10), '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn) AS text FROM conversations) WHERE role = 'user'"""


def _report_sql(source: str, request: str) -> str:
    return f"""WITH RECURSIVE {sql.chain(source, request, SCOPE)},
h AS (SELECT *, min({request}) OVER (PARTITION BY object) < {request} AS hit FROM c),
f AS (SELECT *, min(hit::INT) OVER (PARTITION BY {request} ORDER BY idx) = 1 AS inside FROM h),
g AS (SELECT {request}, count(*) FILTER (inside) AS hit_blocks, count(*) FILTER (NOT inside) AS written_blocks, max(token_end) FILTER (inside) AS m FROM f GROUP BY 1)
SELECT {request}, coalesce(m, 0)::BIGINT AS matched_tokens, (n - coalesce(m, 0))::BIGINT AS computed_tokens, coalesce(hit_blocks, 0)::BIGINT AS hit_blocks, coalesce(written_blocks, 0)::BIGINT AS written_blocks
FROM p LEFT JOIN g USING ({request})"""


def _report(texts: DataFrame, request: str) -> DataFrame:
    totals = texts.where("text is not null").select(request, F.octet_length("text").cast("bigint").alias("tokens"))
    return lookup.reuse_report(text_keys(texts.select(request, "text")).select(request, "idx", "token_end", "object_id"), request, totals, "tokens")


@query("reuse_report", _report_sql("SELECT doc_id, text FROM documents", "doc_id"))
def reuse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(documents(spark, sf_dir), "doc_id")


@query("reuse_conversations", _report_sql(TURNS_SQL, "request_id"))
def reuse_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(turns(spark, sf_dir), "request_id")


_BLOCK = "('0x' || " + " || ".join(f"substr(object, {2 * i + 1}, 2)" for i in reversed(range(8))) + ")::UBIGINT::DECIMAL(20,0)"


@query("chunk_keys", f"""WITH RECURSIVE {sql.chain('SELECT doc_id, text FROM documents', 'doc_id', SCOPE)}
SELECT doc_id, idx::INT AS idx, token_end - {SCOPE.chunk_size} AS token_begin, token_end, prefix AS prefix_digest, object AS object_id, {_BLOCK} AS block_id FROM c""")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.shown(text_keys(documents(spark, sf_dir))).select("doc_id", "idx", "token_begin", "token_end", "prefix_digest", "object_id", "block_id")


@query("longest_prefix", f"""WITH RECURSIVE t AS ({TURNS_SQL}),
{sql.chain('SELECT request_id, text FROM t', 'request_id', SCOPE)},
q AS (SELECT request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS asks FROM t),
ix AS (SELECT DISTINCT object FROM c JOIN q USING (request_id) WHERE NOT asks),
h AS (SELECT c.*, ix.object IS NOT NULL AS hit FROM c JOIN q USING (request_id) LEFT JOIN ix USING (object) WHERE asks),
f AS (SELECT *, min(hit::INT) OVER (PARTITION BY request_id ORDER BY idx) = 1 AS inside FROM h)
SELECT request_id, count(*) FILTER (inside) AS hit_blocks, coalesce(max(token_end) FILTER (inside), 0)::BIGINT AS matched_tokens FROM f GROUP BY 1""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last prompt of every conversation against an index of all earlier ones."""
    t = turns(spark, sf_dir).withColumn("asks", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1)
    k = text_keys(t.select("request_id", "asks", "text")).select("request_id", "asks", "idx", "token_end", "object_id")
    index = k.where("not asks").select("object_id").distinct().withColumn("known", F.lit(True))
    hits = k.where("asks").join(index, "object_id", "left")
    return lookup.matched(lookup.first_miss(hits, "request_id", F.col("known")), "request_id")


@query("scheduled_matches", f"""WITH r AS ({_report_sql(TURNS_SQL, 'request_id')})
SELECT request_id, greatest(least(matched_tokens, (greatest(matched_tokens + computed_tokens - 1, 0) // 16) * 16), 0)::BIGINT AS new_tokens FROM r""")
def scheduled_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a scheduler gets from the cache: whole blocks before each prompt's last token."""
    r = reuse_conversations(spark, sf_dir)
    return r.select("request_id", lookup.scheduled_match(F.col("matched_tokens"), F.col("matched_tokens") + F.col("computed_tokens"), F.lit(0), SCOPE.chunk_size).alias("new_tokens"))


@query("transfer_plans", f"""WITH r AS ({_report_sql(TURNS_SQL, 'request_id')})
SELECT request_id, (matched_tokens // 16)::INT AS load_blocks, greatest(0, (matched_tokens + computed_tokens) // 16 - matched_tokens // 16)::INT AS store_blocks,
 CASE WHEN (matched_tokens + computed_tokens) // 16 > matched_tokens // 16 THEN matched_tokens // 16 END::BIGINT AS first_stored FROM r""")
def transfer_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks each prompt loads and stores when all its tokens are scheduled; blocks are numbered from 0."""
    r = reuse_conversations(spark, sf_dir).withColumn("n", F.col("matched_tokens") + F.col("computed_tokens"))
    whole = F.floor(F.col("n") / SCOPE.chunk_size).cast("int")
    ids = F.when(whole > 0, F.sequence(F.lit(0).cast("bigint"), whole.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    plan = lookup.transfer_plan(ids, whole, F.lit(0), F.col("matched_tokens"), F.col("n"), SCOPE.chunk_size)
    return r.select("request_id", F.size(plan["load"]).alias("load_blocks"), F.size(plan["store"]).alias("store_blocks"), F.get(plan["store"], F.lit(0)).alias("first_stored"))


def _adapter_sql() -> str:
    tag = keys.tag("scope").hex()
    text = lambda e: f"{sql.le(f'octet_length(encode({e}))', 4)} || lower(hex(encode({e})))"
    head = f"'{tag}0100' || " + " || ".join(text(f"'{x}'") for x in (SCOPE.namespace, SCOPE.model_id, SCOPE.model_revision))
    tail = f"{sql.le('16', 4)} || '0100' || {text(chr(39) + SCOPE.dtype + chr(39))} || {sql.le('2', 4)} || {sql.le('2', 4)} || {sql.le('4', 4)} || {sql.le('1', 4)} || {sql.le('0', 4)}"
    return f"SELECT lang, source, sha256(unhex({head} || {text('adapter')} || {tail})) AS scope_digest FROM (SELECT DISTINCT lang, source, 'lora:' || coalesce(lang, '') || '|salt:' || coalesce(source, '') AS adapter FROM documents)"


@query("scope_digests", _adapter_sql())
def scope_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope per language and source: an adapter id makes every object its own."""
    d = read(spark, sf_dir, "documents").select("lang", "source").distinct()
    c = SCOPE.columns() | {"adapter_id": keys.adapter_id(F.col("lang"), F.col("source"))}
    return d.where(keys.scope_problem(c).isNull()).select("lang", "source", binary.low_hex(keys.scope_digest(c)).alias("scope_digest"))


@query("text_tokens", """SELECT doc_id, octet_length(encode(text))::BIGINT AS tokens, (octet_length(encode(text)) * 2 * 2 * 2 * 4)::BIGINT AS elements,
 lower(substr(hex(encode(text)), 1, 16)) || CASE WHEN octet_length(encode(text)) > 8 THEN '...' ELSE '' END AS preview FROM documents WHERE text IS NOT NULL""")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).where("text is not null")
    n = F.octet_length("text").cast("bigint")
    return d.select("doc_id", n.alias("tokens"), kv.element_count(n, SCOPE.layers, SCOPE.heads, SCOPE.head_dim).cast("bigint").alias("elements"), binary.hex_preview(F.col("text").cast("binary"), 8).alias("preview"))


@query("kv_values", """WITH b AS (SELECT doc_id, i, ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT AS t FROM (SELECT doc_id, text, unnest(range(octet_length(encode(text)))) AS i FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, (t * 1664525 + (i + 1) * 1013904223 + 2654435761::BIGINT * 2 + 2246822519 + 3266489917 * 3 + 668265263)::HUGEINT % 4294967296 % 65536 AS low FROM b)
SELECT doc_id, sum(low)::BIGINT AS low_sum, max(low)::BIGINT AS low_max FROM m GROUP BY 1""")
def kv_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every byte token, the 16 bits behind its value in layer 1, kind 1, head 1, dimension 3: summed per document."""
    d = keys.spread(documents(spark, sf_dir).where("octet_length(text) > 0"))
    return d.select("doc_id", kv.low_bits(F.col("text"), layer=1, kind=1, head=1, dim=3).alias("s")).select("doc_id", "s.low_sum", "s.low_max")


@query("kv_payloads")
def kv_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and checksum of every complete chunk's tensor. No oracle: it has no CRC-32; tested against zlib."""
    d = keys.spread(documents(spark, sf_dir).where("octet_length(text) >= 16"))
    return kv.chunk_checksums(d.select("doc_id", F.col("text").cast("binary").alias("text")), "text", SCOPE.chunk_size, SCOPE.layers, SCOPE.heads, SCOPE.head_dim)


@query("byte_sums", """SELECT doc_id, sum(('0x' || substr(h, 2 * i + 1, 2))::INT)::DECIMAL(20,0) AS result FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM documents WHERE octet_length(encode(text)) > 0) GROUP BY 1""")
def byte_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = keys.spread(documents(spark, sf_dir).where("octet_length(text) > 0")).select("doc_id", F.col("text").cast("binary").alias("payload"), F.lit("byte_sum").alias("operator"), F.lit(b"").alias("params"))
    return compute.compute(d).select("doc_id", "result")
