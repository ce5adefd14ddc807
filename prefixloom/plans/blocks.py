"""Queries about blocks: gates, first writers, tiers, leases, frames and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.functions import binary
from prefixloom.operators import catalog, integrity, leases, lookup, tiering
from prefixloom.plans import cluster
from prefixloom.plans.registry import query
from prefixloom.plans.reuse import read
from prefixloom.sources import blockfiles, frames

HOUR = 3_600_000_000
HIGH, POOL = 1_000_000, 4_000_000


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


_GATE_SQL = """SELECT page_id, CASE WHEN page_id = 0 THEN 'zero id' WHEN octet_length(encode(url)) % 7 = 0 THEN 'zero sequence' WHEN coalesce(octet_length(encode(html)), 0) = 0 THEN 'zero length'
 WHEN url LIKE '%?%' THEN 'length mismatch' END AS problem FROM pages"""


@query("ingest_gate", f"SELECT coalesce(problem, 'accepted') AS outcome, count(*) AS blocks FROM ({_GATE_SQL}) GROUP BY 1")
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as blocks. A url of a multiple of 7 bytes has sequence 0; one with a query declares a byte too many."""
    p = read(spark, sf_dir, "pages").withColumn("payload", F.col("html").cast("binary"))
    n = F.coalesce(F.octet_length("payload"), F.lit(0))
    problem = integrity.ingest_problem(F.col("page_id"), F.octet_length("url") % 7, n + F.when((n > 0) & F.col("url").contains("?"), 1).otherwise(0), F.col("payload"), None)
    return p.groupBy(F.coalesce(problem, F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("blocks"))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("block_id"), F.length("event_type").cast("bigint").alias("length"), F.floor("value").alias("checksum"))


@query("first_writers", """WITH w AS (SELECT event_id, user_id AS b, length(event_type) AS l, floor(value)::BIGINT AS c FROM events),
x AS (SELECT *, row_number() OVER w AS n, first_value(l) OVER w AS fl, first_value(c) OVER w AS fc FROM w WINDOW w AS (PARTITION BY b ORDER BY event_id))
SELECT event_id, CASE WHEN n = 1 THEN 'stored' WHEN l = fl AND c = fc THEN 'duplicate' ELSE 'conflict' END AS outcome FROM x""")
def first_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.first_writer(_writes(spark, sf_dir), "block_id", "event_id", ["length", "checksum"]).select("event_id", "outcome")


@query("bindings", """WITH w AS (SELECT event_id, user_id AS o, user_id // 2 AS b, length(event_type) AS l FROM events),
x AS (SELECT *, row_number() OVER w AS n, first_value(l) OVER w AS fl FROM w WINDOW w AS (PARTITION BY o ORDER BY event_id)),
y AS (SELECT *, arg_min(o, event_id) FILTER (n = 1) OVER (PARTITION BY b) AS owner, min(event_id) FILTER (n = 1) OVER (PARTITION BY b) AS since FROM x)
SELECT event_id, CASE WHEN n = 1 AND owner = o THEN 'bound' WHEN n = 1 THEN 'owned' WHEN l = fl AND owner = o THEN 'same' WHEN l = fl THEN 'owned' ELSE 'conflict' END AS outcome FROM y""")
def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as objects; two share a block, which the first of them owns."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("object_id"), F.expr("user_id div 2").alias("block_id"), F.length("event_type").alias("length"), F.lit(0).alias("checksum"))
    return integrity.bind(e, "event_id").select("event_id", "outcome")


@query("manifest_blocks", """WITH b AS (SELECT DISTINCT l_partkey, l_quantity::BIGINT AS n FROM lineitem) SELECT p_partkey, CASE WHEN l_partkey IS NULL THEN 'orphan' ELSE 'kept' END AS outcome FROM part LEFT JOIN b ON l_partkey = p_partkey AND n = p_size""")
def manifest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as manifests: kept where a line is a block of the same part and size."""
    m = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_partkey").alias("block_id"), F.col("p_size").cast("bigint").alias("length"), F.lit(0).alias("checksum"))
    b = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("block_id"), F.col("l_quantity").cast("bigint").alias("length"), F.lit(0).alias("checksum"))
    kept, rest = integrity.manifests_on(m, b)
    name = lambda x, o: x.select(F.col("object_id").alias("p_partkey"), F.lit(o).alias("outcome"))
    return name(kept, "kept").unionAll(name(rest, "orphan"))


@query("commit_visibility", """WITH b AS (SELECT l_orderkey AS k, min(epoch(l_shipdate)::BIGINT * 8 + l_linenumber) AS arrived FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN arrived IS NULL OR arrived > epoch(o_orderdate)::BIGINT * 8 + 31536000 * 8 THEN 'not found' WHEN o_orderstatus <> 'P' THEN 'committed' ELSE 'mismatch' END AS outcome FROM orders LEFT JOIN b ON k = o_orderkey""")
def commit_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits a year after their date; payloads arrive with the first line. Pending orders declare another length."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    b = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), (seconds("l_shipdate") * 8 + F.col("l_linenumber")).alias("arrived"), F.lit(1).alias("length"), F.lit(0).alias("checksum"))
    c = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("block_id"), (seconds("o_orderdate") * 8 + 31536000 * 8).alias("at"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("length"), F.lit(0).alias("checksum"))
    return integrity.visible(c, b).select("o_orderkey", "outcome")


@query("forgotten", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings (customers) that are left when those with a pending order are forgotten."""
    return integrity.forget(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = catalog.replay(cluster.location_events(spark, sf_dir)).where(F.col("kind") == catalog.UPSERT)
    return s.withColumn("allocated", binary.align_up(F.col("length") + 1, 8))


_STORED_SQL = f"SELECT *, (length + 8) // 8 * 8 AS allocated FROM ({cluster.STATE_SQL}) WHERE kind = 1"


@query("tier_stats", f"SELECT node_id, tier, count(*) AS blocks, sum(length)::BIGINT AS bytes, sum(allocated)::BIGINT AS allocated FROM ({_STORED_SQL}) GROUP BY 1, 2")
def tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiering.stats(_stored(spark, sf_dir), ["node_id", "tier"])


@query("eviction", f"SELECT count(*) AS before_blocks, sum(length)::BIGINT AS before_bytes, count(*) FILTER (tier = 1) AS after_blocks, sum(length) FILTER (tier = 1)::BIGINT AS after_bytes, count(*) FILTER (tier <> 1) AS evicted FROM ({_STORED_SQL})")
def eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters when only blocks in memory are kept."""
    return tiering.evict(_stored(spark, sf_dir), F.col("tier") == 1)


@query("compaction", f"SELECT block_id, node_id, tier, (length + 7) // 8 * 8 AS allocated FROM ({_STORED_SQL}) WHERE tier = 1")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiering.compact(_stored(spark, sf_dir), F.col("tier") == 1).select("block_id", "node_id", "tier", "allocated")


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("block_id", F.col("user_id"))
    return tiering.recency(e, ["event_type", "block_id"], "event_id", binary.align_up(F.floor(F.col("value") * 100), 8))


_RECENT_SQL = "SELECT event_type, user_id AS block_id, max(event_id) AS last_access, max((floor(value * 100)::BIGINT + 7) // 8 * 8) AS allocated FROM events GROUP BY 1, 2"


@query("recency_order", f"SELECT event_type, block_id, (row_number() OVER (PARTITION BY event_type ORDER BY last_access, block_id))::INT AS coldness, allocated FROM ({_RECENT_SQL})")
def recency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiering.spill_plan(_recent(spark, sf_dir), "event_type", HIGH, pool=POOL).select("event_type", "block_id", "coldness", "allocated")


def _spill_sql(wanted: str) -> str:
    return f"""WITH s AS ({_RECENT_SQL}), x AS (SELECT *, row_number() OVER w AS coldness, coalesce(sum(allocated) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 sum(allocated) OVER (PARTITION BY event_type) AS total, count(*) OVER (PARTITION BY event_type) AS n FROM s WINDOW w AS (PARTITION BY event_type ORDER BY last_access, block_id))
SELECT event_type, block_id FROM x WHERE coldness <= ceil(n / 2) AND {wanted}"""


@query("spill_after_write", _spill_sql(f"total > {HIGH} AND total - before > {HIGH * 8 // 10}"))
def spill_after_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiering.spill_plan(_recent(spark, sf_dir), "event_type", HIGH, pool=POOL).where("spilled").select("event_type", "block_id")


@query("spill_for_headroom", _spill_sql(f"total + 65536 > {HIGH}"))
def spill_for_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiering.spill_plan(_recent(spark, sf_dir), "event_type", HIGH, pool=POOL, incoming=65536).where("spilled").select("event_type", "block_id")


@query("read_through", f"""WITH v AS ({cluster.VIEW_SQL}), m AS (SELECT DISTINCT block_id FROM v WHERE node_id = '{cluster.SELF}' AND tier = 1), d AS (SELECT DISTINCT block_id FROM v WHERE node_id = '{cluster.SELF}' AND tier = 2),
r AS (SELECT DISTINCT block_id FROM v WHERE node_id <> '{cluster.SELF}')
SELECT p_partkey, CASE WHEN m.block_id IS NOT NULL THEN 'memory' WHEN d.block_id IS NOT NULL THEN 'disk' WHEN r.block_id IS NOT NULL THEN 'remote' END AS served FROM part LEFT JOIN m ON m.block_id = p_partkey LEFT JOIN d ON d.block_id = p_partkey LEFT JOIN r ON r.block_id = p_partkey""")
def read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = catalog.locations(catalog.replay(cluster.location_events(spark, sf_dir)), cluster.nodes(spark, sf_dir))
    own = v.where(F.col("node_id") == cluster.SELF)
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("block_id"))
    return tiering.read_through(p, own.where("tier = 1"), own.where("tier = 2"), v.where(F.col("node_id") != cluster.SELF)).select(F.col("block_id").alias("p_partkey"), "served")


def _leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    a = e.where("event_type in ('view', 'click')").select(F.col("event_id").alias("lease_id"), F.col("user_id").alias("block_id"), _micros().alias("at"))
    r = e.where("event_type = 'purchase'").select((F.col("event_id") - 3).alias("lease_id"), _micros().alias("at"))
    return leases.intervals(a, r, 12 * HOUR)


_LEASES_SQL = f"""SELECT a.event_id AS lease_id, a.user_id AS block_id, epoch_us(a.ts) AS b, least(epoch_us(a.ts) + {12 * HOUR}, CASE WHEN r.ts >= a.ts THEN epoch_us(r.ts) END) AS e
FROM events a LEFT JOIN events r ON r.event_type = 'purchase' AND r.event_id - 3 = a.event_id WHERE a.event_type IN ('view', 'click')"""


@query("lease_pins", f"""WITH l AS ({_LEASES_SQL}), p AS (SELECT block_id, b AS t, 1 AS d FROM l UNION ALL SELECT block_id, e, -1 FROM l),
s AS (SELECT block_id, sum(d) OVER (PARTITION BY block_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM p) SELECT block_id, max(n)::BIGINT AS most FROM s GROUP BY 1""")
def lease_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.pins(_leases(spark, sf_dir))


@query("busy_mutations", f"""WITH l AS ({_LEASES_SQL}) SELECT event_id AS request_id, EXISTS (SELECT 1 FROM l WHERE l.block_id = user_id AND b <= epoch_us(ts) AND e > epoch_us(ts) AND e > b) AS busy FROM events WHERE event_type = 'error'""")
def busy_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("block_id"), _micros().alias("at"))
    return leases.mutations(q, _leases(spark, sf_dir)).select("request_id", "busy")


@query("single_flights", f"""WITH RECURSIVE q AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(user_id, k, until, flights) AS (SELECT DISTINCT user_id, 0::BIGINT, -4611686018427387904, 0::BIGINT FROM q UNION ALL
 SELECT f.user_id, q.k, CASE WHEN t >= until THEN t + {6 * HOUR} ELSE until END, flights + (t >= until)::INT FROM f JOIN q ON q.user_id = f.user_id AND q.k = f.k + 1)
SELECT user_id, max(k) AS requests, max(flights) AS flights FROM f GROUP BY 1""")
def single_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", _micros().alias("at"))
    return leases.single_flights(e, "user_id", "at", 6 * HOUR)


@query("saved_blocks", """WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS layer, l_partkey FROM lineitem WHERE l_linenumber <= 2), g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT layer) AS k, string_agg(lower(hex(encode(l_partkey::VARCHAR || ';'))), '' ORDER BY layer) AS payload FROM p GROUP BY 1)
SELECT l_orderkey, payload FROM g WHERE n = 2 AND k = 2""")
def saved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as blocks whose first two lines are layers; those that have just one piece of each are assembled."""
    p = read(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select("l_orderkey", F.col("l_linenumber").alias("layer"), F.concat(F.col("l_partkey").cast("string"), F.lit(";")).cast("binary").alias("data"))
    return lookup.saved_blocks(p, ["l_orderkey"], 2).select("l_orderkey", binary.low_hex(F.col("payload")).alias("payload"))


@query("payload_timeouts", "SELECT page_id, (30 + ceil(octet_length(encode(html)) * 1000.0 / 10485760))::BIGINT AS seconds FROM pages WHERE html IS NOT NULL")
def payload_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that a link gives each page's payload a thousand times over."""
    return read(spark, sf_dir, "pages").where("html is not null").select("page_id", tiering.timeout_s(F.octet_length("html").cast("bigint") * 1000).alias("seconds"))


@query("frame_round_trips", "SELECT page_id, true AS peer, true AS listener, true AS local, true AS put FROM pages WHERE octet_length(encode(html)) > 0")
def frame_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page built into each kind of frame and parsed again: whether it comes back."""
    p = read(spark, sf_dir, "pages").where("octet_length(html) > 0").select("page_id", F.col("html").cast("binary").alias("data"))
    block, seq = (F.col("page_id") + 1).cast(binary.U64), (F.col("page_id") + 7).cast(binary.U64)
    x = p.select("page_id", "data", frames.peer_frame(F.lit(3), block, F.col("data")).alias("a"), frames.listener_frame(F.lit(1), seq, block, F.col("data")).alias("b"), frames.local_frame(F.lit(2), F.lit(1), seq, F.col("data")).alias("c"), frames.put_payload(seq, F.col("data")).alias("d"))
    back = lambda e: F.coalesce(F.col("problem").isNull() & e, F.lit(False))
    x = frames.parse_peer(x, "a").withColumn("peer", back((F.col("payload") == F.col("data")) & (F.col("block_id") == block) & (F.col("kind") == 3))).drop("problem", "kind", "block_id", "checksum", "payload", "a")
    x = frames.parse_listener(x, "b").withColumn("listener", back((F.col("payload") == F.col("data")) & (F.col("seq") == seq))).drop("problem", "kind", "seq", "block_id", "checksum", "payload", "b")
    x = frames.parse_local(x, "c").withColumn("local", back((F.col("payload") == F.col("data")) & (F.col("flags") == 1))).drop("problem", "kind", "flags", "seq", "payload", "c")
    x = frames.parse_put(x.withColumnRenamed("data", "was"), "d").withColumn("put", back(F.col("data") == F.col("was")))
    return x.select("page_id", "peer", "listener", "local", "put")


@query("block_files", "SELECT page_id, octet_length(encode(html))::BIGINT AS length, octet_length(encode(html)) > 0 AS whole FROM pages WHERE html IS NOT NULL")
def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the bytes of a block file, parsed and held against its checksum."""
    p = read(spark, sf_dir, "pages").where("html is not null").select("page_id", F.col("html").cast("binary").alias("data"))
    c = blockfiles.block_bytes((F.col("page_id") + 1).cast(binary.U64), F.lit(1).cast(binary.U64), F.octet_length("data"), F.crc32("data"), F.col("data"))
    x = blockfiles.parse_blocks(p.select("page_id", c.alias("content")))
    return x.select("page_id", "length", ((F.octet_length("payload") == F.col("length")) & (F.crc32("payload") == F.col("checksum")) & (F.col("length") > 0)).alias("whole"))


@query("payload_checksums")
def payload_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of every page. No oracle: DuckDB has none; tested against zlib."""
    return read(spark, sf_dir, "pages").where("html is not null").select("page_id", F.crc32(F.col("html").cast("binary")).alias("checksum"))
