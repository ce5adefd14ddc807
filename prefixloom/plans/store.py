"""Queries about a store's own requests: ingests, deletes, commits, manifests, log entries, checks; and about the bytes of its messages and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.client import Client
from prefixloom.functions import binary, keys
from prefixloom.operators import catalog, compute, integrity, lookup, routing, store, tiering
from prefixloom.plans import blocks, cluster, sql
from prefixloom.plans.registry import query
from prefixloom.plans.reuse import SCOPE, documents, read, text_keys
from prefixloom.sources import blockfiles, frames, texts
from prefixloom.sources.shared import scratch

SELF = cluster.SELF


def _page_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two pages a block. Some have no sequence, some a wrong length or checksum; every eleventh block is stored already, with its first page."""
    p = read(spark, sf_dir, "pages").withColumn("payload", F.col("html").cast("binary"))
    n = F.coalesce(F.octet_length("payload"), F.lit(0))
    block, crc = F.expr("page_id div 2").alias("block_id"), F.crc32("payload")
    requests = p.select("page_id", block, F.when(F.col("page_id") % 7 == 3, 0).otherwise(F.col("page_id") + 1).alias("seq"), (n + F.when(F.col("url").contains("?"), 1).otherwise(0)).cast("bigint").alias("length"), (crc + F.when(F.col("page_id") % 5 == 4, 1).otherwise(0)).alias("checksum"), "payload")
    stored = p.where("page_id % 22 = 6 and html is not null").select(block, n.cast("bigint").alias("length"), crc.alias("checksum"))
    return requests, stored


_INGEST_SQL = """WITH r AS (SELECT page_id, page_id // 2 AS block_id, CASE WHEN page_id % 7 = 3 THEN 0 ELSE page_id + 1 END AS seq, html, coalesce(octet_length(encode(html)), 0) AS n, coalesce(octet_length(encode(html)), 0) + (CASE WHEN url LIKE '%?%' THEN 1 ELSE 0 END) AS length, page_id % 5 = 4 AS wrong FROM pages),
b AS (SELECT *, CASE WHEN block_id = 0 THEN 'zero id' WHEN seq = 0 THEN 'zero sequence' WHEN length = 0 THEN 'zero length' WHEN n <> length THEN 'length mismatch' WHEN wrong THEN 'checksum mismatch' END AS bad FROM r),
h AS (SELECT page_id // 2 AS block_id, html AS held FROM pages WHERE page_id % 22 = 6 AND html IS NOT NULL),
x AS (SELECT b.*, held, first_value(html) OVER w AS lead, row_number() OVER w AS k FROM b LEFT JOIN h USING (block_id) WINDOW w AS (PARTITION BY b.block_id ORDER BY bad IS NOT NULL, page_id)),
o AS (SELECT page_id, block_id, n AS length, CASE WHEN bad IS NOT NULL THEN bad WHEN held IS NULL AND k = 1 THEN 'stored' WHEN html = coalesce(held, lead) THEN 'duplicate' ELSE 'conflict' END AS outcome FROM x)"""


@query("ingested_blocks", f"{_INGEST_SQL} SELECT page_id, outcome FROM o")
def ingested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and checksum gate, first writer and conflicts of a batch of pages."""
    return store.ingested(*_page_blocks(spark, sf_dir), "page_id").select("page_id", "outcome")


@query("ingest_announcements", f"{_INGEST_SQL} SELECT block_id, tier, length::BIGINT AS length, (row_number() OVER (ORDER BY block_id, tier) + (SELECT max(version) FROM ({cluster.EVENTS_SQL})))::BIGINT AS version FROM o, (SELECT unnest([1, 2])::INT AS tier) WHERE outcome = 'stored'")
def ingest_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored pages add to the log: an entry in memory and one on disk, at the versions after its clock."""
    kept = store.ingested(*_page_blocks(spark, sf_dir), "page_id").where("outcome = 'stored'")
    events = store.announcements(kept, SELF, (store.MEMORY, store.DISK))
    return store.appended(cluster.location_events(spark, sf_dir), events, ["block_id", "tier"]).select("block_id", "tier", "length", "version")


def _deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = catalog.replay(cluster.location_events(spark, sf_dir)).where(F.col("kind") == catalog.UPSERT)
    p = read(spark, sf_dir, "part")
    return store.deleted(p.select(F.col("p_partkey").alias("block_id")), v.where("tier = 1"), v.where("tier = 2"), p.where("p_size % 10 = 0").select(F.col("p_partkey").alias("block_id")))


_DELETE_SQL = f"""WITH v AS (SELECT DISTINCT block_id, tier FROM ({cluster.STATE_SQL}) WHERE kind = 1),
d AS (SELECT p_partkey AS block_id, CASE WHEN p_partkey = 0 THEN 'zero id' WHEN p_size % 10 = 0 THEN 'busy' WHEN m.block_id IS NOT NULL OR k.block_id IS NOT NULL THEN 'deleted' ELSE 'absent' END AS outcome, m.block_id IS NOT NULL AS mem, k.block_id IS NOT NULL AS disk
 FROM part LEFT JOIN (SELECT * FROM v WHERE tier = 1) m ON m.block_id = p_partkey LEFT JOIN (SELECT * FROM v WHERE tier = 2) k ON k.block_id = p_partkey)"""


@query("deleted_blocks", f"{_DELETE_SQL} SELECT block_id, outcome, outcome = 'deleted' AND mem AS from_memory, outcome = 'deleted' AND disk AS from_disk FROM d")
def deleted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's block deleted from wherever it is, but for those that a lease pins: of a size that ends in 0."""
    return _deletes(spark, sf_dir)


@query("delete_announcements", f"{_DELETE_SQL} SELECT block_id, tier, (row_number() OVER (ORDER BY block_id, tier) + (SELECT max(version) FROM ({cluster.EVENTS_SQL})))::BIGINT AS version FROM d, (SELECT unnest([1, 2])::INT AS tier) WHERE outcome = 'deleted' AND CASE WHEN tier = 1 THEN mem ELSE disk END")
def delete_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = store.deletions(_deletes(spark, sf_dir), SELF)
    return store.appended(cluster.location_events(spark, sf_dir), events, ["block_id", "tier"]).select("block_id", "tier", "version")


@query("announcement_log", f"""SELECT event_id, (row_number() OVER (ORDER BY event_id) + (SELECT max(version) FROM ({cluster.EVENTS_SQL})))::BIGINT AS version FROM events LEFT JOIN supplier ON s_suppkey = user_id
WHERE user_id <> 0 AND event_type <> 'signup' AND (event_type = 'error' OR s_suppkey IS NOT NULL)""")
def announcement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The announcements that pass their checks, as the log takes them: each at a version of its own after the clock."""
    e = cluster.announcements(spark, sf_dir).where("status = 'OK'").select("event_id")
    return store.appended(cluster.location_events(spark, sf_dir), e, ["event_id"])


def _commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as commits. By the key's last digit: 1 another object, 2 another block, 3 no block, 4 another length, 5 bound before, 6 bound otherwise."""
    o, digit = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 10
    sha = lambda c: F.unhex(F.sha2(c.cast("string").cast("binary"), 256))
    x = o.select("o_orderkey", sha(F.lit("scope")).alias("scope_digest"), sha(F.col("o_orderkey")).alias("prefix_digest"), (F.col("o_orderkey") % 100 * 16).cast("bigint").alias("token_count"), F.col("o_custkey").cast("bigint").alias("length"), F.lit(7).cast("bigint").alias("checksum"))
    x = x.withColumn("real", keys.object_id(F.col("scope_digest"), F.col("prefix_digest"), F.col("token_count")))
    x = x.withColumns({"object_id": F.when(digit == 1, sha(F.lit("other"))).otherwise(F.col("real")), "true_block": keys.block_id(F.col("real"))})
    x = x.withColumn("block_id", F.when(digit == 2, F.lit(5).cast(binary.U64)).otherwise(F.col("true_block")))
    held = x.where(digit != 3).select(F.col("true_block").alias("block_id"), (F.col("length") + F.when(digit == 4, 1).otherwise(0)).alias("length"), "checksum")
    index = x.where(digit.isin(5, 6)).select(F.col("real").alias("object_id"), F.col("true_block").alias("block_id"), (F.col("length") + F.when(digit == 6, 1).otherwise(0)).alias("length"), "checksum")
    return x.drop("real", "true_block"), held, index


_OBJECT = f"""sha256(unhex('{keys.tag("object").hex()}' || sha256('scope')) || unhex(sha256(o_orderkey::VARCHAR)) || unhex({sql.le('o_orderkey % 100 * 16', 8)}))"""
_BLOCK_OF = "('0x' || " + " || ".join(f"substr(object, {2 * i + 1}, 2)" for i in reversed(range(8))) + ")::UBIGINT::DECIMAL(20,0)"
_COMMIT_SQL = f"""WITH c AS (SELECT o_orderkey, o_orderkey % 10 AS digit, {_OBJECT} AS real FROM orders), d AS (SELECT *, CASE WHEN digit = 1 THEN sha256('other') ELSE real END AS object FROM c)"""


@query("committed_objects", f"""{_COMMIT_SQL} SELECT o_orderkey, object AS object_id, CASE digit WHEN 1 THEN 'digest mismatch' WHEN 2 THEN 'block id mismatch' WHEN 3 THEN 'not found' WHEN 4 THEN 'metadata mismatch' WHEN 5 THEN 'same' WHEN 6 THEN 'conflict' ELSE 'committed' END AS outcome FROM d""")
def committed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits whose object and block ids are computed anew, and held against the blocks and the index."""
    return store.committed(*_commits(spark, sf_dir)).select("o_orderkey", binary.low_hex(F.col("object_id")).alias("object_id"), "outcome")


@query("restored_objects", f"""{_COMMIT_SQL} SELECT o_orderkey, CASE WHEN digit = 1 THEN 'invalid' WHEN digit IN (2, 3, 4) THEN 'orphan' ELSE 'bound' END AS outcome FROM d""")
def restored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same commits as manifests, bound anew when a store starts."""
    m, held, _ = _commits(spark, sf_dir)
    return store.restored(m, held, "o_orderkey").select("o_orderkey", "outcome")


@query("found_blocks", f"{_COMMIT_SQL} SELECT o_orderkey, digit IN (5, 6) AS found FROM d WHERE digit <> 1")
def found_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the index by block; the object has to agree, as a block id is but a projection of it."""
    m, _, index = _commits(spark, sf_dir)
    asked = m.where("o_orderkey % 10 <> 1").select("o_orderkey", "object_id", "block_id")
    return store.by_block(index.withColumn("found", F.lit(True)), asked).select("o_orderkey", F.coalesce("found", F.lit(False)).alias("found"))


@query("manifests_put", """WITH f AS (SELECT event_id AS id, user_id AS o, user_id // 2 AS b, length(event_type) AS l, CASE WHEN user_id // 2 % 4 = 0 THEN 'no block' WHEN length(event_type) <> 5 THEN 'metadata mismatch' END AS bad FROM events),
x AS (SELECT -1 AS id, o, b, 6 AS l, true AS old FROM (SELECT DISTINCT user_id AS o, user_id // 2 AS b FROM events WHERE user_id % 9 = 0) UNION ALL SELECT id, o, b, l, false FROM f WHERE bad IS NULL),
y AS (SELECT *, row_number() OVER w AS n, first_value(l) OVER w AS fl, first_value(o) OVER (PARTITION BY b ORDER BY old DESC, id) AS owner FROM x WINDOW w AS (PARTITION BY o ORDER BY old DESC, id))
SELECT id AS event_id, CASE WHEN n = 1 AND owner = o THEN 'stored' WHEN l <> fl THEN 'conflict' WHEN owner = o THEN 'same' ELSE 'owned' END AS outcome FROM y WHERE NOT old UNION ALL SELECT id, bad FROM f WHERE bad IS NOT NULL""")
def manifests_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as objects, two a block, with the event's name as length: blocks are of length 5, and every ninth user has an older manifest."""
    e = read(spark, sf_dir, "events")
    cols = lambda n: [F.col("user_id").alias("object_id"), F.expr("user_id div 2").alias("block_id"), n.cast("bigint").alias("length"), F.lit(0).alias("checksum")]
    old = e.where("user_id % 9 = 0").select(*cols(F.lit(6))).distinct().withColumn("event_id", F.lit(-1).cast("bigint"))
    held = e.select(F.expr("user_id div 2").alias("block_id"), F.lit(5).cast("bigint").alias("length"), F.lit(0).alias("checksum")).where("block_id % 4 <> 0").distinct()
    return store.manifests_put(e.select("event_id", *cols(F.length("event_type"))), old, held, "event_id").select("event_id", "outcome")


@query("absent_put", "SELECT user_id, count(*) AS rows FROM (SELECT user_id FROM events WHERE event_type = 'view' UNION ALL SELECT user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view')) GROUP BY 1")
def absent_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    x = integrity.put_if_absent(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"])
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))


@query("ring_candidates", f"""WITH n AS (SELECT node_id, node_id || '#' || r AS s FROM ({cluster.NODES_SQL}), (SELECT unnest(range({routing.REPLICAS})) AS r) WHERE state = 1), f AS (SELECT node_id, {cluster._FNV} AS h FROM n),
p AS (SELECT {cluster._finaliser('h')} AS hash, node_id FROM f), b AS (SELECT c_custkey, {cluster._finaliser('c_custkey::UBIGINT')} AS hash FROM customer),
d AS (SELECT c_custkey, node_id, min(CASE WHEN p.hash >= b.hash THEN p.hash::HUGEINT - b.hash ELSE p.hash::HUGEINT - b.hash + 18446744073709551616::HUGEINT END) AS far FROM b, p GROUP BY 1, 2),
k AS (SELECT c_custkey, node_id, row_number() OVER (PARTITION BY c_custkey ORDER BY far, node_id) AS rank FROM d) SELECT c_custkey, rank::INT AS rank, node_id FROM k WHERE rank <= 3""")
def ring_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three distinct nodes that follow each customer's place on the ring."""
    return routing.locate_ring_n(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", routing.ring(cluster.nodes(spark, sf_dir)), 3)


_VERSION_SQL = """SELECT count(*) FILTER (CASE WHEN was IS NULL THEN state = 1 ELSE (state = 1) <> (was = 1) OR (state = 1 AND addr <> old) END) AS version FROM (SELECT *, lag(state) OVER w AS was, lag(addr) OVER w AS old
 FROM (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 2 ELSE 1 END AS state, event_type AS addr FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query("routed_versions", f"""WITH r AS ({cluster.ROUTES_SQL}), b AS ({cluster.BLOCKS_SQL}), x AS (SELECT o_orderkey, (block // (SELECT any_value(step) FROM r))::BIGINT AS number FROM b)
SELECT o_orderkey, node_id, (SELECT version FROM ({_VERSION_SQL})) AS version FROM x JOIN r USING (number)""")
def routed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's node, with the version of the routes after the events' history."""
    h = read(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "view", 2).otherwise(1).alias("state"), F.col("event_type").alias("addr"))
    x = routing.routed(cluster._blocks(spark, sf_dir), "block_id", routing.ranges(cluster.nodes(spark, sf_dir)), routing.route_version(h))
    return x.select("o_orderkey", "node_id", "version")


@query("spill_announcements", f"SELECT event_type, block_id, pos, CASE pos WHEN 0 THEN 1 ELSE 2 END AS kind, CASE pos WHEN 0 THEN 2 ELSE 1 END AS tier FROM ({blocks._spill_sql(f'total > {blocks.HIGH} AND total - before > {blocks.HIGH * 8 // 10}')}), (SELECT unnest([0, 1])::INT AS pos)")
def spill_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's entries for spilled blocks: on disk first, then out of memory."""
    plan = tiering.spill_plan(blocks._recent(spark, sf_dir), "event_type", blocks.HIGH, pool=blocks.POOL)
    return tiering.spill_events(plan).select("event_type", "block_id", "pos", "kind", "tier")


@query("promotions", f"""WITH v AS ({cluster.VIEW_SQL}) SELECT p_partkey AS block_id, 1 AS kind, 1 AS tier FROM part WHERE p_partkey NOT IN (SELECT block_id FROM v WHERE node_id = '{SELF}' AND tier = 1) AND p_partkey IN (SELECT block_id FROM v WHERE node_id = '{SELF}' AND tier = 2)""")
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries in memory of blocks that are read from disk."""
    x = blocks.read_through(spark, sf_dir).withColumnRenamed("p_partkey", "block_id")
    return tiering.promotion_events(x).select("block_id", "kind", "tier")


@query("evictions", f"""WITH s AS ({blocks._STORED_SQL}), p AS (SELECT 'generation' AS policy, *, block_id % 3 = 1 AS keep FROM s UNION ALL SELECT 'ids', *, block_id NOT IN (1, 2, 3) FROM s UNION ALL SELECT 'all', *, true FROM s)
SELECT policy, count(*) AS before_blocks, count(*) FILTER (keep) AS after_blocks, coalesce(sum(length) FILTER (keep), 0)::BIGINT AS after_bytes, count(*) FILTER (NOT keep) AS evicted FROM p GROUP BY 1""")
def evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the named policies: one generation of three, all but some blocks, everything."""
    s = blocks._stored(spark, sf_dir).withColumn("generation", F.col("block_id") % 3)
    out = None
    for name, keep in (("generation", tiering.keep_generation(1)), ("ids", tiering.keep_except([1, 2, 3])), ("all", tiering.keep_all())):
        x = tiering.evict(s, keep).select(F.lit(name).alias("policy"), "before_blocks", "after_blocks", "after_bytes", "evicted")
        out = x if out is None else out.unionAll(x)
    return out


@query("member_list", "SELECT state, count(*) AS members FROM (SELECT CASE WHEN s_acctbal < 0 THEN 4 WHEN s_acctbal < 2000 THEN 2 ELSE 1 END AS state FROM supplier) WHERE state <> 4 GROUP BY 1")
def member_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many members a listing without tombstones shows, by state."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, catalog.TOMBSTONE).when(F.col("s_acctbal") < 2000, catalog.SUSPECT).otherwise(catalog.ALIVE).alias("state"))
    return catalog.listed(s).groupBy("state").agg(F.count(F.lit(1)).alias("members"))


@query("node_checks", "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'empty id' WHEN s_suppkey % 4 = 0 AND s_acctbal >= 0 THEN 'empty address' END AS problem FROM supplier")
def node_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    problem = catalog.node_problem(F.when(key % 9 == 0, "").otherwise(F.col("s_name")), F.when(key % 4 != 0, F.lit("host:1")), F.when(F.col("s_acctbal") < 0, catalog.TOMBSTONE).otherwise(catalog.ALIVE))
    return s.select("s_suppkey", problem.alias("problem"))


_ERRORS = {"click": None, "view": "empty id", "purchase": "not found", "signup": "tombstoned", "error": "no alive nodes"}


@query("status_codes", "SELECT event_id, CASE WHEN user_id % 10 = 9 THEN 'INTERNAL' ELSE CASE event_type WHEN 'click' THEN 'OK' WHEN 'view' THEN 'INVALID_ARGUMENT' WHEN 'purchase' THEN 'NOT_FOUND' WHEN 'signup' THEN 'FAILED_PRECONDITION' WHEN 'error' THEN 'UNAVAILABLE' END END AS status FROM events")
def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of an error an event; users that end in 9 meet one without a code of its own."""
    error = F.create_map(*[F.lit(x) for pair in _ERRORS.items() for x in pair])[F.col("event_type")]
    return read(spark, sf_dir, "events").select("event_id", catalog.status(F.when(F.col("user_id") % 10 == 9, "disk full").otherwise(error)).alias("status"))


@query("placements", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'local' WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'remote' WHEN o_orderkey % 3 = 0 THEN 'fetch' END AS hybrid, CASE WHEN o_orderkey % 2 = 0 THEN 'local' WHEN o_orderkey % 3 = 0 THEN 'fetch' END AS fetch_local_only,
 CASE WHEN o_orderkey % 2 = 0 THEN 'local' WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'remote' END AS remote_only FROM orders""")
def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a function over each order's block runs, by mode: even keys are here, those that 3 divides elsewhere, where 5 must divide them, too."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", *[compute.placement(k % 2 == 0, k % 3 == 0, k % 5 == 0, m).alias(m) for m in ("hybrid", "fetch_local_only", "remote_only")])


@query("failovers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.04 THEN l_partkey WHEN l_discount < 0.05 THEN l_suppkey ELSE -1 END AS got FROM lineitem")
def failovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    got = lookup.failover(F.when(F.col("l_tax") < 0.04, F.col("l_partkey")), F.when(F.col("l_discount") < 0.05, F.col("l_suppkey")))
    return x.select("l_orderkey", "l_linenumber", F.coalesce(got, F.lit(-1)).alias("got"))


@query("transport_checks", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 6 AND l_partkey <> 0 AND l_returnflag = 'R' THEN 'block id mismatch' END AS problem FROM lineitem")
def transport_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers held against what was asked for: returned lines come from another block; late lines take any."""
    x = read(spark, sf_dir, "lineitem")
    wanted, got = F.when(F.col("l_linenumber") < 6, F.col("l_partkey")).otherwise(0), F.col("l_partkey") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return x.select("l_orderkey", "l_linenumber", store.transport_problem(wanted, got).alias("problem"))


@query("stale_loads", "SELECT event_id, CASE WHEN user_id % 4 <> event_id % 4 THEN 'generation changed' END AS problem FROM events")
def stale_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", store.stale(F.col("user_id") % 4, F.col("event_id") % 4).alias("problem"))


@query("eligible_requests", "SELECT doc_id, coalesce(source, '') <> 'src0' AND text IS NOT NULL AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS eligible FROM documents")
def eligible_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a scheduler's requests: one source doesn't read the cache, every third has images, every fifth embeddings."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", store.eligible(F.coalesce("source", F.lit("")) != "src0", F.col("text"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0), F.col("doc_id") % 5 == 0).alias("eligible"))


@query("model_checks", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'cache groups' WHEN p_size % 5 = 0 THEN 'attention' WHEN p_size % 3 = 0 THEN 'head sizes' WHEN p_size % 2 = 0 THEN 'parallelism' END AS problem FROM part")
def model_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", store.model_problem(F.when(s % 7 == 0, 2).otherwise(1), s % 5 != 0, F.lit(64), F.when(s % 3 == 0, 32).otherwise(64), F.when(s % 2 == 0, 2).otherwise(1), F.lit(1)).alias("problem"))


@query("zipped_loads", """WITH l AS (SELECT l_orderkey, (row_number() OVER w - 1)::INT AS idx, l_partkey AS location, l_suppkey AS block FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, idx, location, block FROM l WHERE l_orderkey % 5 <> 0""")
def zipped_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each of a request's blocks goes, by position; requests with a location too few are refused whole."""
    x = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    x = x.select("l_orderkey", F.col("l.l_partkey").alias("locations"), F.col("l.l_suppkey").alias("blocks"))
    x = x.withColumn("locations", F.when(F.col("l_orderkey") % 5 == 0, F.slice("locations", 1, F.size("locations") - 1)).otherwise(F.col("locations")))
    return store.zipped(x, ["l_orderkey"], location="locations", block="blocks")


@query("lease_numbers", "SELECT event_id, CASE WHEN xor(epoch_us(ts), event_id) = 0 THEN 1 ELSE xor(epoch_us(ts), event_id) END AS lease_id FROM events")
def lease_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases numbered by clock and counter, both taken from the event, so that the numbers can be repeated."""
    return read(spark, sf_dir, "events").select("event_id", store.lease_id(blocks._micros(), F.col("event_id")).alias("lease_id"))


@query("enum_names", "SELECT event_id, CASE user_id % 6 WHEN 1 THEN 'alive' WHEN 2 THEN 'suspect' WHEN 3 THEN 'down' WHEN 4 THEN 'tombstone' ELSE 'unknown' END AS state, CASE WHEN user_id % 6 = 5 THEN 0 ELSE user_id % 6 END::INT AS state_code, CASE user_id % 4 WHEN 1 THEN 'memory' WHEN 2 THEN 'disk' ELSE 'unspecified' END AS tier FROM events")
def enum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of states and tiers to names, and back; codes that there aren't are unknown."""
    s = store.named(F.col("user_id") % 6, store.STATES)
    return read(spark, sf_dir, "events").select("event_id", s.alias("state"), store.coded(s, store.STATES).alias("state_code"), store.named(F.col("user_id") % 4, store.TIERS).alias("tier"))


_BITS = f"SELECT c_custkey, (c_custkey::UHUGEINT * {cluster.STEP} * 32 % 18446744073709551616::UHUGEINT)::UBIGINT AS v FROM customer"


@query("bit_functions", f"""SELECT c_custkey, ((v >> (63 - c_custkey % 64)::UBIGINT) & 1)::INT AS bit, CASE WHEN c_custkey % 65 = 0 THEN 0 WHEN c_custkey % 65 = 64 THEN v::UHUGEINT ELSE (v >> (64 - c_custkey % 65)::UBIGINT)::UHUGEINT * (1::UBIGINT << (64 - c_custkey % 65)::UBIGINT)::UHUGEINT END::VARCHAR::DECIMAL(20,0) AS masked,
 CASE WHEN v = 0 THEN 64 ELSE bit_count(xor(v, v - 1)) - 1 END::INT AS zeros FROM ({_BITS})""")
def bit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits, prefixes and trailing zeros of unsigned block ids."""
    c = read(spark, sf_dir, "customer").select("c_custkey", binary.times64(F.col("c_custkey").cast(binary.U64), cluster.STEP * 32).alias("v"))
    k = F.col("c_custkey")
    return c.select("c_custkey", binary.bit_at(F.col("v"), k % 64).alias("bit"), binary.mask_prefix(F.col("v"), k % 65).alias("masked"), binary.trailing_zeros(F.col("v")).alias("zeros"))


@query("scope_problems", """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'version' WHEN doc_id % 7 = 0 THEN 'empty model_id' WHEN doc_id % 5 = 0 THEN 'zero layers' WHEN doc_id % 3 = 0 THEN 'rank out of range' END AS problem FROM documents""")
def scope_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes with one flaw or several: the first in the order of the checks is told."""
    k = F.col("doc_id")
    c = SCOPE.columns() | {"version": F.when(k % 11 == 0, 2).otherwise(1), "model_id": F.when(k % 7 == 0, "").otherwise("m"), "layers": F.when(k % 5 == 0, 0).otherwise(2), "tp_rank": F.when(k % 3 == 0, 1).otherwise(0)}
    return read(spark, sf_dir, "documents").select("doc_id", keys.scope_problem(c).alias("problem"))


_SHA = "sha256(o_orderkey::VARCHAR)"


@query("message_bytes", f"""WITH o AS (SELECT o_orderkey, {_SHA} AS a, sha256('scope') AS s FROM orders)
SELECT o_orderkey, '0100' || repeat('00', 6) || {sql.le('o_orderkey', 8)} || {sql.le('o_orderkey * 3', 8)} || {sql.le('o_orderkey % 1000', 4)} || '00000000' || s || a || a AS commit,
 '01000000' || '02000000' || s || a || {sql.le('16', 8)} || s || {sql.le('o_orderkey + 16', 8)} AS lookup,
 {sql.le("octet_length(encode('op' || o_orderkey))", 2)} || '0000' || '02000000' || lower(hex(encode('op' || o_orderkey))) || '0102' AS compute,
 {sql.le(str(frames.PEER_MAGIC), 4)} || '0100' || '2000' || '0700' || '0000' || '00000000' || {sql.le('o_orderkey', 8)} || repeat('00', 8) AS ack,
 '01000200' || '01000000' || {sql.le('16', 8)} || {sql.le('o_orderkey', 8)} || {sql.le('99', 8)} || repeat('00', 8) || a || {sql.le('o_orderkey + 1', 8)} || {sql.le('16', 8)} || {sql.le('64', 8)} || {sql.le('7', 4)} || '01000200' || {sql.le("octet_length(encode('node-' || o_orderkey))", 2)} || '0300' || lower(hex(encode('node-' || o_orderkey))) || lower(hex(encode('h:1'))) AS result
FROM o""")
def message_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, lookups, results, function calls and acknowledgements of every order, byte by byte."""
    return _messages(spark, sf_dir).select("o_orderkey", *[binary.low_hex(F.col(c)).alias(c) for c in ("commit", "lookup", "compute", "ack", "result")])


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    u = lambda c: c.cast(binary.U64)
    a, s = (F.unhex(F.sha2(c.cast("string").cast("binary"), 256)) for c in (k, F.lit("scope")))
    name = F.concat(F.lit("op"), k.cast("string"))
    both = F.array(F.struct(a.alias("object_id"), F.lit(16).cast("bigint").alias("token_end")), F.struct(s.alias("object_id"), (k + 16).cast("bigint").alias("token_end")))
    entry = F.struct(a.alias("object_id"), u(k + 1).alias("block_id"), F.lit(16).alias("token_end"), F.lit(64).alias("length"), F.lit(7).alias("checksum"), F.lit(1).alias("tier"), F.lit(2).alias("transport"), F.concat(F.lit("node-"), k.cast("string")).alias("node_id"), F.lit("h:1").alias("addr"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", frames.commit_payload(k, k * 3, k % 1000, s, a, a).alias("commit"), frames.lookup_payload(s, both).alias("lookup"), frames.compute_payload(name, F.lit(b"\x01\x02")).alias("compute"),
        frames.ack_frame(u(k)).alias("ack"), frames.result_payload(F.lit(2), F.lit(16), u(k), F.lit(99), F.array(entry)).alias("result"), frames.error_frame(u(k), F.concat(F.lit("no block "), k.cast("string"))).alias("error"),
    )


@query("message_fields", """SELECT o_orderkey, o_orderkey::BIGINT AS token_count, CASE WHEN o_orderkey > 0 THEN o_orderkey + 16 ELSE 0 END::BIGINT AS last_end, 'op' || o_orderkey AS operator, true AS acknowledged, 'node-' || o_orderkey AS node_id, 'no block ' || o_orderkey AS error, CASE WHEN o_orderkey % 4 = 0 THEN 'header' END AS problem FROM orders""")
def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages parsed; every fourth commit has lost its last byte, and the lookup of order 0 doesn't rise."""
    m = _messages(spark, sf_dir)
    x = m.withColumn("commit_", F.when(F.col("o_orderkey") % 4 == 0, F.substring("commit", 1, 127)).otherwise(F.col("commit")))
    x = frames.parse_commit(x, F.lit(1), "commit_").withColumnRenamed("problem", "bad").withColumn("token_count", F.coalesce("token_count", F.col("o_orderkey").cast("bigint"))).select("o_orderkey", "token_count", "bad", "lookup", "compute", "ack", "result", "error")
    x = frames.parse_lookup(x, "lookup").select("o_orderkey", "token_count", "bad", F.coalesce(F.element_at("candidates.token_end", -1), F.lit(0)).alias("last_end"), "compute", "ack", "result", "error")
    x = frames.parse_compute(x, "compute").select("o_orderkey", "token_count", "bad", "last_end", "operator", "ack", "result", F.col("error").alias("failure"))
    x = frames.parse_reply(x, "ack").select("o_orderkey", "token_count", "bad", "last_end", "operator", "acknowledged", "result", "failure")
    x = frames.parse_result(x, "result").select("o_orderkey", "token_count", "bad", "last_end", "operator", "acknowledged", F.col("entries")[0]["node_id"].alias("node_id"), "failure")
    return frames.parse_reply(x.withColumnRenamed("acknowledged", "acked"), "failure").select("o_orderkey", "token_count", "last_end", "operator", F.col("acked").alias("acknowledged"), "node_id", "error", F.col("bad").alias("problem"))


def _supplier_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select((F.col("s_suppkey") + 1).cast(binary.U64).alias("block_id"), F.lit(1).alias("seq"), F.concat("s_name", F.lit("|"), F.col("s_suppkey").cast("string")).cast("binary").alias("payload"))


@query("block_file_scan", "SELECT s_suppkey + 1 AS block_id, octet_length(encode(s_name || '|' || s_suppkey))::BIGINT AS length, s_name || '|' || s_suppkey AS payload FROM supplier WHERE s_suppkey % 3 <> 0")
def block_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as block files; every third is deleted, then the heads are scanned and the rest opened."""
    folder = scratch(spark, "blocks")
    blockfiles.write_blocks(_supplier_blocks(spark, sf_dir), folder).count()
    gone = blockfiles.scan_headers(spark, folder).where("problem is null and (block_id - 1) % 3 = 0")
    blockfiles.delete_files(gone).count()
    heads = blockfiles.scan_headers(spark, folder)
    data = blockfiles.opened(heads, heads.select("block_id"))
    x = heads.join(data, "block_id")
    return x.select(F.col("block_id").cast("bigint").alias("block_id"), "length", F.col("payload").cast("string").alias("payload"))


@query("block_file_stats", "SELECT count(*) AS blocks, sum(octet_length(encode(s_name || '|' || s_suppkey)))::BIGINT AS bytes, 0::BIGINT AS invalid_files FROM supplier")
def block_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "blocks")
    blockfiles.write_blocks(_supplier_blocks(spark, sf_dir), folder).count()
    return blockfiles.stats(blockfiles.scan_headers(spark, folder))


@query("manifest_files", "SELECT s_suppkey + 1 AS block_id, ((s_suppkey + 1) * 16)::BIGINT AS token_count, sha256(s_suppkey::VARCHAR) AS object_id FROM supplier WHERE s_suppkey % 4 <> 0")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as manifests and listed by token count, after those of every fourth block were deleted."""
    folder = scratch(spark, "manifests")
    sha = lambda c: F.unhex(F.sha2(c.cast("string").cast("binary"), 256))
    k = F.col("s_suppkey")
    m = read(spark, sf_dir, "supplier").select((k + 1).cast(binary.U64).alias("block_id"), ((k + 1) * 16).cast("bigint").alias("token_count"), F.lit(5).cast("bigint").alias("length"), F.lit(0).alias("checksum"), sha(F.lit("scope")).alias("scope_digest"), sha(F.lit("prefix")).alias("prefix_digest"), sha(k).alias("object_id"))
    blockfiles.write_manifests(m, folder).count()
    blockfiles.delete_files(blockfiles.read_manifests(spark, folder).where("problem is null and (block_id - 1) % 4 = 0")).count()
    left = blockfiles.read_manifests(spark, folder).where("problem is null").orderBy("token_count")
    return left.select(F.col("block_id").cast("bigint").alias("block_id"), "token_count", binary.low_hex(F.col("object_id")).alias("object_id"))


@query("disk_announcements", "SELECT s_suppkey + 1 AS block_id, octet_length(encode(s_name || '|' || s_suppkey))::BIGINT AS length, CASE WHEN s_suppkey % 4 <> 0 THEN sha256(s_suppkey::VARCHAR) END AS object_id FROM supplier")
def disk_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store tells of its disk when it starts: every block file, most with an object."""
    folder = scratch(spark, "blocks")
    blockfiles.write_blocks(_supplier_blocks(spark, sf_dir), folder).count()
    k = F.col("s_suppkey")
    index = read(spark, sf_dir, "supplier").where(k % 4 != 0).select(F.unhex(F.sha2(k.cast("string").cast("binary"), 256)).alias("object_id"), (k + 1).cast(binary.U64).alias("block_id"))
    x = store.disk_announcements(blockfiles.scan_headers(spark, folder), index, SELF)
    return x.select(F.col("block_id").cast("bigint").alias("block_id"), "length", binary.low_hex(F.col("object_id")).alias("object_id"))


@query("fanned_out", f"SELECT block_id, node_id, tier, version, plane FROM ({cluster.EVENTS_SQL}), (SELECT unnest(['plane-a', 'plane-b']) AS plane) WHERE kind = 2")
def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's deletes as two control planes hear of them."""
    e = cluster.location_events(spark, sf_dir).where(F.col("kind") == catalog.DELETE)
    return store.fanned_out(e, ["plane-a", "plane-b", "plane-a", ""]).select("block_id", "node_id", "tier", "version", "plane")


@query("text_files", "SELECT s_name || '|' || s_suppkey AS text, octet_length(encode(s_name || '|' || s_suppkey))::BIGINT AS tokens FROM supplier")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from text files, a line each."""
    folder = scratch(spark, "texts")
    read(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit("|"), F.col("s_suppkey").cast("string")).alias("value")).write.text(folder)
    return texts.files(spark, folder, lines=True).select("text", F.octet_length("text").cast("bigint").alias("tokens"))


@query("client_session", f"""WITH RECURSIVE {sql.chain('SELECT doc_id, text FROM documents', 'doc_id', SCOPE)},
ix AS (SELECT DISTINCT object FROM c WHERE doc_id % 2 = 0), h AS (SELECT c.*, ix.object IS NOT NULL AS hit FROM c LEFT JOIN ix USING (object)),
f AS (SELECT *, min(hit::INT) OVER (PARTITION BY doc_id ORDER BY idx) = 1 AS inside FROM h)
SELECT doc_id, coalesce(max(token_end) FILTER (inside), 0)::BIGINT AS matched_tokens, count(*) FILTER (inside) AS entries, CASE WHEN bool_and(hit) THEN 1 ELSE 2 END::INT AS stop_reason, bool_or(inside) AS leased FROM f GROUP BY 1""")
def client_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client puts the chunks of every second document and commits them, then looks all documents up; matches are leased."""
    c = Client(spark, SELF, cluster.SELF_ADDR)
    k = text_keys(documents(spark, sf_dir)).select("doc_id", "idx", "token_end", "scope_digest", "prefix_digest", "object_id")
    put = k.where("doc_id % 2 = 0").dropDuplicates(["object_id"]).select("scope_digest", "prefix_digest", "object_id", F.col("token_end").alias("token_count"), keys.block_id(F.col("object_id")).alias("block_id"), F.lit(1).cast("bigint").alias("seq"), F.col("prefix_digest").alias("payload"))
    c.put_objects(put.withColumns({"length": F.octet_length("payload").cast("bigint"), "checksum": F.crc32("payload")}))
    out = c.lookup_prefix(k.select("doc_id", "idx", "token_end", "object_id"), "doc_id")
    return out.select("doc_id", "matched_tokens", "entries", "stop_reason", (F.col("lease_id") != 0).alias("leased"))
