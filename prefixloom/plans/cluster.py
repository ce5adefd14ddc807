"""Queries about the catalogue, membership, routing and replicas. The log of locations is `lineitem`, the nodes are `supplier`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixloom.functions import binary
from prefixloom.operators import catalog, lookup, routing
from prefixloom.plans.registry import query
from prefixloom.plans.reuse import read

SELF, SELF_ADDR = "node-1", "host-1:9090"
TTL_S = 30 * 86400


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("node-"), "s_suppkey").alias("node_id"), F.concat(F.lit("host-"), "s_suppkey", F.lit(":9090")).alias("addr"), F.when(F.col("s_acctbal") < 0, catalog.DOWN).otherwise(catalog.ALIVE).alias("state"), F.lit(1).cast("bigint").alias("version"))


def location_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(read(spark, sf_dir, "lineitem"))


def events_of(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_partkey").alias("block_id"), F.concat(F.lit("node-"), "l_suppkey").alias("node_id"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("tier"),
        F.when(F.col("l_returnflag") == "R", catalog.DELETE).otherwise(catalog.UPSERT).alias("kind"), (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 1).cast("bigint").alias("version"),
        (F.col("l_quantity") * 64).cast("bigint").alias("length"), (F.col("l_partkey") * 31).cast("bigint").alias("checksum"), F.col("l_shipdate").alias("event_time"),
    )


NODES_SQL = "SELECT 'node-' || s_suppkey AS node_id, 'host-' || s_suppkey || ':9090' AS addr, CASE WHEN s_acctbal < 0 THEN 3 ELSE 1 END AS state FROM supplier"
EVENTS_SQL = """SELECT l_partkey AS block_id, 'node-' || l_suppkey AS node_id, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS tier, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS kind,
 (l_orderkey * 8 + l_linenumber + 1)::BIGINT AS version, (l_quantity * 64)::BIGINT AS length, (l_partkey * 31)::BIGINT AS checksum, l_shipdate AS event_time FROM lineitem"""
STATE_SQL = f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY block_id, node_id, tier ORDER BY version DESC) AS r FROM ({EVENTS_SQL})) WHERE r = 1"
VIEW_SQL = f"SELECT s.*, coalesce(n.addr, '') AS addr FROM ({STATE_SQL}) s LEFT JOIN ({NODES_SQL}) n USING (node_id) WHERE kind = 1"
REPLAYED = ["block_id", "node_id", "tier", "kind", "version", "length", "checksum"]


@query("location_replay", f"SELECT {', '.join(REPLAYED)} FROM ({STATE_SQL})")
def location_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.replay(location_events(spark, sf_dir)).select(*REPLAYED)


@query("location_clock", f"SELECT max(version)::BIGINT AS version FROM ({EVENTS_SQL})")
def location_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.clock(location_events(spark, sf_dir))


@query("location_view", f"SELECT block_id, node_id, tier, version, addr FROM ({VIEW_SQL})")
def location_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.locations(catalog.replay(location_events(spark, sf_dir)), nodes(spark, sf_dir))
    return x.select("block_id", "node_id", "tier", "version", "addr")


@query("tombstones_kept", f"SELECT block_id, node_id, tier, version FROM ({STATE_SQL}) WHERE kind = 2 AND epoch((SELECT max(l_shipdate) FROM lineitem)) - epoch(event_time) <= {TTL_S}")
def tombstones_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones that are still within their time to live when the log ends."""
    e = location_events(spark, sf_dir)
    x = catalog.replay(e).crossJoin(F.broadcast(e.agg(F.max("event_time").alias("now"))))
    return catalog.prune(x, F.col("now"), TTL_S).where(F.col("kind") == catalog.DELETE).select("block_id", "node_id", "tier", "version")


@query("best_replicas", f"""SELECT block_id, node_id, addr, tier, version FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY CASE tier WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, node_id, addr, version DESC) AS r
 FROM ({VIEW_SQL}) WHERE addr <> '' AND node_id <> '{SELF}' AND addr <> '{SELF_ADDR}') WHERE r = 1""")
def best_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.locations(catalog.replay(location_events(spark, sf_dir)), nodes(spark, sf_dir))
    return lookup.best_replica(lookup.readable(x, SELF, SELF_ADDR).select("block_id", "node_id", "addr", "tier", "version"), ["block_id"])


@query("read_order", f"SELECT block_id, node_id, tier, (row_number() OVER (PARTITION BY block_id ORDER BY tier <> 1, version DESC, node_id, tier))::INT AS rank FROM ({VIEW_SQL})")
def read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.locations(catalog.replay(location_events(spark, sf_dir)), nodes(spark, sf_dir))
    return lookup.read_order(x, ["block_id"]).select("block_id", "node_id", "tier", "rank")


@query("all_replicas", f"WITH v AS ({VIEW_SQL}) SELECT block_id, count(*)::BIGINT AS replicas, count(DISTINCT node_id)::BIGINT AS nodes FROM (SELECT * FROM v UNION ALL SELECT * FROM v WHERE tier = 1) GROUP BY 1")
def all_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coordinators' lists one after the other, repeats kept: one knows every location, one those in memory."""
    v = catalog.locations(catalog.replay(location_events(spark, sf_dir)), nodes(spark, sf_dir))
    return catalog.all_replicas(v, v.where("tier = 1")).groupBy("block_id").agg(F.count(F.lit(1)).alias("replicas"), F.countDistinct("node_id").alias("nodes"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are orders, candidates their lines in order: 16 tokens each. A line whose tax is 8 % finds its block busy."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = read(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(w) - 1)
    return x.select(F.col("l_orderkey").alias("request_id"), "idx", F.col("l_partkey").alias("object_id"), ((F.col("idx") + 1) * 16).cast("bigint").alias("token_end"), (F.col("l_tax") >= 0.08).alias("busy"))


_LOOKUP_SQL = f"""WITH v AS ({VIEW_SQL}),
q AS (SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, l_partkey AS object_id, l_tax >= 0.08 AS busy FROM lineitem),
own AS (SELECT block_id, length, row_number() OVER (PARTITION BY block_id ORDER BY tier) AS r FROM v WHERE node_id = '{SELF}'),
far AS (SELECT DISTINCT block_id FROM v WHERE addr <> '' AND node_id <> '{SELF}' AND addr <> '{SELF_ADDR}'),
x AS (SELECT q.*, (idx + 1) * 16 AS token_end, own.length IS NOT NULL AND own.length = p_size * 64 AND (idx + 1) * 16 = 16 AS here, far.block_id IS NOT NULL AS there
      FROM q LEFT JOIN part ON p_partkey = object_id LEFT JOIN own ON own.block_id = object_id AND own.r = 1 LEFT JOIN far ON far.block_id = object_id),
h AS (SELECT *, NOT busy AND (coalesce(here, false) OR there) AS hit, CASE WHEN busy THEN 4 ELSE 2 END AS why FROM x),
f AS (SELECT *, min(hit::INT) OVER (PARTITION BY request_id ORDER BY idx) = 1 AS inside FROM h)
SELECT request_id, coalesce(max(token_end) FILTER (inside), 0)::BIGINT AS matched_tokens, count(*) FILTER (inside) AS entries, coalesce(arg_min(why, idx) FILTER (NOT hit), 1)::INT AS stop_reason FROM f GROUP BY 1"""


@query("prefix_lookup", _LOOKUP_SQL)
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's lines looked up: in the index and a local tier that agree, else at the best remote replica."""
    v = catalog.locations(catalog.replay(location_events(spark, sf_dir)), nodes(spark, sf_dir)).withColumn("object_id", F.col("block_id"))
    index = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), F.lit(16).cast("bigint").alias("token_count"), (F.col("p_size") * 64).cast("bigint").alias("length"), (F.col("p_partkey") * 31).alias("checksum"))
    r = lookup.resolve(_candidates(spark, sf_dir), index, v.where(F.col("node_id") == SELF), lookup.readable(v, SELF, SELF_ADDR))
    return lookup.prefix_results(r, "request_id")


@query("candidate_errors", """WITH q AS (SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS idx, l_linenumber * 16 AS token_end FROM lineitem),
b AS (SELECT *, token_end <= coalesce(lag(token_end) OVER (PARTITION BY request_id ORDER BY idx), 0) AS bad FROM q)
SELECT request_id, 'unordered' AS reason FROM b GROUP BY 1 HAVING bool_or(bad)""")
def candidate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines, taken in order of part, are no valid request."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.row_number().over(w).alias("idx"), F.col("l_partkey").cast("string").alias("object_id"), (F.col("l_linenumber") * 16).alias("token_end"))
    return lookup.invalid_candidates(x, "request_id")


@query("fetch_attempts", """WITH a AS (SELECT l_orderkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, l_suppkey AS node, l_returnflag <> 'R' AS good, 'status ' || l_linestatus AS error FROM lineitem)
SELECT block, arg_min(node, rank) FILTER (good) AS node, coalesce(bool_or(good), false) AS ok, CASE WHEN NOT bool_or(good) THEN arg_max(error, rank) END AS last_error FROM a GROUP BY 1""")
def fetch_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first replica that serves each block, in read order; otherwise the last error."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.row_number().over(w).alias("rank"), F.col("l_suppkey").alias("node"), (F.col("l_returnflag") != "R").alias("good"), F.concat(F.lit("status "), "l_linestatus").alias("error"))
    return lookup.first_good(x, ["block"], F.col("good")).select("block", "node", "ok", "last_error")


@query("result_violations", """WITH e AS (SELECT l_orderkey AS r, count(*) AS n, max(l_linenumber * 16) AS last FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey AS request_id, o_custkey AS lease_id, 16 AS matched, coalesce(n, 0) AS n, coalesce(last, 0) AS last FROM orders LEFT JOIN e ON r = o_orderkey)
SELECT request_id, CASE WHEN (n > 0) <> (coalesce(lease_id, 0) <> 0) THEN 'lease' ELSE 'matched' END AS problem FROM x WHERE (n > 0) <> (coalesce(lease_id, 0) <> 0) OR matched <> last""")
def result_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") * 16).alias("token_end"))
    results = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit(16).alias("matched_tokens"), F.col("o_custkey").alias("lease_id"))
    return lookup.violations(entries, results, "request_id")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership commands: each kind of event is one, its user the node."""
    op = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("node-"), "user_id").alias("node_id"), F.col("event_id").alias("seq"), op[F.col("event_type")].alias("op"), F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(0).cast("bigint").alias("version"), F.when(F.col("event_type") == "view", 2).otherwise(1).alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


OPS = {"signup": "register", "click": "heartbeat", "view": "mark", "error": "leave", "purchase": "upsert"}
_OPS_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in OPS.items()) + " END"


@query("membership_replay", f"""WITH RECURSIVE c AS (SELECT 'node-' || user_id AS node_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, {_OPS_SQL} AS op,
 CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT ELSE 0 END AS v, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS s, epoch_us(ts) AS tick FROM events),
m(node_id, k, state, version, last, applied) AS (
 SELECT DISTINCT node_id, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0 FROM c
 UNION ALL
 SELECT node_id, k, CASE WHEN NOT ok THEN state WHEN op IN ('register', 'heartbeat') THEN 1 WHEN op = 'leave' THEN 4 ELSE s END,
  CASE WHEN NOT ok THEN version WHEN op IN ('register', 'upsert') THEN nv ELSE version + 1 END, CASE WHEN NOT ok OR op = 'mark' THEN last ELSE tick END, applied + ok::INT
 FROM (SELECT y.*, CASE op WHEN 'leave' THEN true WHEN 'heartbeat' THEN version > 0 AND state <> 4 WHEN 'mark' THEN version > 0 AND (state <> 4 OR s = 4) ELSE version = 0 OR nv > version END AS ok
  FROM (SELECT m.node_id, c.k, m.state, m.version, m.last, m.applied, c.op, c.s, c.tick, CASE WHEN c.op = 'register' AND m.version > 0 AND c.v <= m.version THEN m.version + 1 ELSE c.v END AS nv FROM m JOIN c ON c.node_id = m.node_id AND c.k = m.k + 1) y))
SELECT node_id, state::INT AS state, version::BIGINT AS version, last::BIGINT AS last_heartbeat, applied::INT AS applied FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY k DESC) AS r FROM m) WHERE r = 1 AND version > 0""")
def membership_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.membership(commands(spark, sf_dir)).drop("rejected")


@query("members_merged", """SELECT node_id, version, seq, state FROM (SELECT 'node-' || user_id AS node_id, floor(value)::BIGINT AS version, event_id AS seq, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 WHEN event_type = 'error' THEN 4 ELSE 1 END AS state,
 row_number() OVER (PARTITION BY user_id ORDER BY floor(value)::BIGINT DESC, event_id) AS r FROM events) WHERE r = 1""")
def members_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 4).otherwise(1)
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("node-"), "user_id").alias("node_id"), F.floor("value").cast("bigint").alias("version"), F.col("event_id").alias("seq"), state.alias("state"))
    return catalog.merge_members(e).select("node_id", "version", "seq", "state")


@query("reroutes", """WITH h AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 2 ELSE 1 END AS state, event_type AS addr FROM events),
l AS (SELECT *, lag(state) OVER w AS was, lag(addr) OVER w AS old FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) FILTER (CASE WHEN was IS NULL THEN state = 1 ELSE (state = 1) <> (was = 1) OR (state = 1 AND addr <> old) END) AS reroutes FROM l GROUP BY 1""")
def reroutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "view", 2).otherwise(1).alias("state"), F.col("event_type").alias("addr"))
    return catalog.route_affecting(e).groupBy(F.col("node_id").alias("user_id")).agg(F.count(F.when(F.col("reroutes"), 1)).alias("reroutes"))


@query("announcements", """SELECT e.event_id, CASE WHEN user_id = 0 THEN 'INVALID_ARGUMENT' WHEN event_type = 'signup' THEN 'INVALID_ARGUMENT' WHEN event_type <> 'error' AND s_suppkey IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status
FROM events e LEFT JOIN supplier ON s_suppkey = user_id""")
def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcing (or, for errors, forgetting) a block on the node that bears the user's number; sign-ups name no tier."""
    e = read(spark, sf_dir, "events")
    x = e.select("event_id", F.concat(F.lit("node-"), "user_id").alias("node_id"), F.col("user_id").alias("block_id"), F.when(F.col("event_type") == "signup", 0).otherwise(1).alias("tier"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("kind"), F.lit(b"").alias("object_id"))
    return catalog.announced(x, nodes(spark, sf_dir)).select("event_id", "status")


_TOP = "18446744073709551615::UHUGEINT"
ROUTES_SQL = f"""SELECT node_id, number, n, (number::UHUGEINT * step)::VARCHAR::DECIMAL(20,0) AS lo, CASE WHEN number = n - 1 THEN {_TOP} ELSE (number + 1)::UHUGEINT * step - 1 END::VARCHAR::DECIMAL(20,0) AS hi, step
FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS number, count(*) OVER () AS n, {_TOP} // (count(*) OVER ())::UHUGEINT + 1 AS step FROM ({NODES_SQL}) WHERE state = 1)"""
#: Order keys spread over the unsigned 64-bit space: key * STEP mod 2^64.
STEP = 1229782938247303
BLOCKS_SQL = f"SELECT o_orderkey, o_orderkey::UHUGEINT * {STEP} % 18446744073709551616::UHUGEINT AS block FROM orders"


@query("route_ranges", f'SELECT node_id, number, n AS nodes, lo AS "start", hi AS "end" FROM ({ROUTES_SQL})')
def route_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.ranges(nodes(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", binary.times64(F.col("o_orderkey").cast(binary.U64), STEP).alias("block_id"))


@query("routed_blocks", f"""WITH r AS ({ROUTES_SQL}), b AS ({BLOCKS_SQL}), k AS (SELECT unnest(range(3)) AS k),
x AS (SELECT o_orderkey, k, (block // (SELECT any_value(step) FROM r) + k)::BIGINT % (SELECT count(*) FROM r) AS number FROM b, k)
SELECT o_orderkey, (k + 1)::INT AS rank, node_id, k = 0 AS is_primary FROM x JOIN r USING (number)""")
def routed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = routing.locate(_blocks(spark, sf_dir), "block_id", routing.ranges(nodes(spark, sf_dir)), 3)
    return x.select("o_orderkey", "rank", "node_id", "is_primary")


@query("route_owners", f"""WITH r AS ({ROUTES_SQL}), b AS ({BLOCKS_SQL}), k AS (SELECT unnest(range(2)) AS k),
x AS (SELECT o_orderkey, k, (block // (SELECT any_value(step) FROM r) + k)::BIGINT % (SELECT count(*) FROM r) AS number FROM b, k)
SELECT o_orderkey, max(node_id) FILTER (k = 0) AS owner, bool_or(k = 0 AND node_id = '{SELF}') AS owns, bool_or(node_id = '{SELF}') AS involved FROM x JOIN r USING (number) GROUP BY 1""")
def route_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.owns(_blocks(spark, sf_dir), "block_id", routing.ranges(nodes(spark, sf_dir)), SELF, 2).drop("block_id")


@query("route_changes", f"""WITH a AS ({ROUTES_SQL}), b AS ({ROUTES_SQL.replace("WHERE state = 1", "")})
SELECT coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN b.node_id IS NULL THEN 'added' WHEN a.node_id IS NULL THEN 'removed' ELSE 'moved' END AS change
FROM b FULL JOIN a ON a.node_id = b.node_id WHERE a.node_id IS NULL OR b.node_id IS NULL OR a.lo <> b.lo OR a.hi <> b.hi""")
def route_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes when the nodes in debt go down."""
    n = nodes(spark, sf_dir)
    return routing.changed_routes(routing.ranges(n.withColumn("state", F.lit(1))), routing.ranges(n))


@query("route_cover")
def route_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary prefixes that cover each node's range; held against brute force by a test."""
    return routing.range_cover(routing.ranges(nodes(spark, sf_dir)))


_M64 = "18446744073709551616::UHUGEINT"


def _finaliser(e: str) -> str:
    x = f"xor({e}, ({e}) >> 33)"
    for f in ("18397679294719823053", "14181476777654086739"):
        x = f"(({x})::UHUGEINT * {f}::UHUGEINT % {_M64})::UBIGINT"
        x = f"list_transform([{x}], lambda z: xor(z, z >> 33))[1]"
    return x


_FNV = f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::UHUGEINT)), lambda a, b: xor(a::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT % {_M64})::UBIGINT"


@query("murmur_keys", f"SELECT c_custkey, ({_finaliser('c_custkey::UBIGINT')})::DECIMAL(20,0) AS hash FROM customer")
def murmur_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", binary.murmur_finaliser(F.col("c_custkey").cast(binary.U64)).alias("hash"))


@query("ring_nodes", f"""WITH n AS (SELECT node_id, node_id || '#' || r AS s FROM ({NODES_SQL}), (SELECT unnest(range({routing.REPLICAS})) AS r) WHERE state = 1),
f AS (SELECT node_id, {_FNV} AS h FROM n), p AS (SELECT {_finaliser('h')} AS hash, min(node_id) AS node_id FROM f GROUP BY 1),
b AS (SELECT c_custkey, {_finaliser('c_custkey::UBIGINT')} AS hash FROM customer)
SELECT c_custkey, coalesce(p.node_id, (SELECT arg_min(node_id, hash) FROM p)) AS node_id FROM b ASOF LEFT JOIN p ON b.hash <= p.hash""")
def ring_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.locate_ring(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", routing.ring(nodes(spark, sf_dir)))
