"""Operator 10: mixing sources to target weights by Pareto order sampling.

Each source gets a whole number of copies, its share of `total` by largest remainders. Inside a source a document
expects copies in proportion to its size: size * target / sum(size). The whole part is allotted with certainty; the
rest r/S in [0, 1) is an inclusion probability. Those add up to a whole k, and the k documents with the least Pareto
rank, odds of a uniform random number over odds of inclusion, get one more copy. The sample size is therefore exact.

The k least are found without sorting a source: ranks are counted in bins, whole bins below the one that holds the
k-th are taken, and only that bin is ranked. No task holds a source, however hot.

Defined cases: a null source is a source of its own. A null or negative n_chars is 0; a document of size 0 gets no copy, unless all of
its source have size 0, when all count 1. Ties of rank go to the smaller doc_id, null first; rows that repeat
a doc_id are separate and tie. An empty table gives no rows. Other columns pass through, whatever their names, but for an earlier `copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.llm.shared import materialise, set_aside

BINS = 4096
#: Sizes times copies leave BIGINT from about 5e7 documents of 4 KB in one source on.
WIDE = "decimal(38,0)"
FACTOR = "decimal(19,0)"
MOST_BROADCAST_SOURCES = 100_000


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on doc_id and seed alone."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """(source, size, flat, target) of each source. Weights are tempered, floor(sqrt(size)), unless given."""
    size = F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)).cast("bigint")
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(size.cast(WIDE)).cast(WIDE).alias("size"))
    per = per.withColumn("flat", F.col("size") == 0).withColumn("size", F.when(F.col("size") == 0, F.col("rows").cast(WIDE)).otherwise(F.col("size")))
    if weights is None:
        per = per.withColumn("weight", F.floor(F.sqrt(F.col("size").cast("double"))).cast("bigint"))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(round(v * 1_000_000)))]
        per = per.withColumn("weight", F.coalesce(F.create_map(*pairs)[F.col("source")] if pairs else F.lit(0), F.lit(0)).cast("bigint"))
    per = materialise(per, "sources")
    sums = per.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weight")).first()
    rows, weight = sums.all_rows or 0, sums.all_weight or 0
    n = rows if total is None else total
    product, by = f"cast({n}L as {FACTOR}) * cast(weight as {FACTOR})", f"cast({max(weight, 1)}L as {FACTOR})"
    whole = F.expr(f"{product} div {by}") if weight else F.lit(0).cast("bigint")
    left = F.expr(f"({product}) % {by}").cast("bigint")
    per = per.withColumn("whole", whole).withColumn("left", left)
    spare = (n - (per.agg(F.sum("whole")).first()[0] or 0)) if weight else 0
    order = Window.orderBy(F.desc("left"), F.asc_nulls_first("source"))
    return per.select("source", "size", "flat", (F.col("whole") + (F.row_number().over(order) <= spare).cast("bigint")).alias("target"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 10) -> DataFrame:
    """docs with a `copies` column, rows that get none left out."""
    def few(right: DataFrame) -> DataFrame:
        return F.broadcast(right) if right.limit(MOST_BROADCAST_SOURCES + 1).count() <= MOST_BROADCAST_SOURCES else right

    had = docs.columns
    docs, restore = set_aside(docs.drop("copies") if "copies" in had else docs)
    aim = materialise(targets(docs, weights, total).select(F.col("source").alias("__px_s"), F.col("size").alias("__px_size"), F.col("flat").alias("__px_flat"), F.col("target").alias("__px_target")), "targets")
    x = docs.join(few(aim), F.col("source").eqNullSafe(F.col("__px_s")))
    own = F.when(F.col("__px_flat"), F.lit(1)).otherwise(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0))).cast("bigint")
    x = x.withColumn("__px_share", (own.cast(FACTOR) * F.col("__px_target").cast(FACTOR)).cast(WIDE))
    x = x.withColumn("__px_sure", F.expr("__px_share div __px_size")).withColumn("__px_r", F.expr("__px_share % __px_size").cast(WIDE))
    u = uniform(F.col("doc_id"), seed)
    x = x.withColumn("__px_u", u)
    rank = F.when(F.col("__px_r") > 0, (F.col("__px_u") / (1 - F.col("__px_u"))) * ((F.col("__px_size") - F.col("__px_r")).cast("double") / F.col("__px_r").cast("double")))
    x = x.withColumn("__px_q", rank).withColumn("__px_bin", F.least(F.floor(F.col("__px_q") / (1 + F.col("__px_q")) * BINS), F.lit(BINS - 1)).cast("int"))

    counts = x.groupBy("__px_s", "__px_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("__px_r").cast(WIDE).alias("r"), F.first("__px_size").alias("size"))
    open_rows = counts.where("__px_bin is not null")
    k = open_rows.groupBy("__px_s").agg(F.expr(f"cast(sum(r) as {WIDE}) div first(size)").alias("k"))
    run = open_rows.withColumn("upto", F.sum("n").over(Window.partitionBy("__px_s").orderBy("__px_bin")))
    run = run.join(k.withColumnRenamed("__px_s", "s2"), F.col("__px_s").eqNullSafe(F.col("s2")))
    edge = run.where("upto >= k and upto - n < k").select(F.col("__px_s").alias("__px_s3"), F.col("__px_bin").alias("__px_edge"), (F.col("k") - F.col("upto") + F.col("n")).alias("__px_rest"))
    edge = materialise(edge, "edges")
    x = x.join(few(edge), F.col("__px_s").eqNullSafe(F.col("__px_s3")), "left")
    below = F.coalesce(F.col("__px_bin") < F.col("__px_edge"), F.lit(False))
    at = F.coalesce(F.col("__px_bin") == F.col("__px_edge"), F.lit(False))
    plain = x.where(~at).withColumn("copies", F.col("__px_sure") + below.cast("bigint"))
    order = Window.partitionBy("__px_s").orderBy("__px_q", F.asc_nulls_first("doc_id"))
    ranked = x.where(at).withColumn("copies", F.col("__px_sure") + (F.row_number().over(order) <= F.col("__px_rest")).cast("bigint"))
    out = [c for c in docs.columns] + ["copies"]
    return restore(plain.select(out).unionAll(ranked.select(out)).where("copies > 0"))


SQL = """
WITH d AS (SELECT doc_id, source, greatest(coalesce(n_chars, 0), 0) AS own FROM {docs}),
p AS (SELECT source, CASE WHEN sum(own) = 0 THEN count(*) ELSE sum(own) END::HUGEINT AS size, sum(own) = 0 AS flat FROM d GROUP BY source),
w AS (SELECT *, floor(sqrt(size::DOUBLE))::BIGINT AS weight, (SELECT count(*) FROM d)::HUGEINT AS n FROM p),
a AS (SELECT *, (sum(weight) OVER ())::HUGEINT AS all_weight FROM w),
t AS (SELECT *, (n * weight // all_weight)::BIGINT AS whole, (n * weight) % all_weight AS left_over FROM a),
aim AS (SELECT source, size, flat, whole + CASE WHEN row_number() OVER (ORDER BY left_over DESC, source ASC NULLS FIRST) <= n - (sum(whole) OVER ())::BIGINT THEN 1 ELSE 0 END AS target FROM t),
x AS (SELECT d.doc_id, d.source, aim.size, CASE WHEN flat THEN 1 ELSE own END::HUGEINT * target AS share,
        (('0x' || substr(md5('10:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM d JOIN aim ON d.source IS NOT DISTINCT FROM aim.source),
y AS (SELECT *, share // size AS sure, share % size AS r FROM x),
z AS (SELECT *, CASE WHEN r > 0 THEN (u / (1 - u)) * ((size - r)::DOUBLE / r::DOUBLE) END AS q, ((sum(r) OVER (PARTITION BY source))::HUGEINT // size)::BIGINT AS k FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q ASC NULLS LAST, doc_id ASC NULLS FIRST) AS rn FROM z)
SELECT doc_id, source, (sure + CASE WHEN rn <= k AND r > 0 THEN 1 ELSE 0 END)::BIGINT AS copies FROM o
WHERE sure + CASE WHEN rn <= k AND r > 0 THEN 1 ELSE 0 END > 0
"""
