"""The corpus operators as named queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefixloom.llm import chaining, decontam, langid, mixing, pitmanyor, projections, setsketch, styletree, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


@_query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_read(spark, sf_dir, "documents"))


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


ORACLES["op4_decontamination"] = decontam.SQL.format(docs="documents", bench="benchmark")


@_query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.groups(_read(spark, sf_dir, "documents"))


@_query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(_read(spark, sf_dir, "documents")).drop("part")


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "copies")


ORACLES["op10_mixing"] = mixing.SQL.format(docs="documents")


@_query
def op3_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.extract(_read(spark, sf_dir, "pages"))


@_query
def op5_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.groups(_read(spark, sf_dir, "embeddings"))


@_query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


ORACLES["op6_warc"] = warc.SQL.format(pages="pages")


@_query
def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.perplexities(_read(spark, sf_dir, "documents"))
