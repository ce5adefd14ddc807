"""Prompts from where a command line takes them: given inline, or as files, one prompt a file or a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inline(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(name, text) of texts at hand, named by their position."""
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, text string")


def files(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(name, text): a row a file, or a line."""
    x = spark.read.option("wholetext", str(not lines).lower()).option("recursiveFileLookup", "true").text(path)
    return x.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
