"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one of our own, which only a local master has in common with its tasks."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("prefixloom.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        at = "file://" + tempfile.mkdtemp(prefix="prefixloom-")
        spark.conf.set("prefixloom.checkpoint.dir", at)
    return at.rstrip("/")


_made: list[str] = []


def made() -> int:
    """How many paths scratch() has given out: a mark for release()."""
    return len(_made)


def release(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete the paths given out since the mark, but for those that keep reads."""
    used = {f.split("/part-")[0].rstrip("/").split("/")[-1] for f in keep.inputFiles()}
    for path in _made[mark:]:
        if path.split("/")[-1] not in used:
            delete(spark, path)
    _made[mark:] = [p for p in _made[mark:] if p.split("/")[-1] in used]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/prefixloom/{name}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    _made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Bytes of rows that go to a Python process at once: the engine holds them outside its heap, and by default 10,000 of them, however long.
SENT_BYTES = 1 << 22
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends rows to Python processes SENT_BYTES at a time, or as many as the session's setting has if these are fewer."""
    before = spark.conf.get(_BYTES)
    digits = before.strip().lower().removesuffix("b")
    if digits.isdigit() and int(digits) <= SENT_BYTES:
        yield
        return
    spark.conf.set(_BYTES, str(SENT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: a lineage cut that outlives executors."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
