"""The same questions asked of streams: results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.plans import cluster
from prefixloom.plans.registry import query
from prefixloom.streaming import replay


@query("stream_location_replay", f"SELECT {', '.join(cluster.REPLAYED)} FROM ({cluster.STATE_SQL})")
def stream_location_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log replayed as a stream of files, to its end."""
    events = cluster.events_of(replay.log(spark, sf_dir, "lineitem.parquet"))
    return replay.drain(replay.last_writes(events), "complete", "locations").select(*cluster.REPLAYED)


@query("stream_event_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache events per day, counted in event-time windows under a watermark."""
    e = replay.log(spark, sf_dir, "events.parquet").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    x = e.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return replay.drain(x, "complete", "windows").select(F.unix_micros("window.start").alias("day"), "event_type", "events")
