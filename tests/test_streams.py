"""Streams agree with the batch operators on the same traces."""

import random

from pyspark.sql import functions as F

from prefixloom.operators import catalog
from prefixloom.streaming import replay


def test_expiring_locations_equal_the_replay(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randint(1, 4), f"n{r.randint(0, 1)}", r.randint(1, 2), r.randint(1, 2), v) for v in r.sample(range(1, 200), 60)]
    schema = "block_id long, node_id string, tier int, kind int, version long"
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    out = replay.drain(replay.expiring_locations(stream, None), "update")
    last = out.groupBy("block_id", "node_id", "tier").agg(F.max_by("kind", "version").alias("kind"), F.max("version").alias("version"))
    want = catalog.replay(spark.createDataFrame(rows, schema)).select("block_id", "node_id", "tier", "kind", "version")
    assert sorted(last.select(*want.columns).collect()) == sorted(want.collect())


def test_members_equal_the_replay(spark, tmp_path):
    r = random.Random(5)
    ops = ["register", "heartbeat", "mark", "leave", "upsert"]
    rows = [(f"n{r.randint(0, 3)}", s, r.choice(ops), r.randint(1, 9), r.choice([1, 2, 3]), s * 10) for s in range(60)]
    schema = "node_id string, seq long, op string, version long, state int, at long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "c"))
    out = replay.drain(replay.members(spark.readStream.schema(schema).parquet(str(tmp_path / "c"))), "update")
    want = catalog.membership(spark.createDataFrame(rows, schema)).select("node_id", "state", "version", "last_heartbeat")
    assert sorted(out.select(*want.columns).collect()) == sorted(want.collect())
