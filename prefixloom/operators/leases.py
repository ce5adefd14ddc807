"""Leases as intervals: a lease pins its blocks from its acquisition to its release or its expiry, whichever is first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(acquired: DataFrame, released: DataFrame, ttl: int) -> DataFrame:
    """(lease_id, block_id, begins, ends): acquired (lease_id, block_id, at), released (lease_id, at)."""
    r = released.groupBy("lease_id").agg(F.min("at").alias("r"))
    x = acquired.join(r, "lease_id", "left")
    return x.select("lease_id", "block_id", F.col("at").alias("begins"), F.least(F.col("at") + ttl, F.when(F.col("r") >= F.col("at"), F.col("r"))).alias("ends"))


def pins(leases: DataFrame) -> DataFrame:
    """(block_id, most): the greatest number of leases that hold a block at once. Ends count before beginnings of the same instant."""
    x = leases.select("block_id", F.col("begins").alias("at"), F.lit(1).alias("d")).unionAll(leases.select("block_id", F.col("ends").alias("at"), F.lit(-1).alias("d")))
    w = Window.partitionBy("block_id").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("n", F.sum("d").over(w)).groupBy("block_id").agg(F.max("n").alias("most"))


def mutations(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """requests (request_id, block_id, at) with `busy`: whether a lease holds the block then.

    A sweep over begin and end points instead of an interval join: pins and requests sorted together by block.
    """
    a = leases.select("block_id", F.col("begins").alias("at"), F.lit(1).alias("o"), F.lit(1).alias("d"), F.lit(None).cast("bigint").alias("request_id"))
    z = leases.select("block_id", F.col("ends").alias("at"), F.lit(0).alias("o"), F.lit(-1).alias("d"), F.lit(None).cast("bigint").alias("request_id"))
    q = requests.select("block_id", "at", F.lit(2).alias("o"), F.lit(0).alias("d"), F.col("request_id").cast("bigint").alias("request_id"))
    w = Window.partitionBy("block_id").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    x = a.unionAll(z).unionAll(q).withColumn("open", F.sum("d").over(w))
    return x.where("o = 2").select("request_id", "block_id", "at", (F.col("open") > 0).alias("busy"))


def single_flights(requests: DataFrame, key: str, at: str, flight: int) -> DataFrame:
    """(key, requests, flights): the first request of a key, and any that comes when the flight of the last leader has landed, starts a
    flight; others share it. Who leads depends on the leader before, so a key is read in order of time; a task holds one batch of it, and
    finds each next leader by bisection. Requests without a time aren't counted; a key that has none but those gives no row.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = requests.schema[key].dataType.simpleString()

    def run(batches):
        now, until, n, flights = None, None, 0, 0
        for b in batches:
            out, keys_, ats = [], b.column(0), b.column(1).to_numpy()
            if not len(ats):
                continue
            runs = pc.run_end_encode(keys_)
            lo = 0
            for k, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if n == 0 or k != now:
                    if n:
                        out.append((now, n, flights))
                    now, until, n, flights = k, None, 0, 0
                own, i = ats[lo:hi], 0
                n += hi - lo
                while True:
                    if until is not None:
                        i += int(np.searchsorted(own[i:], until))
                    if i >= len(own):
                        break
                    flights, until = flights + 1, int(own[i]) + flight
                lo = hi
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], keys_.type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], [key, "requests", "flights"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([now], keys_.type), pa.array([n], pa.int64()), pa.array([flights], pa.int64())], [key, "requests", "flights"])

    x = requests.select(key, F.col(at).cast("bigint").alias("__at")).where("__at is not null")
    return x.repartition(key).sortWithinPartitions(key, "__at").mapInArrow(run, f"`{key}` {kind}, requests bigint, flights bigint")
