"""The catalogue and leases as streams. What a built-in aggregate can hold stays in it; timers and state machines are stateful processors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prefixloom.operators import catalog
from prefixloom.sources.shared import shared_folder


def log(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """An append-only log of Parquet files as a stream; the schema is the batch reader's."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def last_writes(events: DataFrame) -> DataFrame:
    """Last write per (block, node, tier) of a stream of events: an incremental aggregate. Events out of order lose by version; state grows with the keys."""
    return catalog.replay(events)


def drain(stream: DataFrame, mode: str = "complete", name: str = "drain") -> DataFrame:
    """Run a stream to the end of what is there now and return its last result, written to the shared folder.

    Every batch overwrites a folder of its own, so a batch that is repeated after a failure leaves no double rows.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/prefixloom/{name}-{uuid.uuid4().hex}"
    last: dict[str, int] = {}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch-{number}")
        last["batch"] = number

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if "batch" not in last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/batch-{last['batch']}")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*[f"{base}/batch-{i}" for i in range(last["batch"] + 1)])


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Locations(StatefulProcessor):
    """Last write per key. A tombstone's state expires, unless ttl_ms is None; a late upsert may then revive the key, as its version is forgotten with it."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "version long")
        self.dead = handle.getValueState("dead", "version long", self.ttl_ms) if self.ttl_ms else handle.getValueState("dead", "version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        version, kind = 0, 0
        if self.live.exists():
            version, kind = self.live.get()[0], catalog.UPSERT
        elif self.dead.exists():
            version, kind = self.dead.get()[0], catalog.DELETE
        for pdf in rows:
            for v, k in zip(pdf["version"], pdf["kind"]):
                if v > version:
                    version, kind = int(v), int(k)
        (self.live if kind == catalog.UPSERT else self.dead).update((version,))
        (self.dead if kind == catalog.UPSERT else self.live).clear()
        yield pd.DataFrame({"block_id": [key[0]], "node_id": [key[1]], "tier": [key[2]], "version": [version], "kind": [kind]})

    def close(self) -> None:
        pass


def expiring_locations(events: DataFrame, ttl_s: int | None = catalog.TOMBSTONE_TTL_S) -> DataFrame:
    """Changes of (block, node, tier), tombstones kept for ttl_s. Needs the RocksDB state store, STATE_STORE.

    Expiry goes by processing time, under which a stream has always another batch to run: drain() doesn't end. ttl_s = None keeps tombstones.
    """
    schema = "block_id long, node_id string, tier int, version long, kind int"
    x = events.where("version > 0").groupBy(*catalog.KEY)
    return x.transformWithStateInPandas(Locations(ttl_s * 1000 if ttl_s else None), schema, "Update", "ProcessingTime" if ttl_s else "None")


class Members(StatefulProcessor):
    """The membership state machine of one node; commands of a batch are applied in order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("node", "state int, version long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, version, last = self.state.get() if self.state.exists() else (0, 0, 0)
        for c in pd.concat(list(rows)).sort_values("seq").itertuples():
            if c.op in ("register", "upsert"):
                number = version + 1 if c.op == "register" and version and c.version <= version else c.version
                if version == 0 or number > version:
                    state, version, last = (1 if c.op == "register" or c.state == 0 else c.state), number, c.at
            elif c.op == "leave":
                state, version, last = catalog.TOMBSTONE, version + 1, c.at
            elif version and state != catalog.TOMBSTONE:
                state, version, last = (1, version + 1, c.at) if c.op == "heartbeat" else (c.state, version + 1, last)
        if version:
            self.state.update((int(state), int(version), int(last)))
        yield pd.DataFrame({"node_id": [key[0]], "state": [int(state)], "version": [int(version)], "last_heartbeat": [int(last)]})

    def close(self) -> None:
        pass


def members(commands: DataFrame) -> DataFrame:
    return commands.groupBy("node_id").transformWithStateInPandas(Members(), "node_id string, state int, version long, last_heartbeat long", "Update", "None")


class Pins(StatefulProcessor):
    """Leases of one block that are open, by event time: a lease ends at its release, or by timer when its time to live is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "lease long", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for r in pd.concat(list(rows)).sort_values("at_ms").itertuples():
            if r.op == "acquire":
                until = int(r.at_ms) + self.ttl_ms
                self.open.updateValue((int(r.lease_id),), (until,))
                self.handle.registerTimer(until)
            elif self.open.containsKey((int(r.lease_id),)):
                self.open.removeKey((int(r.lease_id),))
        yield self._row(key)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for k, v in list(self.open.iterator()):
            if v[0] <= now:
                self.open.removeKey(k)
        yield self._row(key)

    def _row(self, key: Any) -> pd.DataFrame:
        return pd.DataFrame({"block_id": [key[0]], "pins": [len(list(self.open.keys()))]})

    def close(self) -> None:
        pass


def pins(lease_events: DataFrame, ttl_s: int = 5, late: str = "10 seconds") -> DataFrame:
    """Changes of (block_id, pins) from (block_id, lease_id, op, at)."""
    x = lease_events.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return x.groupBy("block_id").transformWithStateInPandas(Pins(ttl_s * 1000), "block_id long, pins int", "Update", "EventTime")


def single_flights(requests: DataFrame, flight: str = "1 minute") -> DataFrame:
    """The first request of a key within the watermark; later ones share its fetch."""
    return requests.withWatermark("at", flight).dropDuplicatesWithinWatermark(["block_id"])
