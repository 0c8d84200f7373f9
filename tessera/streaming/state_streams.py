"""Keyed state over streams: ring buffers, latest pointers, caches whose entries expire, and counts per event-time window with a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

RING = "user_id long, event_id long, ts timestamp"
LOOKUPS = "user_id long, event_id long, hit boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    d = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def ring(stream: DataFrame, size: int = 5) -> DataFrame:
    """After each batch, the last ``size`` events of every user that the batch has."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"event_id": state.get[0], "ts": pd.to_datetime(list(state.get[1]))}) if state.exists else None
        new = pd.concat([x for x in (held, *(p[["event_id", "ts"]] for p in parts)) if x is not None])
        new = new.sort_values(["ts", "event_id"], ascending=False).head(size)
        state.update((new["event_id"].tolist(), [str(x) for x in new["ts"]]))
        yield new.assign(user_id=key[0])[["user_id", "event_id", "ts"]]

    return stream.groupBy("user_id").applyInPandasWithState(update, RING, "event_id array<bigint>, ts array<string>", "update", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame) -> DataFrame:
    """After each batch, the last event of every user and type that the batch has."""
    return stream.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


class ExpiringEntries(StatefulProcessor):
    """One entry a user: when it was written.  An event finds it if it isn't older than the lifetime, and replaces it.

    By event time, a timer drops the entry as soon as the watermark says that no event to come can find it, so what is held is bounded by the users
    of one lifetime and of what may be late, and the results don't depend on how rows fall into batches.  By processing time the state's own lifetime hides it.
    """

    def __init__(self, lifetime_ms: int, by_event_time: bool):
        self.lifetime_ms, self.by_event_time = lifetime_ms, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "written_us long", None if self.by_event_time else self.lifetime_ms)

    def _timer(self, written_us: int) -> int:
        """The first whole millisecond at which the entry is too old."""
        return written_us // 1000 + self.lifetime_ms + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        written = new["ts"].astype("datetime64[us]").astype("int64")
        held = self.entry.get()[0] if self.entry.exists() else None
        before = written.shift(1)
        if held is not None:
            before.iloc[0] = held
        hit = before.notna() if not self.by_event_time else (written - before) <= self.lifetime_ms * 1000
        last = int(written.iloc[-1])
        if held is None or last > held or not self.by_event_time:
            if self.by_event_time:
                if held is not None:
                    self.handle.deleteTimer(self._timer(held))
                self.handle.registerTimer(self._timer(last))
            self.entry.update((last,))
        yield pd.DataFrame({"user_id": key[0], "event_id": new["event_id"].to_numpy(), "hit": hit.to_numpy(dtype=bool)})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def lookups(stream: DataFrame, lifetime_ms: int, late: str | None = "1 hour") -> DataFrame:
    """For every event whether its user has an entry not older than the lifetime; every event writes it anew.

    With ``late``, ages are differences of event times, and events later than that are left out; with None, ages go by the clock.
    Needs the RocksDB state store: run it within ``rocks_db``, by the clock in single batches (``drained``).
    """
    by_event_time = late is not None
    d = stream.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_id", "ts")
    d = d.withWatermark("ts", late) if by_event_time else d
    return d.groupBy("user_id").transformWithStateInPandas(ExpiringEntries(lifetime_ms, by_event_time), LOOKUPS, "append", "eventTime" if by_event_time else "processingTime")


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def window_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by type and tumbling window; events later than the watermark allows are left out."""
    by = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drained(stream: DataFrame, mode: str, keys: list[str], folder: str, single: bool = False) -> DataFrame:
    """Runs a stream over what is there now into Parquet under a folder, and reads the last batch's row of each key.

    State that expires by the clock asks for one more batch for ever; ``single`` takes all there is in one batch and stops.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(**({"once": True} if single else {"availableNow": True})).foreachBatch(keep).start()
    query.awaitTermination()
    d = spark.read.parquet(f"{folder}/out").drop("number")
    last = d.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return d.join(last, [*keys, "batch"]).drop("batch")
