"""Keyed state in batch: ring buffers, latest pointers, caches with a lifetime."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring(history: DataFrame, key: str, at: str, tie: str, size: int) -> DataFrame:
    """The last ``size`` rows of each key, the newest first."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return history.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size)


def latest(pointers: DataFrame, keys: list[str], at: str, tie: str, value: str) -> DataFrame:
    return pointers.groupBy(*keys).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def valid(entries: DataFrame, as_of: str, hours: int, version: int) -> DataFrame:
    """Entries of the version that aren't older than ``hours``; a lifetime of 0 or an unknown time never ends."""
    alive = F.lit(hours <= 0) | F.col("parsed_at").isNull() | (F.col("parsed_at") >= F.expr(f"CAST('{as_of}' AS TIMESTAMP_NTZ) - INTERVAL {hours} HOURS"))
    return entries.where(alive & (F.col("version") == version))


def dangling(index: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return index.join(stored, key, "left_anti")
