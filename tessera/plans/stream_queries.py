"""Queries over streams, drained into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.plans.common import scratch, table
from tessera.sources import collections, ingest
from tessera.streaming import state_streams as s


@query("stream_ring_buffer", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5")
def stream_ring_buffer(spark, sf_dir):
    return s.drained(s.ring(s.events(spark, sf_dir)), "update", ["user_id"], scratch(spark, "ring")).select("user_id", "event_id")


@query("stream_window_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    d = s.drained(s.window_counts(s.events(spark, sf_dir)), "update", ["start", "event_type"], scratch(spark, "windows"))
    return d.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("stream_latest", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def stream_latest(spark, sf_dir):
    return s.drained(s.latest(s.events(spark, sf_dir)), "update", ["user_id", "event_type"], scratch(spark, "latest"))


@query(
    "stream_ttl",
    "SELECT user_id, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 24 HOURS, false) AS hit FROM events",
)
def stream_ttl(spark, sf_dir):
    with s.rocks_db(spark):
        return s.drained(s.lookups(s.events(spark, sf_dir), 24 * 3600 * 1000), "append", ["event_id"], scratch(spark, "ttl"))


@query(
    "stream_ingest",
    """WITH f AS (SELECT DISTINCT string_agg(coalesce(text, ''), chr(10) ORDER BY conv_id, turn) || chr(10) AS text FROM conversations GROUP BY conv_id // 16)
SELECT left(sha256(text), 12) AS file_id, count(*) AS n_chunks FROM (SELECT text, unnest(generate_series(0, length(text) - 1, 1000)) AS start FROM f) WHERE regexp_matches(substr(text, start + 1, 1200), '\\S') GROUP BY text""",
)
def stream_ingest(spark, sf_dir):
    """Sixteen conversations after another become a text file; all files are taken in, twice, and chunks counted by file."""
    said = F.array_sort(F.collect_list(F.struct("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))))["text"]
    folder = scratch(spark, "ingest")
    table(spark, sf_dir, "conversations").groupBy(F.expr("conv_id DIV 16").alias("box")).agg(F.array_join(said, "\n").alias("text")).write.partitionBy("box").text(f"{folder}/in")
    for work in ("first", "second"):
        ingest.ingest(spark, f"{folder}/in", f"{folder}/store", "talks", f"{folder}/{work}")
    return collections.read(spark, f"{folder}/store", "talks").groupBy(F.col("file_id").cast("string").alias("file_id")).agg(F.count("*").alias("n_chunks"))
