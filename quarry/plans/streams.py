"""Registered queries that run streams to the end over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import scratch_path, table
from ..streaming import tables as S


def streaming_upsert(spark, sf_dir):
    """Latest event of each user, kept by a stream over the events."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    keyed = events.withColumn("version", F.struct("ts", "event_id")).select("user_id", "version", "event_type", "value")
    latest = S.VersionedTable(spark, scratch_path(spark, "latest"), "user_id", "version")
    S.keep_latest(keyed, latest, scratch_path(spark, "stream")).awaitTermination()
    return latest.read().select("user_id", F.col("version.event_id").alias("event_id"), "event_type", "value")


UPSERT = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def hourly_events(spark, sf_dir):
    return S.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").select("start", "event_type", "n")


HOURLY = "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL"

QUERIES = {"streaming_upsert": (streaming_upsert, UPSERT), "hourly_events": (hourly_events, HOURLY)}
