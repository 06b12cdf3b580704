"""Tables kept up to date by streams: upserts, high-water marks, log cursors and windowed counts.

A table is a folder of numbered Parquet versions below the shared folder and a small pointer to the latest, so a batch
that runs twice after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.library import by_version


class VersionedTable:
    """The newest row of each key; version ``n`` holds what batches 0 to n brought."""

    def __init__(self, spark: SparkSession, path: str, key: str, version: str):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version

    def _latest(self, below: int | None = None) -> int | None:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return None
        done = [
            int(s.getPath().getName()[2:]) for s in fs.listStatus(root)
            if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        ]
        return max((v for v in done if below is None or v < below), default=None)

    def read(self) -> DataFrame | None:
        at = self._latest()
        return None if at is None else self.spark.read.parquet(f"{self.path}/v={at}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Write the version of a batch from the one before it; to be given to ``foreachBatch``."""
        before = self._latest(below=batch_id)
        rows = batch if before is None else batch.unionByName(self.spark.read.parquet(f"{self.path}/v={before}"))
        by_version(rows, self.key, self.version).write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")


def keep_latest(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Merge everything that is there into the table, batch by batch, and stop."""
    return stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(lines: DataFrame, after: int) -> DataFrame:
    """Rows (pos, text) after a cursor."""
    return lines.filter(F.col("pos") >= after).orderBy("pos")


def item_events(lines: Column) -> Column:
    """struct(state, name, detail) of an item line of a log, else null."""
    parts = F.split(F.regexp_replace(lines, r"^[\w-]+-item:\s*", ""), r"\s*\|\s*", 3)
    piece = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return F.when(lines.rlike(r"^[\w-]+-item:"), F.struct(piece(0).alias("state"), piece(1).alias("name"), piece(2).alias("detail")))


def windowed_counts(events: DataFrame, at: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and kind with a bound on lateness; for streams and tables alike."""
    kept = events.withWatermark(at, late) if events.isStreaming else events
    return kept.groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
