"""Streams over append-only logs: last write wins per key, and windowed counts.

The windowed counts are an extension beyond the batch features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quire.operators.incremental import latest


def follow(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON lines of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def compact(stream: DataFrame, target: str, checkpoint: str, key: str, seq: str) -> StreamingQuery:
    """Keep at target a table with the last row of each key, one version folder per batch.

    Each batch merges with the version before it; a batch that is run again
    writes the same version again, so a restart neither loses nor doubles rows.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/version={epoch - 1}").unionByName(batch)
        latest(rows, key, seq).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/version={epoch}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and kind, rows later than the watermark dropped by the stream."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), kind)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), kind, "n")
    )
