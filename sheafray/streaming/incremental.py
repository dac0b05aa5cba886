"""Incremental versions of additive reports, for results that arrive over time.

An extension: crossings of new shards, or events, arrive as files; counts and
sums by ray and time window are additive, so they can be kept by Structured
Streaming with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files below ``path`` as (ray_id, kind, raw, ts)."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    # A watermark needs a timestamp with a time zone.
    return rows.select(F.col("user_id").alias("ray_id"), F.col("event_type").alias("kind"), F.col("value").alias("raw"), F.col("ts").cast("timestamp").alias("ts"))


def windowed_summary(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts, sums and extremes by kind and time window; rows later than
    ``late`` are left out, and a window's state goes once it has passed."""
    w = F.window("ts", window)
    return (
        stream.withWatermark("ts", late)
        .groupBy(w.alias("w"), "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("sum_raw"), F.min("raw").alias("min_raw"), F.max("raw").alias("max_raw"))
        .select(F.col("w.start").alias("start"), "kind", "n", "sum_raw", "min_raw", "max_raw")
    )


def append_partials(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's partial sums by ray and kind below ``path``, one
    folder a batch, so that a repeated batch replaces itself; the total is a
    sum over the folders."""

    def write(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("ray_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("sum_raw"))
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
