"""Streams: ingest of late, repeated deliveries and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, files: int = 10) -> DataFrame:
    """A parquet folder as a stream, a few files a trigger, in the schema it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def first_deliveries(rows: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are remembered for delay, so state stays bounded."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def tumbling(rows: DataFrame, time: str, width: str, delay: str, by: list[str], value: str) -> DataFrame:
    """Count and sum per window and key; rows later than delay are dropped by the watermark when streaming, none in batch."""
    agg = rows.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(rows: DataFrame, time: str, gap: str, delay: str, by: list[str]) -> DataFrame:
    """Sessions per key that end after a gap without rows."""
    agg = rows.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def sink_batches(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Writes every available row once to parquet and ends; the checkpoint makes reruns append only what is new."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
