"""Scoring of event streams against fitted models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, reference: DataFrame, value_col: str = "value", key_col: str = "event_type") -> DataFrame:
    """Add `score`: standard deviations from the key's mean in the (static, small) reference table (key, mean, std)."""
    joined = stream.join(reference, key_col, "left")
    spread = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    return joined.withColumn("score", F.abs(F.col(value_col) - F.col("mean")) / spread).drop("mean", "std")


def windowed_alerts(scored: DataFrame, threshold: float = 3.0, ts_col: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events above the threshold per key and tumbling window; rows later than `late` are dropped with their window's state."""
    return scored.withWatermark(ts_col, late).groupBy(F.window(ts_col, width), "event_type").agg(F.count("*").alias("events"), F.sum((F.col("score") > threshold).cast("int")).alias("alerts"))


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to a Parquet table with exactly-once files; ends when the input at start is read."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_foreach(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Give each batch to a function of (table, batch number), which must be able to take a batch twice; ends when the input at start is read."""
    return df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
