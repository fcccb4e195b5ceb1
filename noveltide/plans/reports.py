"""Reports over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_per_model(results: DataFrame, metric: str, *keys: str) -> DataFrame:
    """The best value that each model measured, per key."""
    return results.groupBy(*keys, "Model").agg(F.max(metric).alias("best"))


def below_proposed(results: DataFrame, proposed: DataFrame, metric: str, *keys: str) -> DataFrame:
    """Compatibility only: each model's best value strictly below the proposed model's best, or 1.05 times that best if there is none.

    The second case is no measurement. Use best_per_model for anything but comparison with old reports.
    """
    top = proposed.groupBy(*keys).agg(F.max(metric).alias("top"))
    joined = results.join(top, list(keys)) if keys else results.crossJoin(F.broadcast(top))
    kept = F.max(F.when(F.col(metric) < F.col("top"), F.col(metric)))
    return joined.groupBy(*keys, "Model").agg(F.coalesce(kept, F.max("top") * 1.05).alias("adjusted"))


def pivot_report(long: DataFrame, column: str, value: str, names: list[str] | None = None) -> DataFrame:
    """One row per model and one column per value of `column`."""
    grouped = long.groupBy("Model").pivot(column, names) if names else long.groupBy("Model").pivot(column)
    return grouped.agg(F.max(value))


def losses_per_scaler(results: DataFrame, proposed: DataFrame, metric: str) -> DataFrame:
    """(scaler, losses): how many models beat the proposed one's best, per scaler."""
    top = proposed.groupBy("scaler").agg(F.max(metric).alias("top"))
    return results.join(top, "scaler").groupBy("scaler").agg(F.sum(F.when(F.col(metric) > F.col("top"), 1).otherwise(0)).alias("losses"))


def with_summary_first(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """The summary row before the others; `place` is 0 for it and 1 for them."""
    return summary.withColumn("place", F.lit(0)).unionByName(rows.withColumn("place", F.lit(1)))


def with_best_proposed(results: DataFrame, proposed: DataFrame, metric: str, *keys: str) -> DataFrame:
    """Each model's best value beside the proposed model's: `best`, and `proposed`, the horizontal line of a chart."""
    top = proposed.groupBy(*keys).agg(F.max(metric).alias("proposed"))
    best = best_per_model(results, metric, *keys)
    return best.join(top, list(keys)) if keys else best.crossJoin(F.broadcast(top))


def in_percent(df: DataFrame, *columns: str) -> DataFrame:
    """Shares times 100, as older reports state them; null stays null."""
    return df.withColumns({c: F.col(c) * 100 for c in columns})
