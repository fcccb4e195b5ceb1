"""Ranking and classification metrics by SQL windows over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noveltide.functions.scalar import safe_div
from noveltide.session import materialize


def roc_curve(df: DataFrame, score_col: str = "score", label_col: str = "label") -> DataFrame:
    """A row per distinct score, descending: tp and fp at it, cumulative ctp and cfp, and totals p and n.

    Rows are summed by score before any window. The running sums then take two
    levels, inside ranges of scores and over the ranges' totals, so no task sorts all scores.
    """
    y = F.col(label_col).cast("long")
    # Both are written: scores may have taken long to make, and approximate quantiles depend on the order in which parts arrive.
    by_score = materialize(df.groupBy(F.col(score_col).cast("double").alias("s")).agg(F.sum(y).alias("tp"), F.sum(1 - y).alias("fp")), "scores")
    cuts = materialize(by_score.agg(F.percentile_approx("s", F.array(*(F.lit(i / 64) for i in range(1, 64))), 2000).alias("c")), "cuts")
    ranged = by_score.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("c", lambda v: v < F.col("s")))).drop("c")
    totals = ranged.groupBy("part").agg(F.sum("tp").alias("ptp"), F.sum("fp").alias("pfp"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    totals = totals.select("part", F.coalesce(F.sum("ptp").over(above), F.lit(0)).alias("atp"), F.coalesce(F.sum("pfp").over(above), F.lit(0)).alias("afp"), F.sum("ptp").over(all_rows).alias("p"), F.sum("pfp").over(all_rows).alias("n"))
    w = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(totals), "part").select("s", "tp", "fp", (F.sum("tp").over(w) + F.col("atp")).alias("ctp"), (F.sum("fp").over(w) + F.col("afp")).alias("cfp"), "p", "n")


def ranking_metrics(df: DataFrame, score_col: str = "score", label_col: str = "label") -> DataFrame:
    """One row: auc_roc (ties count half), average_precision (step-wise), youden_j and its threshold (the highest of equals).

    Null where one class is missing. Where no threshold has J above 0 the threshold is infinite.
    """
    d = {k: F.col(k).cast("double") for k in ("tp", "fp", "ctp", "cfp", "p", "n")}
    rows = roc_curve(df, score_col, label_col).where("p > 0 and n > 0").withColumn("j", d["ctp"] / d["p"] - d["cfp"] / d["n"])
    out = rows.agg(
        F.sum(d["fp"] * (d["ctp"] - d["tp"] + d["tp"] / 2) / (d["p"] * d["n"])).alias("auc_roc"),
        F.sum(d["tp"] / d["p"] * (d["ctp"] / (d["ctp"] + d["cfp"]))).alias("average_precision"),
        F.max(F.struct("j", "s")).alias("best"),
    )
    best = F.col("best")
    return out.select("auc_roc", "average_precision", F.greatest(best["j"], F.lit(0.0)).alias("youden_j"), F.when(best["j"] > 0, best["s"]).otherwise(F.when(best.isNotNull(), float("inf"))).alias("youden_threshold"))


def confusion(df: DataFrame, predicted: Column, label: Column, *by: str) -> DataFrame:
    """tp, fp, tn, fn per group, in one pass."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return df.groupBy(*by).agg(count(predicted & (label == 1))("tp"), count(predicted & (label == 0))("fp"), count(~predicted & (label == 0))("tn"), count(~predicted & (label == 1))("fn"))


def classification_metrics(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and MCC from the cells; 0 where a denominator is."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return cells.withColumns({
        "accuracy": safe_div(tp + tn, tp + fp + tn + fn),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "mcc": safe_div(tp * tn - fp * fn, root),
    })


def threshold_sweep(df: DataFrame, steps: int = 1000, score_col: str = "score", label_col: str = "label") -> DataFrame:
    """Metrics at thresholds k / steps, k = 0..steps, for scores from 0 to 1 (predicted where score > threshold).

    Rows are counted per step first, so the sweep costs one pass and steps + 1 rows.
    """
    cell = F.least(F.greatest(F.ceil(F.col(score_col) * steps).cast("int"), F.lit(0)), F.lit(steps + 1))
    y = F.col(label_col).cast("long")
    counted = df.groupBy(cell.alias("k")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    grid = df.sparkSession.range(steps + 2).select(F.col("id").cast("int").alias("k"))
    full = grid.join(counted, "k", "left").fillna(0)
    above, everything = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    run = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    cells = full.select("k", run("pos").alias("tp"), run("neg").alias("fp"), (F.sum("neg").over(everything) - run("neg")).alias("tn"), (F.sum("pos").over(everything) - run("pos")).alias("fn"))
    return classification_metrics(cells.where(F.col("k") <= steps)).withColumn("threshold", F.col("k") / F.lit(float(steps))).drop("k")
