"""One-class scores: distances to normal rows, classes or centroids, as probabilities of being anomalous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide.functions.scalar import clamp_low, distance, logistic, nan_to, ratio, safe_div
from noveltide.operators.cluster import class_means
from noveltide.operators.distance import nearest, nearest_distance
from noveltide.operators.quantiles import column_quantiles
from noveltide.session import materialize

#: The most classes whose means are packed into one row and sent to all executors.
MOST_CLASSES = 10_000


def _packed(classes: DataFrame, *columns: str) -> DataFrame:
    """One row, `__c`: an array of the classes' columns; raises where there are too many to send."""
    few = classes.select(*columns).take(MOST_CLASSES + 1)
    if len(few) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes; score by `nearest_distance` to their means")
    local = classes.sparkSession.createDataFrame(few, classes.select(*columns).schema)
    return F.broadcast(local.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__c")))


def train_radius(train: DataFrame, how: str = "max") -> DataFrame:
    """One row, `r`: the largest distance of a train row to its nearest other (or the 95th percentile of them)."""
    near = nearest_distance(train, train, exclude_self=True)
    r = near.agg(F.max("dist").alias("r")) if how == "max" else column_quantiles(near, F.col("dist"), [0.95]).select(F.get("q", F.lit(0)).alias("r"))
    # Written, as a broadcast mustn't wait for the search: Spark gives it 300 s.
    return materialize(r, "radius")


def nn_ratio(test: DataFrame, train: DataFrame, floor: float | None = None, how: str = "max") -> DataFrame:
    """(row_id, nn, p_anomaly, p_normal): nearest train distance over the train radius, at most 1.

    0 / 0 makes both probabilities 1; `floor` keeps the radius above a value. The radius is one row, joined by broadcast.
    """
    r = train_radius(train, how)
    if floor is not None:
        r = r.select(clamp_low(F.col("r"), floor).alias("r"))
    near = nearest_distance(test, train).crossJoin(F.broadcast(r))
    p = F.least(ratio(F.col("dist"), F.col("r")), F.lit(1.0))
    p = F.when(F.isnan(ratio(F.col("dist"), F.col("r"))), float("nan")).otherwise(p)
    return near.select("row_id", F.col("dist").alias("nn"), nan_to(p).alias("p_anomaly"), nan_to(1.0 - p).alias("p_normal"))


def scaled_radius_sweep(test: DataFrame, train: DataFrame, low: int = -100, high: int = 99) -> DataFrame:
    """(i, row_id, p_anomaly) for radii r * (1 + i / 100); the distances are computed once."""
    r = train_radius(train)
    near = nearest_distance(test, train).crossJoin(F.broadcast(r)).withColumn("i", F.explode(F.sequence(F.lit(low), F.lit(high))))
    raw = ratio(F.col("dist"), F.col("r") * (1 + F.col("i") / 100.0))
    return near.select("i", "row_id", F.when(F.isnan(raw), 1.0).otherwise(F.least(raw, F.lit(1.0))).alias("p_anomaly"))


def min_distance(test: DataFrame, train: DataFrame) -> DataFrame:
    """(row_id, score): the raw distance to the nearest train row."""
    return nearest_distance(test, train).withColumnRenamed("dist", "score")


def class_radii(train: DataFrame, class_col: str) -> DataFrame:
    """(class, mean, radius): each class's mean and the distance of its farthest row."""
    means = class_means(train, class_col)
    own = train.select(F.col(class_col).alias("class"), F.col("features").cast("array<double>").alias("x"))
    far = own.join(means, "class").groupBy("class").agg(F.max(distance(F.col("x"), F.col("mean"))).alias("radius"))
    return means.join(far, "class").select("class", "mean", "radius")


def class_mean_radius(test: DataFrame, train: DataFrame, class_col: str, epsilon: float = 0.0) -> DataFrame:
    """(row_id, p_normal, p_anomaly): the best over classes of 1 - distance / radius, at least 0; a class without extent accepts its mean alone."""
    packed = _packed(class_radii(train, class_col), "class", "mean", "radius")
    share = lambda c: ratio(distance(F.col("features").cast("array<double>"), c["mean"]), c["radius"] + epsilon)
    each = F.transform("__c", lambda c: F.greatest(1.0 - nan_to(share(c), 0.0), F.lit(0.0)))
    out = test.crossJoin(packed).withColumn("p_normal", F.array_max(each))
    return out.select("row_id", "p_normal", (1.0 - F.col("p_normal")).alias("p_anomaly"))


def logistic_centroid(test: DataFrame, train: DataFrame, class_col: str) -> DataFrame:
    """(row_id, class, dist, p_near): a logistic of the nearest centroid's distance over half that centroid's distance to its next.

    p_near falls with distance (1 would be near). With one centroid the scale is infinite and p_near constant.
    """
    means = class_means(train, class_col).select("class", "mean")
    as_rows = means.select(F.col("class").cast("long").alias("row_id"), F.col("mean").alias("features"))
    gaps = nearest_distance(as_rows, as_rows, exclude_self=True).select(F.col("row_id").alias("o"), (F.col("dist") / 2).alias("half"))
    half = means.join(gaps, F.col("class") == F.col("o"), "left")
    packed = _packed(half, "class", "mean", "half")
    each = F.transform("__c", lambda c: F.struct(distance(F.col("features").cast("array<double>"), c["mean"]).alias("d"), c["class"].alias("class"), c["half"].alias("half")))
    best = test.crossJoin(packed).select("row_id", F.array_min(each).alias("b"))
    scaled = F.when(F.col("b.half").isNull(), 0.0).otherwise(ratio(F.col("b.d"), F.coalesce("b.half", F.lit(1.0))))
    return best.select("row_id", F.col("b.class").alias("class"), F.col("b.d").alias("dist"), logistic(-(F.least(scaled, F.lit(700.0)) - 1.0)).alias("p_near"))


def _votes(test: DataFrame, train: DataFrame, label_col: str, ks: list[int], exclude_self: bool) -> DataFrame:
    found = nearest(test, train, max(ks), exclude_self).select("row_id", F.posexplode("neighbors").alias("pos", "nb"))
    labels = train.select(F.col("row_id").alias("nid"), F.col(label_col).cast("double").alias("y"))
    voted = found.select("row_id", "pos", F.col("nb.id").alias("nid")).join(labels, "nid")
    grid = voted.withColumn("k", F.explode(F.array(*map(F.lit, sorted(ks))))).where("pos < k")
    return grid.groupBy("row_id", "k").agg(F.avg("y").alias("p_anomaly"))


def knn_vote(test: DataFrame, train: DataFrame, label_col: str, ks: list[int], exclude_self: bool = False) -> DataFrame:
    """(row_id, k, predicted, p_anomaly) for each k: the share of label 1 among the k nearest; a majority predicts 1."""
    return _votes(test, train, label_col, ks, exclude_self).withColumn("predicted", (F.col("p_anomaly") > 0.5).cast("int"))


def knn_grid_search(train: DataFrame, label_col: str, ks: list[int], fold: Column, folds: int = 5) -> DataFrame:
    """(k, mean_f1): the mean over folds of a nearest-neighbour classifier's F1, each fold predicted by the others.

    `fold` numbers the rows' folds from 0. A fold without any true or predicted label 1 has an F1 of 0.
    """
    rows = train.select("row_id", "features", F.col(label_col).cast("int").alias("y"), fold.cast("int").alias("fold"))
    scored = None
    for f in range(folds):
        own = rows.where(F.col("fold") == f)
        voted = knn_vote(own, rows.where(F.col("fold") != f), "y", ks).join(own.select("row_id", "y"), "row_id")
        one = lambda c: F.sum(F.when(c, 1).otherwise(0))
        p, y = F.col("predicted") == 1, F.col("y") == 1
        cells = voted.groupBy("k").agg(one(p & y).alias("tp"), one(p & ~y).alias("fp"), one(~p & y).alias("fn"))
        cells = cells.select("k", safe_div(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")).alias("f1"))
        scored = cells if scored is None else scored.unionByName(cells)
    return scored.groupBy("k").agg((F.sum("f1") / folds).alias("mean_f1"))


def best_k(grid: DataFrame) -> int:
    """The k of the highest mean F1, the smallest on a tie."""
    return grid.orderBy(F.desc("mean_f1"), "k").first().k


def predict(p: Column, rule: str = "gt", threshold: float = 0.5) -> Column:
    """1 where the score is above (gt) or not below (ge) a threshold."""
    return (p > threshold if rule == "gt" else p >= threshold).cast("int")


def predict_above_median(df: DataFrame, score_col: str = "score") -> DataFrame:
    """Add `predicted`: the score is above the table's median."""
    median = column_quantiles(df, F.col(score_col), [0.5]).select(F.get("q", F.lit(0)).alias("__m"))
    out = df.join(F.broadcast(median), F.lit(True), "left")
    return out.withColumn("predicted", (F.col(score_col) > F.col("__m")).cast("int")).drop("__m")


def min_max_probability(df: DataFrame, score_col: str = "score") -> DataFrame:
    """Add `p_anomaly`: (score - min) / (max - min + 1e-10) over the table."""
    span = df.agg(F.min(score_col).alias("__lo"), F.max(score_col).alias("__hi"))
    out = df.crossJoin(F.broadcast(span))
    return out.withColumn("p_anomaly", (F.col(score_col) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-10)).drop("__lo", "__hi")
