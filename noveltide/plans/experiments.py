"""Whole experiments: from a labelled table of vectors to rows of metrics and times."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide import session
from noveltide.operators import cluster, metrics, nullspace, prep, score
from noveltide.operators.detectors import DETECTORS
from noveltide.sources import results as results_csv
from noveltide.sources import tables

# Scalers of the experiments, percentages of anomalies among the training rows, modes of outliers, numbers of neighbours, numbers of clusters.
SCALERS = ("minmax", "normalizer", "quantile", "robust", "standard")
NOISE = (0, 1, 3, 5)
OUTLIER_MODES = ("cluster", "local", "global")
NEIGHBORS = (1, 3, 5, 7, 9, 11)
CLUSTER_COUNTS = range(1, 311, 3)

#: Scores of single tables (`plans/queries.py`) that would need more clusters than this for a null direction take the regularised ones, and name the kind. Experiments have no such bound.
MOST_CLUSTERS = 500

METRICS = "AUCROC double, AUCPR double, Accuracy double, MCC double, `F1 Score` double, Precision double, Recall double, `Time Train` double, `Time Test` double"


def _row(scored: DataFrame, predicted: str | None = None) -> tuple[float | None, ...]:
    """The seven metrics of rows (score, label): ranks by score; classes by `predicted`, or by the threshold of the highest Youden index."""
    ranks = metrics.ranking_metrics(scored).first()
    if predicted is None:
        threshold = ranks.youden_threshold if ranks.youden_threshold is not None else float("inf")
        positive = F.col("score") >= F.lit(threshold)
    else:
        positive = F.col(predicted) == 1
    c = metrics.classification_metrics(metrics.confusion(scored, positive, F.col("label"))).first()
    return ranks.auc_roc, ranks.average_precision, c.accuracy, c.mcc, c.f1, c.precision, c.recall


def _split(v: DataFrame, scaler: str, noise: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): three tenths by hash test; scaled by what the others hold; training rows are the normal ones and `noise` percent of others."""
    v = prep.hash_split(v, "row_id")
    v = prep.scale_vectors(v, scaler, ~F.col("is_test"))
    train = prep.contaminate(v.where("not is_test"), "row_id", "label", noise)
    return train.select("row_id", "features", F.col("train_label").alias("label")), v.where("is_test").select("row_id", "features", "label")


def _clusters(train: DataFrame, clusters: int | None) -> int:
    """The given number, or as many as a null direction takes, ten at least."""
    if clusters is not None:
        return clusters
    n, d = train.agg(F.count("*"), F.max(F.size("features"))).first()
    return max(10, nullspace.least_clusters(n, d))


def _nullspace_cell(train: DataFrame, test: DataFrame, clusters: int | None, seeds: int) -> tuple:
    """(clusters, metrics and times, kind of directions) of given rows."""
    train, test = train.cache(), test.cache()
    try:
        train.count(), test.count()
        start = time.time()
        clusters = _clusters(train, clusters)
        # Written, so that labels are found once.
        labelled = session.materialize(cluster.with_clusters(train, cluster.kmeans_centers(train, [clusters], seeds)[clusters]), "labels")
        p = nullspace.directions(nullspace.scatter(labelled))
        fitted = time.time()
        scores = score.nn_ratio(nullspace.project(test, p.w), nullspace.project(train, p.w))
        scored = scores.select("row_id", F.col("p_anomaly").alias("score")).join(test.select("row_id", "label"), "row_id").cache()
        scored.count()
        ended = time.time()
        row = _row(scored)
        scored.unpersist()
        return clusters, *row, fitted - start, ended - fitted, p.kind
    finally:
        train.unpersist()
        test.unpersist()


def nullspace_experiment(v: DataFrame, scaler: str, noise: int, clusters: int | None = None, seeds: int = 10, name_directions: bool = False) -> tuple:
    """One cell: pseudo-labels by K-means, projecting directions, nearest-neighbour ratio, and its metrics and times.

    Without `clusters` there are as many as a null direction takes; with `name_directions` the last value tells which kind the directions are.
    """
    clusters, *row, kind = _nullspace_cell(*_split(v, scaler, noise), clusters, seeds)
    return scaler, clusters, noise, *row, *([kind] if name_directions else [])


def knn_experiment(v: DataFrame, scaler: str, noise: int, clusters: int = 2, folds: int = 5, seeds: int = 10) -> tuple:
    """One cell: K-means pseudo-labels, a nearest-neighbour classifier tuned on them by cross-validated F1, compared with the true labels.

    The smallest cluster is taken for the anomalies (of several, the one of the least row id), so results don't depend on how K-means numbers its clusters.
    "Time Train" is the clustering's, "Time Test" that of tuning and prediction.
    """
    train, test = _split(v, scaler, noise)
    train, test = train.cache(), test.cache()
    train.count(), test.count()
    start = time.time()
    labelled = cluster.kmeans(train, clusters, seeds=seeds)
    few = labelled.groupBy("cluster").agg(F.count("*").alias("n"), F.min("row_id").alias("first")).orderBy("n", "first").first()
    labelled = labelled.withColumn("y", (F.col("cluster") == (few.cluster if few else 0)).cast("int")).cache()
    try:
        labelled.count()
        fitted = time.time()
        fold = F.pmod(F.xxhash64("row_id"), F.lit(folds))
        k = score.best_k(score.knn_grid_search(labelled, "y", list(NEIGHBORS), fold, folds))
        voted = score.knn_vote(test, labelled, "y", [k])
        scored = voted.select("row_id", F.col("p_anomaly").alias("score"), "predicted").join(test.select("row_id", "label"), "row_id")
        row = _row(scored, "predicted")
        return scaler, clusters, noise, *row, fitted - start, time.time() - fitted
    finally:
        for df in (labelled, train, test):
            df.unpersist()


def _detector_cell(train: DataFrame, test: DataFrame, name: str, options: dict[str, object]) -> tuple:
    """Metrics and times of given rows."""
    train, test = train.cache(), test.cache()
    try:
        train.count(), test.count()
        start = time.time()
        scores = DETECTORS[name](test, train, **options).select("row_id", "score")
        fitted = time.time()
        scored = score.predict_above_median(scores.join(test.select("row_id", "label"), "row_id")).cache()
        scored.count()
        ended = time.time()
        row = _row(scored, "predicted")
        scored.unpersist()
        return *row, fitted - start, ended - fitted
    finally:
        train.unpersist()
        test.unpersist()


def detector_experiment(v: DataFrame, name: str, scaler: str, noise: int, **options: object) -> tuple:
    """One cell of the comparison: a detector by name, classes by the median of the test scores. Times hold neither scaling nor splitting."""
    return name, scaler, noise, *_detector_cell(*_split(v, scaler, noise), name, options)


def _given(v: DataFrame, mode: str, scaler: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a table by outlier_mode, scaler and split, whose rows are scaled and split as they are."""
    rows = v.where((F.col("outlier_mode") == mode) & (F.col("scaler") == scaler))
    return tuple(rows.where(F.col("split") == part).select("row_id", "features", "label") for part in ("train", "test"))


def outlier_experiment(v: DataFrame, mode: str, scaler: str, clusters: int | None = None, seeds: int = 10) -> tuple:
    """One cell of the study by outlier mode: as `nullspace_experiment`, on the train and test rows that the table has for mode and scaler."""
    return mode, scaler, *_nullspace_cell(*_given(v, mode, scaler), clusters, seeds)[:-1]


def outlier_detector_experiment(v: DataFrame, name: str, mode: str, scaler: str, **options: object) -> tuple:
    """One cell of the comparison by outlier mode: as `detector_experiment`, on the train and test rows that the table has for mode and scaler."""
    return name, mode, scaler, *_detector_cell(*_given(v, mode, scaler), name, options)


Cell = tuple[Callable[..., tuple], tuple]


def _plain(row: tuple) -> tuple:
    return tuple(x if x is None or isinstance(x, (str, int)) else float(x) for x in row)


def results(v: DataFrame, cells: Iterable[Cell], keys: str, more: str = "", workers: int = 4) -> DataFrame:
    """A table of results: a row per cell, in the order given; `workers` cells run at a time. A cell is a function of this module and its arguments after the table."""
    v = v.cache()
    try:
        with ThreadPoolExecutor(workers) as pool:
            rows = list(pool.map(lambda c: _plain(c[0](v, *c[1])), cells))
    finally:
        v.unpersist()
    return v.sparkSession.createDataFrame(rows, f"{keys}, {METRICS}{more}")


def study(v: DataFrame, cells: Iterable[Cell], path: str, keys: str, more: str = "", workers: int = 4) -> tuple[DataFrame, list[tuple[tuple, str]]]:
    """Run the cells that the CSV table at `path` doesn't hold yet: (all results so far, [(a failed cell's arguments, its error)]).

    Each cell's row is appended as soon as it is there, so a study that was stopped goes on where it was; a
    cell that fails is reported, and the others go on. The table's key columns, in the order of `keys`, are the first of a
    cell's arguments; a cell is known by as many of its arguments as there are key columns.
    """
    spark, schema = v.sparkSession, f"{keys}, {METRICS}{more}"
    names = [k.split()[0] for k in keys.split(",")]
    known = set()
    if tables.path_exists(spark, path):
        known = {tuple(r) for r in results_csv.read_results(spark, path, schema).select(*names).collect()}  # a row a cell
    v, failed, lock = v.cache(), [], Lock()

    def run(cell: Cell) -> None:
        f, args = cell
        try:
            row = _plain(f(v, *args))
            with lock:
                results_csv.append_csv(spark.createDataFrame([row], schema).coalesce(1), path)
        except Exception as e:  # the other cells go on
            failed.append((args, f"{type(e).__name__}: {e}"))

    try:
        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(run, [c for c in cells if tuple(c[1][: len(names)]) not in known]))
    finally:
        v.unpersist()
    done = results_csv.read_results(spark, path, schema) if tables.path_exists(spark, path) else spark.createDataFrame([], schema)
    return done, failed


def auc_by_clusters(v: DataFrame, counts: Iterable[int], scaler: str = "minmax", seeds: int = 10) -> DataFrame:
    """(clusters, null_size, rank_within, auc_roc) for each number of clusters; from as many as there are training rows on, each row is its own."""
    train, test = _split(v, scaler, 0)
    train, test = train.cache(), test.cache()
    rows = []
    try:
        n = train.count()
        counts = list(counts)
        different = sorted({min(k, n) for k in counts})
        centers = cluster.kmeans_centers(train, different, seeds)

        def one(k: int) -> tuple:
            p = nullspace.directions(nullspace.scatter(session.materialize(cluster.with_clusters(train, centers[k]), "labels")))
            scores = score.nn_ratio(nullspace.project(test, p.w), nullspace.project(train, p.w)) if p.w.shape[1] else test.select("row_id", F.lit(1.0).alias("p_anomaly"))
            scored = scores.select("row_id", F.col("p_anomaly").alias("score")).join(test.select("row_id", "label"), "row_id")
            return p.null_size, p.rank_within, metrics.ranking_metrics(scored).first().auc_roc

        with ThreadPoolExecutor(4) as pool:
            found = dict(zip(different, pool.map(one, different), strict=True))
        rows = [(int(k), *found[min(k, n)]) for k in counts]
    finally:
        train.unpersist()
        test.unpersist()
    return v.sparkSession.createDataFrame(rows, "clusters int, null_size int, rank_within int, auc_roc double")
