"""Clustering of feature vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide import session
from noveltide.operators.distance import nearest
from noveltide.operators.pivots import matrix

#: Runs of K-means at a time; each is a series of small Spark jobs.
PARALLEL = 4
#: Numbers of the centers of runs that share a pass (16 MB of doubles), and of a block of distances.
RUN_VALUES, BLOCK_VALUES = 2_000_000, 1_000_000
#: Steps of a run at most, and the move of a center that ends it earlier, as Spark's K-means has them.
MOST_STEPS, LEAST_MOVE = 20, 1e-4


def kmeans(df: DataFrame, k: int, seeds: int = 10, seed: int = 42, features_col: str = "features") -> DataFrame:
    """Add `cluster`: the run of the lowest cost among `seeds` runs, several of which go on at a time. k is no more than the number of distinct points."""
    vectors = df.withColumn("__v", array_to_vector(F.col(features_col).cast("array<double>"))).cache()
    try:
        k = max(1, min(k, df.select(F.xxhash64(features_col).alias("h")).distinct().limit(k).count()))
        if k == 1:
            return df.withColumn("cluster", F.lit(0))
        fit = lambda i: KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="cluster").fit(vectors)
        with ThreadPoolExecutor(min(seeds, PARALLEL)) as pool:
            models = list(pool.map(fit, range(seeds)))
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        vectors.unpersist()
    return best.transform(df.withColumn("__v", array_to_vector(F.col(features_col).cast("array<double>")))).drop("__v")


def _to_nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row and its squared distance, which is taken from differences, so that a row on its center is at 0."""
    at, step, norm = np.zeros(len(x), "i8"), max(1, BLOCK_VALUES // len(centers)), (centers * centers).sum(1)
    for a in range(0, len(x), step):
        at[a : a + step] = (norm - 2 * (x[a : a + step] @ centers.T)).argmin(1)
    return at, ((x - centers[at]) ** 2).sum(1)


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers above 0 and up to 1 that depend on hash and seed alone (splitmix64)."""
    z = h.view("u8") + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(times)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype("f8") / (1 << 53) + 2.0**-54


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


_PICKS = "run int, key double, h long, x array<double>"
_STEPS = "run int, k int, n double, x array<double>"


def _picks(points: DataFrame, runs: list[tuple[np.ndarray | None, int, int | None]]) -> list[np.ndarray]:
    """For each run (centers or None, number, seed): so many points, drawn with chances in proportion to weight and squared distance from the centers.

    Without a seed they are the farthest. Fewer come where fewer are off the centers.
    """
    sent = points.sparkSession.sparkContext.broadcast(runs)

    def best(run: int, key: np.ndarray, h: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        first = np.lexsort((h, -key))[: sent.value[run][1]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), run), pa.int32()), pa.array(key[first]), pa.array(h[first]), _vectors(x[first])], ["run", "key", "h", "x"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, n, h = matrix(b.column("x")), b.column("n").to_numpy(), b.column("h").to_numpy()
            for run, (centers, _, seed) in enumerate(sent.value):
                far = np.ones(len(x)) if centers is None else _to_nearest(x, centers)[1]
                with np.errstate(divide="ignore"):
                    key = np.log(far) if seed is None else np.log(far * n) - np.log(-np.log(_uniform(h, seed)))
                off = far > 0
                if off.any():
                    yield best(run, key[off], h[off], x[off])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            of = b.column("run").to_numpy()
            for run in np.unique(of).tolist():
                own = of == run
                held.setdefault(run, []).append((b.column("key").to_numpy()[own], b.column("h").to_numpy()[own], matrix(b.column("x"))[own]))
        for run, parts in held.items():
            yield best(run, *(np.concatenate(c) for c in zip(*parts, strict=True)))

    found = points.mapInArrow(draw, _PICKS).repartition(len(runs), "run").mapInArrow(merge, _PICKS).toArrow()
    sent.unpersist()
    of, key, h = (found[c].to_numpy() for c in ("run", "key", "h"))
    x = matrix(found["x"].combine_chunks()) if len(of) else np.zeros((0, 0))
    out = []
    for run in range(len(runs)):
        own = np.flatnonzero(of == run)
        out.append(x[own[np.lexsort((h[own], -key[own]))]])
    return out


def _step(points: DataFrame, runs: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each run's centers: the cost, and each cluster's weight and sum. Summed per task, then per cluster; the driver gets a row a cluster."""
    sent = points.sparkSession.sparkContext.broadcast(runs)

    def rows(run: int, k: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), run), pa.int32()), pa.array(k, pa.int32()), pa.array(n, pa.float64()), _vectors(x)], ["run", "k", "n", "x"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, n = matrix(b.column("x")), b.column("n").to_numpy().astype("f8")
            weighted = x * n[:, None]
            for run, centers in enumerate(sent.value):
                at, far = _to_nearest(x, centers)
                order = np.argsort(at, kind="stable")
                k, first = np.unique(at[order], return_index=True)
                yield rows(run, np.r_[-1, k], np.r_[far @ n, np.add.reduceat(n[order], first)], np.vstack([np.zeros((1, x.shape[1])), np.add.reduceat(weighted[order], first)]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("run").to_numpy(), b.column("k").to_numpy(), b.column("n").to_numpy(), matrix(b.column("x"))) for b in batches if b.num_rows]
        if parts:
            run, k, n, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((k, run))
            first = np.flatnonzero(np.r_[True, (np.diff(run[order]) != 0) | (np.diff(k[order]) != 0)])
            yield pa.RecordBatch.from_arrays([pa.array(run[order][first]), pa.array(k[order][first]), pa.array(np.add.reduceat(n[order], first)), _vectors(np.add.reduceat(x[order], first))], ["run", "k", "n", "x"])

    parts = points.sparkSession.sparkContext.defaultParallelism
    found = points.mapInArrow(partial, _STEPS).repartition(parts, "run", "k").mapInArrow(add, _STEPS).toArrow()
    sent.unpersist()
    of, k, n, x = found["run"].to_numpy(), found["k"].to_numpy(), found["n"].to_numpy(), matrix(found["x"].combine_chunks())
    out = []
    for run, centers in enumerate(runs):
        own = of == run
        kept = own & (k >= 0)
        weight, total = np.zeros(len(centers)), np.zeros(centers.shape)
        weight[k[kept]], total[k[kept]] = n[kept], x[kept]
        out.append((float(n[own & (k < 0)][0]), weight, total))
    return out


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Places in order, as many at a time as `RUN_VALUES` numbers are, one at least."""
    held, total = [], 0
    for i, size in enumerate(sizes):
        if held and total + size > RUN_VALUES:
            yield held
            held, total = [], 0
        held.append(i)
        total += size
    if held:
        yield held


def _first_centers(points: DataFrame, k: int, seeds: list[int]) -> list[np.ndarray]:
    """k different points for each seed, in the order in which they were drawn: a third as many as there are at a time, each by its distance from those before."""
    held: list[np.ndarray | None] = [None] * len(seeds)
    while (have := 0 if held[0] is None else len(held[0])) < k:
        for i, new in enumerate(_picks(points, [(c, min(k - have, max(1, have // 3)), s) for c, s in zip(held, seeds, strict=True)])):
            held[i] = new if held[i] is None else np.vstack([held[i], new])
    return held


def _lloyd(points: DataFrame, runs: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """(cost, centers) of each run. No cluster stays empty: its center moves to the farthest point."""
    runs, costs, going, steps = list(runs), [np.inf] * len(runs), list(range(len(runs))), 0
    while going:
        left, empty = [], {}
        for i, (cost, weight, total) in zip(going, _step(points, [runs[i] for i in going]), strict=True):
            new = np.where(weight[:, None] > 0, total / np.maximum(weight, 1)[:, None], runs[i])
            none = np.flatnonzero(weight == 0)
            costs[i] = cost
            if len(none) or (steps < MOST_STEPS and (((new - runs[i]) ** 2).sum(1) > LEAST_MOVE**2).any()):
                runs[i] = new
                left.append(i)
                if len(none):
                    empty[i] = none
        if empty:
            for (i, none), far in zip(empty.items(), _picks(points, [(np.delete(runs[i], none, 0), len(none), None) for i, none in empty.items()]), strict=True):
                runs[i][none[: len(far)]] = far
        going, steps = left, steps + 1
    return list(zip(costs, runs, strict=True))


def kmeans_centers(df: DataFrame, counts: Iterable[int], seeds: int = 10, seed: int = 42, features_col: str = "features") -> dict[int, np.ndarray]:
    """{k: centers} for each number of clusters: the run of the lowest cost among `seeds` runs.

    Runs share passes over the rows, as many as `RUN_VALUES` allows, and equal rows count once, with a weight. k is no more than the number of distinct points.
    """
    session.ship(df.sparkSession)
    points = df.groupBy(F.col(features_col).cast("array<double>").alias("x")).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("x"))
    points = points.repartition(df.sparkSession.sparkContext.defaultParallelism, "h").cache()
    try:
        most, d = points.agg(F.count("*"), F.max(F.size("x"))).first()
        asked = {int(k): max(1, min(int(k), most)) for k in counts}
        ks = sorted(set(asked.values()))
        all_seeds = [seed + i for i in range(seeds)]
        first = []
        for group in _groups([ks[-1] * d] * seeds):
            first += _first_centers(points, ks[-1], [all_seeds[i] for i in group])
        runs = [(k, c[:k]) for k in ks for c in first]
        groups = list(_groups([c.size for _, c in runs]))
        with ThreadPoolExecutor(PARALLEL) as pool:
            done = list(pool.map(lambda g: _lloyd(points, [runs[i][1] for i in g]), groups))
        best: dict[int, tuple[float, np.ndarray]] = {}
        for group, found in zip(groups, done, strict=True):
            for i, (cost, centers) in zip(group, found, strict=True):
                k = runs[i][0]
                if k not in best or cost < best[k][0]:
                    best[k] = cost, centers
    finally:
        points.unpersist()
    return {k: best[own][1] for k, own in asked.items()}


def with_clusters(df: DataFrame, centers: np.ndarray, features_col: str = "features") -> DataFrame:
    """Add `cluster`: the nearest of the centers."""
    session.ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(centers)
    names = [c for c in df.columns if c != "cluster"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _to_nearest(matrix(b.column("__x")), sent.value)[0] if b.num_rows else np.zeros(0, "i8")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(at, pa.int32())], [*names, "cluster"])

    rows = df.select(*names, F.col(features_col).cast("array<double>").alias("__x"))
    schema = rows.drop("__x").withColumn("cluster", F.lit(0)).schema
    return rows.mapInArrow(run, schema)


def gaussian_mixture(df: DataFrame, k: int, seed: int = 42, features_col: str = "features") -> DataFrame:
    """Add `cluster`, the likeliest component of a full-covariance mixture."""
    vectors = df.withColumn("__v", array_to_vector(F.col(features_col).cast("array<double>")))
    model = GaussianMixture(k=k, seed=seed, featuresCol="__v", predictionCol="cluster", probabilityCol="__p").fit(vectors)
    return model.transform(vectors).drop("__v", "__p")


def class_means(df: DataFrame, class_col: str, features_col: str = "features") -> DataFrame:
    """(class, mean array<double>, n): sums per class and position, taken per task before the shuffle."""
    long = df.select(F.col(class_col).alias("class"), F.posexplode(F.col(features_col).cast("array<double>")).alias("i", "x"))
    cells = long.groupBy("class", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return cells.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("n"))


def assign_nearest(df: DataFrame, centers: DataFrame, features_col: str = "features", id_col: str = "row_id") -> DataFrame:
    """Add `cluster` and `center_dist`: the nearest of the centers (class, mean), the lowest class on a tie.

    Few centers are sent to all executors, more are met block by block, as in `nearest`. Rows without an id have no nearest center.
    """
    found = nearest(df.select(F.col(id_col).alias("row_id"), F.col(features_col).alias("features")), centers.select(F.col("class").cast("long").alias("row_id"), F.col("mean").alias("features")), 1)
    found = found.select(F.col("row_id").alias("__id"), F.get("neighbors", F.lit(0)).alias("__best"))
    kind = dict(centers.dtypes)["class"]
    out = df.join(found, F.col(id_col) == F.col("__id"), "left")
    return out.withColumns({"cluster": F.col("__best.id").cast(kind), "center_dist": F.col("__best.dist")}).drop("__id", "__best")


def lloyd_step(df: DataFrame, centers: DataFrame, features_col: str = "features") -> DataFrame:
    """One step of K-means: the means of the rows nearest to each center."""
    return class_means(assign_nearest(df, centers, features_col), "cluster", features_col)
