"""Detectors with a fitted model: components, projections and ensembles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide import session
from noveltide.operators.detectors import tabular
from noveltide.operators.detectors.common import SAMPLE_ROWS, map_scores, sample_matrix
from noveltide.operators.detectors.forests import isolation_forest
from noveltide.operators.nullspace import scatter
from noveltide.operators.pivots import matrix as matrix_of
from noveltide.operators.score import min_max_probability

class Pca(NamedTuple):
    """Mean and deviation of the features, principal axes as columns, and each axis's share of the variance."""

    mean: np.ndarray
    std: np.ndarray
    vectors: np.ndarray
    share: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Distance from the mean along the axes, each weighted by its inverse share."""
        return (np.abs(((x - self.mean) / self.std) @ self.vectors) / self.share).sum(1)


def fit_pca(train: DataFrame, components: int | None = None) -> Pca:
    """The scatter comes from distributed sums over all rows; only the d x d eigenproblem is on the driver.

    Axes along which the training rows don't vary are left out, as nothing tells their directions apart.
    """
    s = scatter(train.withColumn("cluster", F.lit(0)))
    std = np.sqrt(np.diag(s.total))
    std = np.where(std > 1e-12, std, 1.0)
    values, vectors = np.linalg.eigh(s.total / np.outer(std, std))
    keep = np.argsort(-values)[: components or len(values)]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 0)]
    values, vectors = values[keep], vectors[:, keep]
    return Pca(s.mean, std, vectors, values / values.sum())


def pca(test: DataFrame, train: DataFrame, components: int | None = None) -> DataFrame:
    """(row_id, score): distance from the mean in standardised principal axes, each weighted by its inverse share of the variance."""
    return map_scores(test, fit_pca(train, components).score)


class Loda(NamedTuple):
    """Sparse random projections as columns, and for each its edges and the shares of all rows in its bins."""

    w: np.ndarray
    edges: np.ndarray
    density: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean negative log density; outside of the training rows' range the density is 1e-12."""
        p = x @ self.w
        total = np.zeros(len(x))
        for k, edges in enumerate(self.edges):
            at = bins_of(p[:, k], edges)
            inside = (p[:, k] >= edges[0]) & (p[:, k] <= edges[-1])
            total -= np.log(np.where(inside, self.density[k][at], 1e-12))
        return total / self.w.shape[1]


def bins_of(p: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each value; the last one holds its upper edge."""
    return np.clip(np.searchsorted(edges, p, side="right") - 1, 0, len(edges) - 2)


def fit_loda(train: DataFrame, cuts: int = 100, bins: int = 10, seed: int = 42) -> Loda:
    """Histograms of all rows: a pass for each projection's least and greatest value, one for the bins' counts, both summed per task."""
    session.ship(train.sparkSession)
    head = train.select("features").first()
    if head is None:
        raise ValueError("no rows to fit on")
    rng, d = np.random.default_rng(seed), len(head[0])
    w = np.zeros((d, cuts))
    for k in range(cuts):
        own = rng.choice(d, max(1, int(np.sqrt(d))), replace=False)
        w[own, k] = rng.normal(size=len(own))
    rows = train.select(F.col("features").cast("array<double>").alias("x"))

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.full(cuts, np.inf), np.full(cuts, -np.inf), 0
        for b in batches:
            if b.num_rows:
                p = matrix_of(b.column(0)) @ w
                low, high, n = np.minimum(low, p.min(0)), np.maximum(high, p.max(0)), n + len(p)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cuts), pa.int32()), pa.array(low), pa.array(high)], ["k", "low", "high"])

    ends = rows.mapInArrow(extremes, "k int, low double, high double").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("k").collect()
    edges = np.array([np.histogram_bin_edges(np.array([r.low, r.high]), bins) for r in ends])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shift = np.zeros(cuts * bins, "i8"), np.arange(cuts) * bins
        for b in batches:
            if b.num_rows:
                p = matrix_of(b.column(0)) @ w
                at = np.stack([bins_of(p[:, k], edges[k]) for k in range(cuts)], 1) + shift
                total += np.bincount(at.ravel(), minlength=cuts * bins)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cuts * bins), pa.int32()), pa.array(total)], ["i", "n"])

    held = np.zeros(cuts * bins)
    for r in rows.mapInArrow(counts, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row a bin
        held[r.i] = r.n
    held = held.reshape(cuts, bins)
    return Loda(w, edges, (held + 1e-12) / held.sum(1, keepdims=True))


def loda(test: DataFrame, train: DataFrame, cuts: int = 100, bins: int = 10, seed: int = 42) -> DataFrame:
    """(row_id, score): mean negative log density over histograms of sparse random projections of all training rows."""
    return map_scores(test, fit_loda(train, cuts, bins, seed).score)


def fitted(fit: Callable[..., Callable[[np.ndarray], np.ndarray]], rows: int | None = SAMPLE_ROWS) -> Callable[..., DataFrame]:
    """A detector (test, train, sample_rows=..., **options) from a function that fits a bounded sample, or all rows (None), and returns a scorer."""

    def detect(test: DataFrame, train: DataFrame, sample_rows: int | None = rows, **options) -> DataFrame:
        return map_scores(test, fit(sample_matrix(train, sample_rows), **options))

    return detect


def average(scores: list[DataFrame]) -> DataFrame:
    """(row_id, score): the mean of the detectors' scores, each first scaled to 0..1."""
    merged = None
    for s in scores:
        # Written once, as the scores' range is broadcast before they are scaled.
        own = min_max_probability(session.materialize(s.select("row_id", "score"), "scores")).select("row_id", F.col("p_anomaly").alias("score"))
        merged = own if merged is None else merged.unionByName(own)
    return merged.groupBy("row_id").agg(F.avg("score").alias("score"))


def suod(test: DataFrame, train: DataFrame, seed: int = 42) -> DataFrame:
    """Five base detectors, their scaled scores averaged."""
    return average([
        tabular.knn(test, train),
        tabular.hbos(test, train, bins=10),
        isolation_forest(test, train, trees=50, sample=128, seed=seed),
        pca(test, train, components=10),
        loda(test, train, seed=seed),
    ])
