"""Optimisation over all rows: losses and gradients summed per task in Arrow, added up in a tree, steps on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide import session
from noveltide.operators.detectors.common import map_scores
from noveltide.operators.pivots import matrix

#: Rows of a chunk inside a task, and groups that the tasks' sums are first added up in.
CHUNK, GROUPS = 8192, 32
#: Pairs of steps and gradients that the step's direction is made of.
MEMORY = 8

#: (features, targets, parameters) -> (loss of each row, sum of the rows' gradients)
Objective = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Fit(NamedTuple):
    """Parameters, and (epoch, batch, rows, loss) for each epoch and batch: the loss is the batch's sum under the epoch's first parameters."""

    parameters: np.ndarray
    losses: list[tuple[int, int, int, float]]

    def table(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.losses, "epoch int, batch int, rows long, loss double")


def sums(rows: DataFrame, objective: Objective, parameters: np.ndarray, groups: int = 0) -> tuple[dict[int, tuple[int, float]], np.ndarray]:
    """({batch: (rows, loss)}, gradient) over all of `rows` (batch, y, x).

    A task sends a row a batch and one gradient; with `groups` these are added up in so many groups before the driver sees them.
    """
    sent = rows.sparkSession.sparkContext.broadcast(parameters)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, held = np.zeros(len(parameters)), {}
        for b in batches:
            for a in range(0, b.num_rows, CHUNK):
                part = b.slice(a, CHUNK)
                loss, g = objective(matrix(part.column("x")), part.column("y").to_numpy(zero_copy_only=False), sent.value)
                gradient += g
                number = part.column("batch").to_numpy()
                n, s = np.bincount(number), np.bincount(number, loss)
                for k in np.flatnonzero(n):
                    m, t = held.get(int(k), (0, 0.0))
                    held[int(k)] = m + int(n[k]), t + float(s[k])
        if held:
            yield _sums(held, gradient)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, held = np.zeros(len(parameters)), {}
        for b in batches:
            for k, n, s, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g is not None:
                    gradient += np.frombuffer(g)
                m, t = held.get(k, (0, 0.0))
                held[k] = m + n, t + s
        if held:
            yield _sums(held, gradient)

    schema = "batch int, n long, loss double, g binary"
    found = rows.mapInArrow(partial, schema)
    if groups:
        found = found.repartition(groups).mapInArrow(merge, schema)
    found = found.collect()
    total, gradient = {}, np.zeros(len(parameters))
    for r in sorted(found, key=lambda r: (r.batch, r.n, r.loss)):
        n, s = total.get(r.batch, (0, 0.0))
        total[r.batch] = n + r.n, s + r.loss
        if r.g is not None:
            gradient += np.frombuffer(r.g)
    return total, gradient


def _sums(held: dict[int, tuple[int, float]], gradient: np.ndarray) -> pa.RecordBatch:
    keys = sorted(held)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1] for k in keys], pa.float64()), pa.array([gradient.tobytes(), *[None] * (len(keys) - 1)], pa.binary())], ["batch", "n", "loss", "g"])


def minimise(rows: DataFrame, objective: Objective, start: np.ndarray, penalty: float = 0.0, free: int = 0, epochs: int = 30, batches: int = 1, tolerance: float = 1e-7, seed: int = 42) -> Fit:
    """Minimise mean loss + penalty / 2 * |parameters without the last `free`|^2 over (row_id, y, x), by limited-memory BFGS with halved steps.

    Every epoch is one pass over all rows; each step that is tried is one more. Rows are dealt to `batches` by hash of seed and row id, so the
    losses reported by batch are the same in any run and partitioning, but for the order of additions. Ends where the gradient's
    length is below `tolerance`, or where no step lowers the objective.
    """
    session.ship(rows.sparkSession)
    data = rows.select(F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(batches)).cast("int").alias("batch"), F.col("y").cast("double").alias("y"), F.col("x").cast("array<double>").alias("x")).persist()
    damped = np.ones(len(start))
    damped[len(start) - free :] = 0.0

    groups = GROUPS if data.rdd.getNumPartitions() > 2 * GROUPS else 0

    def evaluate(w: np.ndarray) -> tuple[dict[int, tuple[int, float]], float, np.ndarray]:
        held, g = sums(data, objective, w, groups)
        n = sum(c for c, _ in held.values())
        return held, sum(s for _, s in held.values()) / n + penalty / 2 * float((damped * w * w).sum()), g / n + penalty * damped * w

    try:
        w, losses, pairs = np.array(start, "f8"), [], []
        if data.isEmpty():
            return Fit(w, [])
        held, value, g = evaluate(w)
        for epoch in range(epochs):
            losses += [(epoch, k, *held[k]) for k in sorted(held)]
            if np.linalg.norm(g) < tolerance or epoch == epochs - 1:
                break
            way, step = -_direction(g, pairs), 1.0 if pairs else 1.0 / max(1.0, float(np.linalg.norm(g)))
            slope = float(g @ way)
            while True:
                after = evaluate(w + step * way)
                if after[1] <= value + 1e-4 * step * slope or step < 1e-10:
                    break
                step /= 2
            if after[1] >= value:
                break
            moved, turned = step * way, after[2] - g
            if moved @ turned > 1e-12 * float(turned @ turned):
                pairs = [*pairs, (moved, turned)][-MEMORY:]
            w, (held, value, g) = w + moved, after
        return Fit(w, losses)
    finally:
        data.unpersist()


def _direction(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The inverse Hessian's estimate times g, by the two loops over the last steps."""
    q, kept = g.copy(), []
    for s, y in reversed(pairs):
        a = float(s @ q) / float(s @ y)
        kept.append(a)
        q -= a * y
    if pairs:
        s, y = pairs[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(pairs, reversed(kept), strict=True):
        q += s * (a - float(y @ q) / float(s @ y))
    return q


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log loss of labels 0 and 1; the last parameter is the intercept."""
    z = x @ w[:-1] + w[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return np.logaddexp(0, z) - y * z, np.r_[x.T @ (p - y), (p - y).sum()]


def fit_logistic(df: DataFrame, label_col: str, penalty: float = 1e-3, epochs: int = 30, batches: int = 1, seed: int = 42) -> Fit:
    """Logistic regression of a label (0 or 1) on `features`, over all rows with a label; the intercept has no penalty."""
    rows = df.where(F.col(label_col).isNotNull()).select("row_id", F.col(label_col).alias("y"), F.col("features").alias("x"))
    head = rows.select("x").first()
    if head is None:
        raise ValueError("no rows to fit on")
    return minimise(rows, logistic, np.zeros(len(head[0]) + 1), penalty, 1, epochs, batches, seed=seed)


def logistic_scores(df: DataFrame, fit: Fit) -> DataFrame:
    """(row_id, score): the probability of label 1."""
    w = fit.parameters
    return map_scores(df, lambda x: 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -700, 700))))
