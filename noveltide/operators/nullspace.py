"""Null projecting directions: distributed scatter sums, then a small eigenproblem on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide import session
from noveltide.operators.pivots import matrix

#: The driver solves a d x d problem; wider tables take `wide_directions`.
MOST_FEATURES = 4096
#: Directions of wide tables that are looked for at most.
MOST_RANK = 1024
#: Numbers of a matrix that are added up together; larger matrices are summed in blocks of rows.
BLOCK_VALUES = 1 << 17


class Scatter(NamedTuple):
    """Within-class, total and between-class scatter, each over n; means per class."""

    n: int
    within: np.ndarray
    total: np.ndarray
    between: np.ndarray
    mean: np.ndarray
    classes: list[int]
    means: np.ndarray


class Projection(NamedTuple):
    """Directions as columns, and diagnostics: ranks, the null directions there can be, and the least number of clusters for any."""

    w: np.ndarray
    rank_within: int
    rank_total: int
    null_size: int
    least_clusters: int

    @property
    def kind(self) -> str:
        """What the directions are: "null", or "regularised" where no direction is null."""
        return "null" if self.null_size and self.w.shape[1] == self.null_size else "regularised"


def scatter(df: DataFrame, class_col: str = "cluster", features_col: str = "features") -> Scatter:
    """Sums of x and 1 per class and of x x' over all rows, made per task and added up per class and block of matrix rows; the driver gets one row per class and per block.

    A task that adds up holds one block at a time, however many tasks have sent theirs.
    Sums are taken about the first row's point, which keeps them exact for tables far from the origin.
    """
    session.ship(df.sparkSession)
    head = df.select(features_col).first()
    if head is None:
        raise ValueError("no rows")
    shift = np.array(head[0], "f8")
    d = len(shift)
    if d > MOST_FEATURES:
        raise ValueError(f"{d} features; at most {MOST_FEATURES}: use wide_directions")
    step = max(1, BLOCK_VALUES // d)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        gram = np.zeros((d, d))
        for f in frames:
            x = np.array(f["x"].tolist(), "f8").reshape(len(f), d) - shift
            c = f["c"].to_numpy("i8")
            gram += x.T @ x
            order = np.argsort(c, kind="stable")
            found, first, size = np.unique(c[order], return_index=True, return_counts=True)
            for k, n, own in zip(found.tolist(), size.tolist(), np.add.reduceat(x[order], first) if len(first) else (), strict=True):
                s = sums.setdefault(k, [0, np.zeros(d)])
                s[0] += n
                s[1] += own
        if sums:
            yield pd.DataFrame([*((k, -1, n, s.tobytes()) for k, (n, s) in sums.items()), *((0, b, 0, gram[b : b + step].tobytes()) for b in range(0, d, step))], columns=["c", "b", "n", "v"])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, total = None, 0, None
        for f in frames:
            for c, b, own, v in f.itertuples(index=False):
                if (c, b) != key:
                    if key is not None:
                        yield pd.DataFrame([(*key, n, total.tobytes())], columns=["c", "b", "n", "v"])
                    key, n, total = (c, b), 0, np.zeros(len(v) // 8)
                n += own
                total += np.frombuffer(v)
        if key is not None:
            yield pd.DataFrame([(*key, n, total.tobytes())], columns=["c", "b", "n", "v"])

    schema = "c long, b int, n long, v binary"
    rows = df.select(F.col(class_col).cast("long").alias("c"), F.col(features_col).cast("array<double>").alias("x")).mapInPandas(partial, schema)
    rows = rows.repartition("c", "b").sortWithinPartitions("c", "b").mapInPandas(add, schema).orderBy("c", "b").toLocalIterator()
    n, mean_sum, gram, classes, means, sizes, roots = 0, np.zeros(d), np.zeros((d, d)), [], [], [], []
    for r in rows:
        v = np.frombuffer(r.v)
        if r.b < 0:
            n, mean_sum = n + r.n, mean_sum + v
            classes.append(r.c)
            means.append(v / r.n + shift)
            sizes.append(r.n)
            roots.append(v / np.sqrt(r.n))
        else:
            gram[r.b : r.b + step] = v.reshape(-1, d)
    roots = np.array(roots)
    within = gram - roots.T @ roots
    mean = mean_sum / n
    all_scatter = gram - np.outer(mean, mean) * n
    away = np.array(means) - (mean + shift)
    between = (away * np.array(sizes)[:, None]).T @ away
    return Scatter(n, within / n, all_scatter / n, between / n, mean + shift, classes, np.array(means))


def least_clusters(n: int, d: int) -> int:
    """The least number of clusters of n rows of d features with any null direction: the within scatter's rank is n - clusters at most."""
    return max(1, n - d + 1)


def null_directions(s: Scatter, rtol: float = 1e-10, atol: float = 0.0) -> Projection:
    """Directions in which classes collapse to points but the whole doesn't: null space of the within scatter, inside the total's range.

    Where rows are fewer than features the null space of the within scatter alone
    holds directions in which nothing varies; these are left out. `rtol` is relative to the largest eigenvalue, so the
    result doesn't depend on units; `atol` is an absolute bound on the singular values of the centred rows, as older
    reports have it (1e-8), below which a direction is null as well. Without any direction w has no columns.
    """
    values, vectors = np.linalg.eigh(s.total)
    q = vectors[:, values > rtol * max(values[-1], 0)] if values[-1] > 0 else vectors[:, :0]
    inner = q.T @ s.within @ q
    own, basis = np.linalg.eigh(inner) if inner.size else (np.zeros(0), np.zeros((0, 0)))
    top = max(values[-1], 0)
    null = (own <= rtol * top) | (np.sqrt(np.maximum(own, 0) * s.n) <= atol)
    rank_within = int((~null).sum())
    w = q @ basis[:, null]
    return Projection(w, rank_within, q.shape[1], int(null.sum()), least_clusters(s.n, len(s.mean)))


def regularized_directions(s: Scatter, penalty: float = 1e-4) -> Projection:
    """The c - 1 directions of the smallest within scatter (plus `penalty` times the identity), turned to the axes of the between scatter."""
    values, vectors = np.linalg.eigh(s.within + penalty * np.eye(len(s.mean)))
    few = vectors[:, : max(0, len(s.classes) - 1)]
    inner = few.T @ s.between @ few
    if inner.size:
        own, basis = np.linalg.eigh(inner)
        few = few @ basis[:, np.argsort(-own)]
    return Projection(few, int((values > 2 * penalty).sum()), 0, 0, 1)


def directions(s: Scatter, rtol: float = 1e-10, penalty: float = 1e-4) -> Projection:
    """Null directions where there are any, else the regularised ones.

    With many more rows than features and few clusters the within scatter has full
    rank, so no direction collapses all classes; the c - 1 directions of the smallest within scatter are the
    nearest to that. `null_size` is 0 then.
    """
    p = null_directions(s, rtol)
    return p if p.w.shape[1] else p._replace(w=regularized_directions(s, penalty).w)


def _added(partial: DataFrame) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """{(key, block): (rows, sum)} of the tasks' sums (k, b, n, v); a task that adds up holds one block at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = None, 0, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["k", "b", "n", "v"])
        for batch in batches:
            for k, b, own, v in zip(*batch.columns, strict=True):
                if (k.as_py(), b.as_py()) != key:
                    if key is not None:
                        yield row()
                    key, n, total = (k.as_py(), b.as_py()), 0, 0.0
                n, total = n + own.as_py(), total + np.frombuffer(v.as_buffer())
        if key is not None:
            yield row()

    rows = partial.repartition("k", "b").sortWithinPartitions("k", "b").mapInArrow(add, _SUMS).toLocalIterator()
    return {(r.k, r.b): (r.n, np.frombuffer(r.v)) for r in rows}


_SUMS = "k long, b int, n long, v binary"


def _sum_rows(sums: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A task's sums, in blocks of `BLOCK_VALUES` numbers."""
    for k, (n, s) in sums.items():
        flat = s.ravel()
        for b in range(0, max(1, -(-flat.size // BLOCK_VALUES))):
            part = flat[b * BLOCK_VALUES : (b + 1) * BLOCK_VALUES]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([b], pa.int32()), pa.array([n], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["k", "b", "n", "v"])


def _matrix_of(found: dict[tuple[int, int], tuple[int, np.ndarray]], key: int, shape: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([found[k][1] for k in sorted(found) if k[0] == key]).reshape(shape)


def tall_qr(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]], width: int, groups: int = 32) -> dict[int, np.ndarray]:
    """The R factors (width x width, their signs aside) of tall matrices whose rows `of(classes, features)` makes from batches, by key.

    Each task keeps one factor a key and folds batch after batch into it; factors are then folded in groups, and the groups' in one task. No product of the matrix with
    itself is made, so small singular values keep their digits.
    """

    def fold(r: np.ndarray | None, more: np.ndarray) -> np.ndarray:
        both = more if r is None else np.vstack([r, more])
        return np.linalg.qr(both, mode="r") if len(both) > width else both

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                for k, m in of(part.column("c").to_numpy(), matrix(part.column("x"))).items():
                    held[k] = fold(held.get(k), m)
        for k, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([0], pa.int32()), pa.array([len(r)], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["k", "b", "n", "v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v"), strict=True):
                held[k] = fold(held.get(k), np.frombuffer(v.as_buffer()).reshape(-1, width))
        for k, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([0], pa.int32()), pa.array([len(r)], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["k", "b", "n", "v"])

    found = rows.mapInArrow(partial, _SUMS).repartition(groups).mapInArrow(merge, _SUMS).repartition(1).mapInArrow(merge, _SUMS).collect()
    return {r.k: np.frombuffer(r.v).reshape(-1, width) for r in found}


def wide_directions(df: DataFrame, rank: int = MOST_RANK, class_col: str = "cluster", features_col: str = "features", rtol: float = 1e-10, passes: int = 2, seed: int = 42) -> Projection:
    """Null directions of tables of any width, without a matrix of features by features: those inside the `rank` directions of the largest scatter.

    A randomised range finder (products with a row's own random vector, then `passes` turns towards the larger
    scatter) gives up to `rank` directions that hold the rows' spread, all of it where there are at most that many; rows projected on them
    go through a QR reduction tree, once about the mean and once about their class's mean, and the null directions come from these factors' singular values. The
    driver holds features by `rank` numbers, and one mean a class. Equal to `null_directions` where the total's rank is at most `rank`.
    """
    spark = df.sparkSession
    session.ship(spark)
    rows = df.select(F.col(class_col).cast("long").alias("c"), F.col("row_id").cast("long").alias("i"), F.col(features_col).cast("array<double>").alias("x"))
    head = rows.select("x").first()
    if head is None:
        raise ValueError("no rows")
    d, shift = len(head[0]), np.array(head[0], "f8")

    def class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            x, c = matrix(b.column("x")), b.column("c").to_numpy()
            for k in np.unique(c):
                n, s = sums.get(int(k), (0, np.zeros(d)))
                sums[int(k)] = n + int((c == k).sum()), s + (x[c == k] - shift).sum(0)
        yield from _sum_rows(sums)

    found = _added(rows.mapInArrow(class_sums, _SUMS))
    classes = sorted({k for k, _ in found})
    sizes = np.array([found[k, 0][0] for k in classes])
    sums = np.array([_matrix_of(found, k, (d,)) for k in classes])
    n = int(sizes.sum())
    mean, means = sums.sum(0) / n + shift, sums / sizes[:, None] + shift
    width = max(1, min(rank, n - 1, d))
    sent = spark.sparkContext.broadcast((mean, means, np.array(classes)))

    def spread(q: np.ndarray | None) -> np.ndarray:
        """Sum of centred row times its random vector, or times its own projection on q; orthonormal columns."""
        basis = None if q is None else spark.sparkContext.broadcast(q)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((d, width)), 0
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column("x")) - sent.value[0]
                    g = np.array([np.random.default_rng([seed, i & 0xFFFFFFFF, i >> 32 & 0xFFFFFFFF]).standard_normal(width) for i in b.column("i").to_pylist()]) if basis is None else x @ basis.value
                    total, count = total + x.T @ g, count + len(x)
            if count:
                yield from _sum_rows({0: (count, total)})

        return np.linalg.qr(_matrix_of(_added(rows.mapInArrow(partial, _SUMS)), 0, (d, width)))[0]

    q = spread(None)
    for _ in range(passes):
        q = spread(q)
    basis = spark.sparkContext.broadcast(q)

    def both(c: np.ndarray, x: np.ndarray) -> dict[int, np.ndarray]:
        mean, means, known = sent.value
        return {0: (x - mean) @ basis.value, 1: (x - means[np.searchsorted(known, c)]) @ basis.value}

    r = tall_qr(rows.select("c", "x"), both, width)
    _, s, vt = np.linalg.svd(r[0])
    s = np.r_[s, np.zeros(len(vt) - len(s))]
    kept = vt[(s**2 > rtol * s[0] ** 2) & (s > 0)].T
    _, s2, v2 = np.linalg.svd(r[1] @ kept) if kept.shape[1] else (None, np.zeros(0), np.zeros((0, 0)))
    s2 = np.r_[s2, np.zeros(len(v2) - len(s2))]
    null = s2**2 <= rtol * s[0] ** 2
    return Projection(q @ kept @ v2[null].T, int((~null).sum()), kept.shape[1], int(null.sum()), least_clusters(n, d))


def principal_directions(s: Scatter, k: int) -> np.ndarray:
    """The k directions of the largest total scatter as columns; each one's largest entry is positive."""
    values, vectors = np.linalg.eigh(s.total)
    w = vectors[:, np.argsort(-values, kind="stable")[:k]]
    return w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])


def project(df: DataFrame, w: np.ndarray, features_col: str = "features", center: np.ndarray | None = None) -> DataFrame:
    """(features - center) @ w, in Arrow batches; w is d x L and goes to all executors (d is bounded)."""
    if w.shape[1] == 0:
        raise ValueError("no direction to project on; use more clusters, or the regularised directions")
    session.ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((w, np.zeros(len(w)) if center is None else center))

    def run(v: pd.Series) -> pd.Series:
        matrix, origin = sent.value
        return pd.Series(list((np.array(v.tolist(), "f8").reshape(len(v), -1) - origin) @ matrix))

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return df.withColumn(features_col, F.pandas_udf(run, "array<double>")(F.col(features_col).cast("array<double>")))
