"""Nearest neighbours: block products, with one side sent where it is small, and an index by pivots where there are too many pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide import session
from noveltide.operators import pivots

#: The most numbers of a reference matrix that are sent to all executors, through the driver (16 MB of doubles).
BROADCAST_VALUES = 2_000_000
#: The most pairs that are compared one and all where neither side is sent; tables with more are indexed.
MOST_PAIRS = 600_000_000_000
#: Rows of a pack, the most packs' files of a side, and train rows that meet a pack at once.
PACK, TEST_FILES, TRAIN_FILES, MEET = 4096, 96, 8, 32_768
#: Rows of a block product, and train rows of it (8 MB of distances, which also stay in the processor's cache).
BLOCK, TRAIN_BLOCK = 256, 4096
#: The most numbers of the differences that are held at once.
EXACT_VALUES = 1_000_000


def pairwise_squared(a: np.ndarray, b: np.ndarray, negative: str = "clamp") -> np.ndarray:
    """Squared distances by norm expansion; what rounding leaves below 0 becomes 0 (clamp) or positive (abs)."""
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(squared, 0) if negative == "clamp" else np.abs(squared)


def k_nearest(test: np.ndarray, test_ids: np.ndarray, train: np.ndarray, train_ids: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest rows, nearest first, ties by id; short rows are filled with inf and -1.

    Candidates come from block products of `BLOCK` by `TRAIN_BLOCK` rows, of which no more than one is held; their distances are then taken from
    differences, so coincident points are at 0. Where more rows than candidates are as near as
    the k-th, within the product's rounding, all of them are compared.
    """
    dist, ids = np.full((len(test), k), np.inf), np.full((len(test), k), -1, "i8")
    if not len(train):
        return dist, ids
    take = min(len(train), k + 8)
    step = max(1, EXACT_VALUES // max(1, take * test.shape[1]))
    norm = (train * train).sum(1)
    own_norm = (test * test).sum(1)
    slack = 8 * (test.shape[1] + 4) * np.finfo("f8").eps * (own_norm + norm.max(where=np.isfinite(norm), initial=0))
    by_id = np.argsort(train_ids, kind="stable") if exclude_self else None

    def order(rows: np.ndarray, near: np.ndarray) -> None:
        for c in range(0, len(rows), step):
            own, at = rows[c : c + step], near[c : c + step]
            exact = np.full(at.shape, np.inf)
            i, j = np.nonzero(at >= 0)
            exact[i, j] = np.sqrt(((test[own[i]] - train[at[i, j]]) ** 2).sum(1))
            who = np.where(at >= 0, train_ids[at], -1)
            exact[~np.isfinite(exact)] = np.inf
            first = np.lexsort((who, exact), axis=1)[:, :k]
            got = first.shape[1]
            dist[own, :got] = np.take_along_axis(exact, first, 1)
            ids[own, :got] = np.where(np.isfinite(dist[own, :got]), np.take_along_axis(who, first, 1), -1)

    def product(rows: np.ndarray, c: int) -> np.ndarray:
        """Squared distances, as rounding leaves them, of test rows to a block of train rows; inf for oneself and what isn't finite."""
        d = left[rows] @ right[c : c + TRAIN_BLOCK].T
        if not finite:
            d[~np.isfinite(d)] = np.inf
        if exclude_self:
            i = np.flatnonzero((self_row >= rows[0]) & (self_row <= rows[-1]) & (self_at >= c) & (self_at < c + TRAIN_BLOCK))
            d[self_row[i] - rows[0], self_at[i] - c] = np.inf
        return d

    # One product gives -2 x y + |x|^2 + |y|^2.
    left = np.column_stack([-2 * test, own_norm, np.ones(len(test))])
    right = np.column_stack([train, np.ones(len(train)), norm])
    if exclude_self:
        lo, hi = (np.searchsorted(train_ids, test_ids, side=side, sorter=by_id) for side in ("left", "right"))
        self_row = np.repeat(np.arange(len(test)), hi - lo)
        self_at = by_id[np.arange(len(self_row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    finite = bool(np.isfinite(norm).all() and np.isfinite(own_norm).all())
    starts = range(0, len(train), TRAIN_BLOCK)
    for a in range(0, len(test), BLOCK):
        n = min(BLOCK, len(test) - a)
        best, near = np.full((n, take), np.inf), np.full((n, take), -1, "i8")
        for c in starts:
            d = product(np.arange(a, a + n), c)
            if not c:
                few = min(take, d.shape[1])
                at = np.argpartition(d, few - 1, axis=1)[:, :few] if few < d.shape[1] else np.tile(np.arange(few), (n, 1))
                best[:, :few], near[:, :few] = np.take_along_axis(d, at, 1), at
            else:
                # Of the others only those nearer than the last candidate are looked at, merged by row and distance.
                closer = np.flatnonzero(d < best[:, -1:])
                if not len(closer):
                    continue
                i, j = np.divmod(closer, d.shape[1])
                rows, i = np.unique(i, return_inverse=True)
                i = np.r_[i, np.repeat(np.arange(len(rows)), take)]
                both, who = np.r_[d.ravel()[closer], best[rows].ravel()], np.r_[j + c, near[rows].ravel()]
                first = np.lexsort((both, i))
                first = first[(np.searchsorted(i[first], np.arange(len(rows)))[:, None] + np.arange(take)).ravel()].reshape(-1, take)
                best[rows], near[rows] = both[first], who[first]
                continue
            first = np.argsort(best, axis=1, kind="stable")
            best, near = np.take_along_axis(best, first, 1), np.take_along_axis(near, first, 1)
        near[~np.isfinite(best)] = -1
        order(np.arange(a, a + n), near)
        if take < len(train):
            reach = best[:, k - 1] + slack[a : a + n]
            # More rows than candidates may be within reach only where all candidates are.
            tied = np.flatnonzero(np.isfinite(best[:, -1]) & (best[:, -1] <= reach))
            for i in tied.tolist():
                own = np.array([a + i])
                found = [c + np.flatnonzero(product(own, c)[0] <= reach[i]) for c in starts]
                order(own, np.concatenate(found)[None, :])
    return dist, ids


def _packs(df: DataFrame, n: int, files: int) -> DataFrame:
    """The rows as (ids, x): packs of up to `PACK` ids and vectors as bytes, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, size = [], [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(xs).tobytes()], pa.binary())], ["ids", "x"])

        for b in batches:
            for a in range(0, b.num_rows, PACK):
                part = b.slice(a, PACK)
                if size and size + part.num_rows > PACK:
                    yield packed()
                    ids, xs, size = [], [], 0
                ids.append(part.column("row_id").to_numpy())
                xs.append(pivots.matrix(part.column("features")))
                size += part.num_rows
        if size:
            yield packed()

    rows = df.select(F.col("row_id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("features"))
    return session.materialize(rows.repartition(max(1, min(files, -(-n // PACK))), "row_id").mapInArrow(run, "ids binary, x binary"), "packs")


def _products(test: DataFrame, train: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k nearest rows of packs for rows of packs: every pack of one side meets every pack of the other, a bounded number of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, x, best, ids, xs, size = None, None, None, None, [], [], 0

        def meet() -> tuple[np.ndarray, np.ndarray]:
            found = k_nearest(x, own, np.concatenate(xs), np.concatenate(ids), k, exclude_self)
            if best is None:
                return found
            dist, who = (np.concatenate(c, axis=1) for c in zip(best, found, strict=True))
            first = np.lexsort((who, dist), axis=1)[:, :k]
            return np.take_along_axis(dist, first, 1), np.take_along_axis(who, first, 1)

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own), pivots.neighbor_lists(*best)], ["row_id", "neighbors"])

        for b in batches:
            for tid, tx, cid, cx in zip(*b.columns, strict=True):
                if (tid := tid.as_py()) != now:
                    if size:
                        best = meet()
                    if now is not None:
                        yield found()
                    now, own, best, ids, xs, size = tid, np.frombuffer(tid, "i8"), None, [], [], 0
                    x = np.frombuffer(tx.as_py()).reshape(len(own), -1)
                ids.append(np.frombuffer(cid.as_py(), "i8"))
                xs.append(np.frombuffer(cx.as_py()).reshape(len(ids[-1]), -1))
                size += len(ids[-1])
                if size >= MEET:
                    best = meet()
                    ids, xs, size = [], [], 0
        if size:
            best = meet()
        if now is not None:
            yield found()

    pairs = test.crossJoin(train.select(F.col("ids").alias("train_ids"), F.col("x").alias("train_x")).hint("shuffle_replicate_nl"))
    return session.materialize(pivots._best(pairs.mapInArrow(run, pivots.NEIGHBORS), k, True), "neighbors")


def nearest(test: DataFrame, train: DataFrame, k: int = 1, exclude_self: bool = False, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """The k nearest `train` rows of each `test` row: (row_id, neighbors array<struct<dist, id>>), nearest first, ties by id.

    Both have row_id, distinct in each, and features without nulls. A train side of up to `broadcast_values`
    numbers is sent to all executors. Beyond, both sides are packed and met pack by pack, up to `MOST_PAIRS` pairs of rows;
    larger ones are indexed by pivots, so that a row meets only the blocks that may hold a neighbour.
    """
    spark = test.sparkSession
    session.ship(spark)
    # Pairs of packs are megabytes a row.
    session.small_batches(spark)
    shape = train.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    if (shape.n or 0) * (shape.d or 0) > broadcast_values:
        n = test.count()
        if n * shape.n > MOST_PAIRS:
            return pivots.search(test, pivots.build(train, k), exclude_self)
        return _products(_packs(test, n, TEST_FILES), _packs(train, shape.n, TRAIN_FILES), k, exclude_self)
    given = train.select("row_id", F.col("features").cast("array<double>").alias("features")).toArrow()
    sent = spark.sparkContext.broadcast((pivots.matrix(given["features"]), given["row_id"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference, ids = sent.value
        for b in batches:
            own = b.column("row_id").to_numpy()
            if len(ids) and len(own):
                lists = pivots.neighbor_lists(*k_nearest(pivots.matrix(b.column("features")), own, reference, ids, k, exclude_self))
            else:
                lists = pivots.neighbor_lists(np.zeros((len(own), 1)), np.full((len(own), 1), -1, "i8"))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), lists], ["row_id", "neighbors"])

    rows = test.select(F.col("row_id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("features"))
    return rows.mapInArrow(run, pivots.NEIGHBORS)


def nearest_distance(test: DataFrame, train: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(row_id, dist) to the nearest train row; null where there is none."""
    return nearest(test, train, 1, exclude_self).select("row_id", F.get("neighbors", F.lit(0))["dist"].alias("dist"))
