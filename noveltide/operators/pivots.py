"""Exact nearest neighbours of large tables: blocks around pivots, of which a row meets only those that the triangle inequality leaves."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noveltide import session
from noveltide.operators.prep import hash_order

#: The most pivots; they and their distances from each other go to all executors.
MOST_PIVOTS = 2048
LEAST_PIVOTS = 16
#: Rings of a cell, at quantiles of the distance from its pivot.
RINGS = 16
#: Rows of a block. Tables of over MOST_BLOCKS times as many have larger blocks, so that the blocks' bounds fit in a broadcast.
BLOCK_ROWS, MOST_BLOCKS = 4096, 100_000
#: Test rows that meet a block in one task.
MEET_ROWS = 20_000
#: Rows for which more blocks are left than this number and this share of all blocks don't visit them one by one: they meet all blocks, in packs.
MOST_VISITS, VISITED_SHARE = 16, 0.25
#: Bounds worked out at once.
BOUND_VALUES = 500_000
#: Salts of vectors that many rows share.
SALTS = 64

NEIGHBORS = "row_id long, neighbors array<struct<dist: double, id: long>>"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of an Arrow column of lists, all of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1 if len(flat) else 0)


def neighbor_lists(dist: np.ndarray, who: np.ndarray) -> pa.ListArray:
    """Rows of distances and ids as Arrow lists; ids of -1 are no neighbours."""
    there = who >= 0
    pairs = pa.StructArray.from_arrays([pa.array(dist[there]), pa.array(who[there])], ["dist", "id"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(1))], pa.int32()), pairs)


class Bounds(NamedTuple):
    """What the driver knows of the index: pivots, their distances, and each block's pivot, least and greatest distance from it, and rows."""

    pivots: np.ndarray
    apart: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def below(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivots, and lower bounds (rounded down) of the distances to each block's rows.

        A row of a block is at least as far as the block's ring is from the row's own distance to the pivot, and, as it is nearer to its pivot than
        to the one nearest to x, beyond the plane midway between the two.
        """
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * x @ self.pivots.T, 0))
        scale = np.abs(x).max(axis=1, initial=0)[:, None] * np.sqrt(x.shape[1]) + np.abs(self.pivots).max(initial=0) * np.sqrt(x.shape[1])
        slack = 1e-6 * scale + 1e-12
        own = d.argmin(1)
        apart = self.apart[own]
        plane = np.where(apart > 0, (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * np.where(apart > 0, apart, 1)), 0)
        plane = np.where(apart > slack, plane, 0) - slack * np.where(apart > slack, 1 + d / np.where(apart > slack, apart, 1), 1)
        at = d[:, self.pivot]
        ring = np.maximum(at - self.high, self.low - at) - slack
        return d, np.maximum(np.maximum(ring, plane[:, self.pivot]), 0)

    def home(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """Blocks to begin with: the most promising ones, as many as it takes to hold k rows."""
        d, least = self.below(x)
        key = least + 1e-3 * (d[:, self.pivot] + self.high)
        out = []
        for row in key:
            few = min(len(row), 16)
            while True:
                order = np.argpartition(row, few - 1)[:few]
                order = order[np.argsort(row[order], kind="stable")]
                held = np.cumsum(self.rows[order])
                if held[-1] >= k or few == len(row):
                    out.append(np.sort(order[: int(np.searchsorted(held, k)) + 1]))
                    break
                few = min(len(row), 4 * few)
        return out

    def left(self, x: np.ndarray, k: int, reach: np.ndarray) -> list[np.ndarray]:
        """Blocks that may hold a row as near as `reach` and that aren't among those of `home`."""
        near = self.below(x)[1] <= reach[:, None]
        return [np.setdiff1d(np.flatnonzero(n), h, assume_unique=True) for n, h in zip(near, self.home(x, k), strict=True)]


class Index(NamedTuple):
    """The blocks' rows (block, row_id, features), written to the shared folder, and their bounds."""

    rows: DataFrame
    bounds: Bounds
    k: int


def _few_copies(train: DataFrame, most: int) -> DataFrame:
    """`train` with at most `most` rows of each vector, those of the least ids: no others are among anyone's nearest.

    Only vectors that repeat more often are sorted, in salted groups first.
    """
    hashed = train.withColumn("h", F.xxhash64("features"))
    heavy = hashed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most).select("h")
    heavy = session.materialize(heavy, "heavy-vectors")
    if heavy.isEmpty():
        return train
    many = hashed.join(heavy, "h", "left_semi").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    for keys in (["features", "salt"], ["features"]):
        many = many.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id"))).where(F.col("r") <= most).drop("r")
    return hashed.join(heavy, "h", "left_anti").select("row_id", "features").unionByName(many.select("row_id", "features"))


def build(train: DataFrame, k: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> Index:
    """Index `train` (row_id, features) for searches of up to k rows besides oneself.

    Rows with null or non-finite entries are nobody's neighbours and left out. Pivots are the rows first in hash
    order, as many as it takes for cells of about a block: a row that visits a block is sent there, so blocks aren't small. Each row goes to its nearest pivot's cell, to a ring of
    distances from it, and, where a ring holds more than `block_rows`, to a part by hash.
    """
    spark = train.sparkSession
    session.ship(spark)
    rows = train.select(F.col("row_id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("features"))
    rows = rows.where(F.col("features").isNotNull() & ~F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = _few_copies(rows, k + 1)
    n = rows.count()
    if not n:
        return Index(rows.select(F.lit(0).alias("block"), "row_id", "features"), Bounds(np.zeros((0, 0)), np.zeros((0, 0)), *(np.zeros(0, "i8") for _ in range(4))), k)
    count = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-n // block_rows)))
    points = np.unique(matrix(rows.orderBy(hash_order("row_id"), "row_id").limit(count).select("features").toArrow()["features"]), axis=0)
    block_rows = max(block_rows, -(-n // MOST_BLOCKS))
    sent = spark.sparkContext.broadcast(points)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        norm = (p * p).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("features"))
            cell = np.empty(len(x), "i4")
            step = max(1, BOUND_VALUES // len(p))
            for a in range(0, len(x), step):
                cell[a : a + step] = (norm[None] - 2 * x[a : a + step] @ p.T).argmin(1)
            r = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("features"), pa.array(cell), pa.array(r)], ["row_id", "features", "cell", "r"])

    placed = session.materialize(rows.mapInArrow(assign, "row_id long, features array<double>, cell int, r double"), "cells")
    marks = F.array(*(F.lit(i / RINGS) for i in range(1, RINGS)))
    # Written, as approximate quantiles depend on the order in which parts arrive, and all uses must see the same.
    cuts = session.materialize(placed.groupBy("cell").agg(F.percentile_approx("r", marks, F.lit(1000)).alias("cuts"), F.count("*").alias("held")), "cuts")
    # Small cells have fewer rings, so that blocks aren't much smaller than `block_rows`.
    own = F.least(F.lit(RINGS), F.ceil(F.col("held") / block_rows))
    placed = placed.join(F.broadcast(cuts), "cell").withColumn("ring", F.floor(F.size(F.filter("cuts", lambda c: c < F.col("r"))) * own / RINGS).cast("int")).drop("cuts", "held")
    # One row a cell and ring, MOST_PIVOTS * RINGS at most.
    rings = placed.groupBy("cell", "ring").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int")).orderBy("cell", "ring").collect()
    first = np.r_[0, np.cumsum([r.parts for r in rings])]
    known = spark.createDataFrame([(r.cell, r.ring, int(f), r.parts) for r, f in zip(rings, first, strict=False)], "cell int, ring int, first int, parts int")
    blocks = placed.join(F.broadcast(known), ["cell", "ring"]).select((F.col("first") + F.pmod(F.xxhash64("row_id"), F.col("parts"))).cast("int").alias("block"), "row_id", "features", "cell", "r")
    blocks = session.materialize(blocks, "blocks")
    stats = blocks.groupBy("block").agg(F.first("cell").alias("cell"), F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).orderBy("block").collect()
    # Parts that got no row keep the bounds of nothing.
    total = int(first[-1])
    pivot, low, high, held = np.zeros(total, "i8"), np.full(total, np.inf), np.full(total, -np.inf), np.zeros(total, "i8")
    for s in stats:
        pivot[s.block], low[s.block], high[s.block], held[s.block] = s.cell, s.low, s.high, s.n
    there = held > 0
    renumber = np.cumsum(there) - 1
    apart = np.sqrt(np.maximum((points**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * points @ points.T, 0))
    bounds = Bounds(points, apart, pivot[there], low[there], high[there], held[there])
    if not there.all():
        numbers = F.broadcast(spark.createDataFrame([(int(b), int(renumber[b])) for b in np.flatnonzero(there)], "block int, number int"))
        blocks = blocks.join(numbers, "block").select(F.col("number").alias("block"), "row_id", "features")
    return Index(blocks.select("block", "row_id", "features"), bounds, k)


def _visits(test: DataFrame, index: Index, again: bool) -> DataFrame:
    """(row_id, features, block): the blocks that each test row meets, first those of `home`, then what `reach` leaves; -1 for all blocks."""
    sent = test.sparkSession.sparkContext.broadcast(tuple(index.bounds))
    k, most = index.k + 1, max(MOST_VISITS, VISITED_SHARE * len(index.bounds.rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(*sent.value)
        step = max(1, BOUND_VALUES // max(1, len(bounds.rows)))
        for b in batches:
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                x = matrix(part.column("features"))
                lists = bounds.left(x, k, part.column("reach").to_numpy(zero_copy_only=False)) if again else bounds.home(x, k)
                if again:
                    lists = [v if len(v) <= most else np.array([-1]) for v in lists]
                at, blocks = np.repeat(np.arange(len(x)), [len(v) for v in lists]), np.concatenate(lists).astype("i4")
                few = max(1, BOUND_VALUES // max(1, x.shape[1]))
                for c in range(0, len(at), few):
                    some = pa.array(at[c : c + few])
                    yield pa.RecordBatch.from_arrays([part.column("row_id").take(some), part.column("features").take(some), pa.array(blocks[c : c + few])], ["row_id", "features", "block"])

    return test.mapInArrow(run, "row_id long, features array<double>, block int")


def _meet(sides: DataFrame, index: Index, exclude_self: bool) -> DataFrame:
    """The nearest rows of each block for each row that visits it. Blocks with many visitors are sent to several tasks, their visitors dealt by hash."""
    from noveltide.operators.distance import k_nearest

    k = index.k
    tasks = sides.groupBy("block").agg(F.ceil(F.count("*") / MEET_ROWS).cast("int").alias("tasks"))
    tasks = session.materialize(tasks, "visits-by-block")
    left = sides.join(F.broadcast(tasks), "block").select("row_id", "features", F.col("block").alias("a"), F.pmod(F.xxhash64("row_id"), F.col("tasks")).cast("int").alias("task_a"))
    right = index.rows.join(F.broadcast(tasks), "block").select("row_id", "features", F.col("block").alias("b"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task_b"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = a["row_id"].to_numpy()
        if not len(ids) or not b.num_rows:
            return pa.table({"row_id": pa.array(ids[:0], pa.int64()), "neighbors": neighbor_lists(np.zeros((0, k)), np.zeros((0, k), "i8"))})
        return pa.table({"row_id": ids, "neighbors": neighbor_lists(*k_nearest(matrix(a["features"]), ids, matrix(b["features"]), b["row_id"].to_numpy(), k, exclude_self))})

    return left.groupBy("a", "task_a").cogroup(right.groupBy("b", "task_b")).applyInArrow(cell, NEIGHBORS)


def _best(found: DataFrame, k: int, few: bool) -> DataFrame:
    """The k nearest of what several blocks gave a row; unless these are few, in 32 groups first, so that no list gets long."""
    for keys in [["row_id"]] if few else [["row_id", "part"], ["row_id"]]:
        found = found.withColumn("part", F.pmod(F.xxhash64("neighbors"), F.lit(32))) if "part" in keys else found
        found = found.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("neighbors"))), 1, k).alias("neighbors"))
    return found


def search(test: DataFrame, index: Index, exclude_self: bool = False) -> DataFrame:
    """The k nearest indexed rows of each test row, ties by id: (row_id, neighbors). Row ids of `test` are distinct.

    Each row first meets its home blocks. The distance of its k-th neighbour there says which other
    blocks could hold a nearer row; it meets these, and no others. Rows that the bounds leave with a large share of the blocks meet them all, packs
    of rows by packs of rows, so that no copy of a row is moved for each block. Rows with null or non-finite entries have no neighbours.
    """
    from noveltide.operators import distance

    session.ship(test.sparkSession)
    # Pairs of packs are megabytes a row.
    session.small_batches(test.sparkSession)
    rows = test.select(F.col("row_id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("features"))
    good = F.col("features").isNotNull() & ~F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    none = F.array().cast("array<struct<dist: double, id: long>>")
    if not len(index.bounds.rows):
        return rows.select("row_id", none.alias("neighbors"))
    first, second = visits(rows.where(good), index, exclude_self)
    everywhere = second.where("block < 0").select("row_id", "features")
    n = everywhere.count()
    if n:
        first = first.join(everywhere.select("row_id"), "row_id", "left_anti")
    out = _best(first.unionByName(_meet(second.where("block >= 0"), index, exclude_self)), index.k, False)
    if n:
        train = distance._packs(index.rows, int(index.bounds.rows.sum()), distance.TRAIN_FILES)
        out = out.unionByName(distance._products(distance._packs(everywhere, n, distance.TEST_FILES), train, index.k, exclude_self))
    return rows.select("row_id").join(out, "row_id", "left").select("row_id", F.coalesce("neighbors", none).alias("neighbors"))


def visits(rows: DataFrame, index: Index, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the home blocks give (row_id, neighbors), and the visits of other blocks (row_id, features, block, -1 for all of them); both written to the shared folder."""
    first = session.materialize(_best(_meet(session.materialize(_visits(rows, index, False), "home-visits"), index, exclude_self), index.k, True), "home-neighbors")
    reach = F.when(F.size("neighbors") >= index.k, F.element_at("neighbors", -1)["dist"]).otherwise(float("inf"))
    bound = rows.join(first, "row_id").select("row_id", "features", reach.alias("reach"))
    return first, session.materialize(_visits(bound, index, True), "other-visits")
