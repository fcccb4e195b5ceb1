"""The pivot index against brute force: ties, copies, outliers, and how few blocks a row meets."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.operators import pivots
from noveltide.operators.distance import nearest


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids, x, strict=True)], "row_id long, features array<double>")


def brute(test, ids, train, train_ids, k, exclude_self):
    out = {}
    for i, q in zip(ids, test, strict=True):
        d = np.sqrt(((train - q) ** 2).sum(1))
        order = [j for j in np.lexsort((train_ids, d)) if not (exclude_self and train_ids[j] == i)][:k]
        out[int(i)] = [(float(d[j]), int(train_ids[j])) for j in order]
    return out


def check(got, want):
    got = {r.row_id: [(n.dist, n.id) for n in r.neighbors] for r in got.collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        assert [j for _, j in got[i]] == [j for _, j in w], i
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in w], atol=1e-9)


def clustered(n, centers, d, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 20, (centers, d))
    return c[rng.integers(centers, size=n)] + rng.normal(0, 1, (n, d))


def test_clustered_rows_meet_under_a_tenth_of_the_blocks(spark):
    x = clustered(4000, 40, 8)
    df = frame(spark, x)
    index = pivots.build(df, 3, pivots=100, block_rows=10)
    first, second = pivots.visits(df, index, True)
    home = pivots._visits(df, index, False)
    met = second.count() + home.count()
    assert len(index.bounds.rows) > 300 and met < 0.1 * len(x) * len(index.bounds.rows)
    check(pivots.search(df, index, True), brute(x, np.arange(4000), x, np.arange(4000), 3, True))


@pytest.mark.parametrize("exclude_self", [True, False])
def test_ties_and_a_vector_of_a_third_of_all_rows(spark, exclude_self):
    rng = np.random.default_rng(2)
    x = np.r_[rng.integers(0, 4, (800, 3)).astype(float), np.ones((400, 3))]
    ids = rng.permutation(1200)
    df = frame(spark, x, ids)
    index = pivots.build(df, 4, block_rows=50)
    assert index.bounds.rows.sum() <= 5 * 64  # of equal vectors, five rows are enough
    check(pivots.search(df, index, exclude_self), brute(x, ids, x, ids, 4, exclude_self))


def test_far_rows_few_rows_and_rows_without_numbers(spark):
    x = np.r_[clustered(200, 5, 4), [[1e7, 0, 0, 0], [-1e7, 1, 1, 1], [1e7, 0, 0, 1e-3]]]
    df = frame(spark, x)
    check(pivots.search(df, pivots.build(df, 2, block_rows=20)), brute(x, np.arange(203), x, np.arange(203), 2, False))
    few = frame(spark, x[:2])
    check(pivots.search(df, pivots.build(few, 5), True), brute(x, np.arange(203), x[:2], np.arange(2), 5, True))
    holes = spark.createDataFrame([(1, [math.nan, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [math.inf, 0.0]), (5, [1.0, 0.0])], "row_id long, features array<double>")
    got = {r.row_id: [n.id for n in r.neighbors] for r in pivots.search(holes, pivots.build(holes, 2), True).collect()}
    assert got == {1: [], 2: [], 3: [5], 4: [], 5: [3]}
    none = pivots.build(df.where("false"), 2)
    assert all(r.neighbors == [] for r in pivots.search(few, none).collect()) and pivots.search(df.where("false"), none).count() == 0


def test_a_block_with_many_visitors_is_met_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "MEET_ROWS", 50)
    x = clustered(600, 3, 4)
    df = frame(spark, x)
    check(nearest(df, df, 2, True, broadcast_values=0), brute(x, np.arange(600), x, np.arange(600), 2, True))


@pytest.mark.parametrize("exclude_self", [False, True])
def test_rows_that_no_bound_helps_are_not_copied_for_each_block(spark, exclude_self):
    """Vectors without structure meet nearly all blocks: they move once, in packs; clustered rows beside them visit their few blocks."""
    rng = np.random.default_rng(11)
    x = np.r_[rng.normal(size=(700, 24)), clustered(300, 3, 24) * 50, np.full((5, 24), 0.25)]
    df = frame(spark, x)
    index = pivots.build(df, 3, pivots=40, block_rows=10)
    _, second = pivots.visits(df, index, exclude_self)
    moved = {r["all"]: r.n for r in second.groupBy((second.block < 0).alias("all")).agg(F.count("*").alias("n")).collect()}
    assert len(index.bounds.rows) > 64 and moved[True] >= 600
    assert second.count() < len(x) * max(pivots.MOST_VISITS, pivots.VISITED_SHARE * len(index.bounds.rows)) / 4
    check(pivots.search(df, index, exclude_self), brute(x, np.arange(1005), x, np.arange(1005), 3, exclude_self))


def test_bounds_hold(spark):
    """No lower bound is over a row's true distance."""
    x = clustered(1500, 30, 6, seed=5)
    df = frame(spark, x)
    index = pivots.build(df, 1, pivots=40, block_rows=5)
    rows = index.rows.collect()
    least = index.bounds.below(x[:100])[1]
    for r in rows:
        assert (least[:, r.block] <= np.sqrt(((x[:100] - np.array(r.features)) ** 2).sum(1)) + 1e-9).all()


@pytest.mark.parametrize("exclude_self", [False, True])
def test_products_of_packs_and_blocks_hold_bounded_memory(spark, monkeypatch, exclude_self):
    """Neither side is sent: packs meet packs, and no product is larger than a block by a block."""
    import tracemalloc

    from noveltide.operators import distance

    monkeypatch.setattr(distance, "PACK", 50)
    monkeypatch.setattr(distance, "MEET", 120)
    monkeypatch.setattr(distance, "TRAIN_BLOCK", 64)
    monkeypatch.setattr(pivots, "build", None)
    x = np.random.default_rng(8).integers(0, 4, (500, 3)).astype(float)
    check(nearest(frame(spark, x), frame(spark, x), 4, exclude_self, broadcast_values=0), brute(x, np.arange(500), x, np.arange(500), 4, exclude_self))
    monkeypatch.undo()
    train = np.random.default_rng(9).standard_normal((60_000, 8))
    tracemalloc.start()
    distance.k_nearest(train[:1024], np.arange(1024), train, np.arange(60_000), 5, exclude_self)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_cuts_are_worked_out_once(spark, monkeypatch):
    """Approximate quantiles depend on the order in which tasks' parts arrive, so both uses of them must see one result."""
    import pandas as pd
    from pyspark.sql import functions as F

    from noveltide.operators.detectors import tabular

    x = np.random.default_rng(3).normal(size=(400, 3))
    want = {r.row_id: r.score for r in tabular.ecod(frame(spark, x)).collect()}

    def shaky(v: pd.Series) -> list:
        return sorted(np.random.default_rng().choice(v, 31).tolist())

    shaky.__annotations__ = {"v": pd.Series, "return": list}
    monkeypatch.setattr(F, "percentile_approx", lambda c, *_: F.pandas_udf(shaky, "array<double>", F.PandasUDFType.GROUPED_AGG)(F.col(c)))
    # Cuts of large tables aren't broadcast.
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = {r.row_id: r.score for r in tabular.ecod(frame(spark, x)).collect()}
    finally:
        spark.conf.set(key, old)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_k_nearest_holds_little_beyond_its_rows():
    """Distances and differences of a bounded number of pairs: with 4096 rows against 16,384, under 96 MB besides what was given."""
    import tracemalloc

    from noveltide.operators import distance

    rng = np.random.default_rng(8)
    test, train = rng.normal(size=(4096, 64)), rng.normal(size=(16_384, 64))
    tracemalloc.start()
    dist, ids = distance.k_nearest(test, np.arange(4096), train, np.arange(16_384), 20, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 96 << 20
    few = np.sqrt(((test[:50, None] - train[None]) ** 2).sum(2))
    assert np.array_equal(ids[:50], np.argsort(few, axis=1, kind="stable")[:, :20])
    assert np.allclose(dist[:50], np.sort(few, axis=1)[:, :20])
