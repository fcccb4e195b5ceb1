"""Forests and histograms over all rows, against brute-force draws, serial builds and NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noveltide.operators.detectors import forests, learned
from noveltide.plans import queries


def frame(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "row_id long, features array<double>")


def normal_rows(n, d=4, seed=1):
    return np.random.default_rng(seed).normal(size=(n, d))


@pytest.mark.parametrize("weighted", [False, True])
def test_samples_are_the_rows_of_the_least_keys(spark, weighted):
    df = frame(spark, normal_rows(700)).repartition(7)
    w = F.when(F.col("row_id") % 5 == 0, 0.0).otherwise(1.0 + F.col("row_id") % 3 * 10) if weighted else F.lit(1.0)
    got = {}
    for r in forests.draw(df, 12, 40, seed=9, weight=w if weighted else None).collect():
        got.setdefault(r.sample, []).append((r.place, r.row_id))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(9), F.col("s"), F.col("row_id")), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = df.where(w > 0).crossJoin(spark.range(12).select(F.col("id").cast("int").alias("s"))).withColumn("key", -F.log(unit) / w)
    best = keyed.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("key"))).where("r <= 40").collect()
    want = {}
    for r in best:
        want.setdefault(r.s, []).append((r.r, r.row_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(got) == 12
    if weighted:
        drawn = [i for v in got.values() for _, i in v]
        assert not any(i % 5 == 0 for i in drawn) and np.mean([i % 3 == 2 for i in drawn]) > 0.5


def test_a_short_draw_is_widened_and_small_tables_are_taken_whole(spark, monkeypatch):
    monkeypatch.setattr(forests, "MARGIN", -3.0)
    df = frame(spark, normal_rows(50))
    sizes = {r.sample: r["count"] for r in forests.draw(df, 5, 30).groupBy("sample").count().collect()}
    assert sizes == dict.fromkeys(range(5), 30)
    assert forests.draw(df, 3, 80).count() == 150
    assert forests.draw(df.where("false"), 3, 80).count() == 0


def test_trees_equal_a_serial_build(spark):
    drawn = forests.draw(frame(spark, normal_rows(900)), 6, 64, seed=3)
    rows = {}
    for r in drawn.collect():
        rows.setdefault(r.sample, []).append((r.place, list(r.features)))
    for k, tree in enumerate(forests.collected(forests.grow(drawn, seed=3))):
        want = forests.Tree.grow(np.array([f for _, f in sorted(rows[k])]), np.random.default_rng([3, k]))
        for part in ("feature", "threshold", "left", "right", "path"):
            assert np.array_equal(getattr(tree, part), getattr(want, part))


def test_isolation_forest_scores_equal_plain_walks(spark):
    x = np.r_[normal_rows(400), [[9, 9, 9, 9]]]
    df = frame(spark, x)
    forest = forests.fit_forest(df, 20, 64, seed=5)
    got = {r.row_id: r.score for r in forests.isolation_forest(df, df, 20, 64, seed=5).collect()}

    def walk(tree, v, node=0):
        while tree.feature[node] >= 0:
            node = tree.left[node] if v[tree.feature[node]] < tree.threshold[node] else tree.right[node]
        return tree.path[node]

    c = 2 * (np.log(63) + 0.5772156649015329) - 2 * 63 / 64
    for i in (0, 17, 399, 400):
        assert got[i] == pytest.approx(2 ** (-np.mean([walk(t, x[i]) for t in forest.trees]) / c), rel=1e-12)
    assert max(got, key=got.get) == 400


def test_equal_rows_and_one_row(spark):
    for x in (np.ones((30, 3)), np.ones((1, 3))):
        df = frame(spark, x)
        assert len({r.score for r in forests.isolation_forest(df, df, 5).collect()}) == 1
        assert all(np.isfinite(r.score) for r in forests.deep_isolation_forest(df, df, members=2, hidden=(10,)).collect())
    with pytest.raises(ValueError, match="no rows"):
        forests.isolation_forest(df, df.where("false"))


def test_deep_forest_is_standardised_by_all_rows(spark):
    x = normal_rows(1500, 5)
    df = frame(spark, x).repartition(6)
    net = forests.Representation.make(5, 3, (20,), 7, np.random.default_rng(42))
    mean, std = forests._moments(df, net, 7)
    for k in range(3):
        z = net(x, k)
        assert np.allclose(mean[k], z.mean(0), atol=1e-9) and np.allclose(std[k], z.std(0), atol=1e-7)
    far = frame(spark, np.r_[x, np.full((1, 5), 8.0)])
    got = {r.row_id: r.score for r in forests.deep_isolation_forest(far, df, members=6, hidden=(20,)).collect()}
    assert got[1500] > np.quantile(list(got.values()), 0.95)


def test_loda_equals_numpy_over_all_rows(spark):
    x = np.r_[normal_rows(3000, 6), np.full((500, 6), 0.25)]
    df = frame(spark, x).repartition(9)
    model = learned.fit_loda(df, cuts=30, bins=12, seed=4)
    z = x @ model.w
    for k in range(30):
        edges = np.histogram_bin_edges(z[:, k], 12)
        assert np.allclose(model.edges[k], edges, rtol=1e-12)
        assert np.allclose(model.density[k], (np.histogram(z[:, k], model.edges[k])[0] + 1e-12) / len(z), atol=1e-12)
    got = {r.row_id: r.score for r in learned.loda(df, df, 30, 12, 4).collect()}
    want = -np.mean([np.log((np.histogram(z[:, k], model.edges[k])[0] + 1e-12)[learned.bins_of(z[:, k], model.edges[k])] / len(z)) for k in range(30)], 0)
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)
    assert max(got.values()) < 27  # no training row is outside of the range


def test_the_bound_of_nets_is_a_parameter(spark, monkeypatch):
    seen = []
    detect = learned.fitted(lambda x, **_: seen.append(len(x)) or (lambda v: np.zeros(len(v))))
    df = frame(spark, normal_rows(60))
    detect(df, df, sample_rows=25).count(), detect(df, df).count()
    assert seen == [25, 60]


@pytest.mark.parametrize("name", ["detector_iforest", "detector_loda", "detector_dif"])
def test_registered_detectors_tell_classes_apart_a_little(spark, sf, name, monkeypatch):
    v = queries.vectors(spark, sf).select("row_id", "label").toPandas().set_index("row_id").label
    s = queries.QUERIES[name](spark, sf).toPandas().set_index("row_id").score
    own, other = s[v[v == 0].index].to_numpy(), s[v[v == 1].index].to_numpy()
    assert (other[:, None] > own[None]).mean() + 0.5 * (other[:, None] == own[None]).mean() > 0.5
