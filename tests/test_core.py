"""Golden micro-tables and properties of the anomaly operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.functions import scalar
from noveltide.operators import cluster, metrics, nullspace, prep, score
from noveltide.operators.detectors import DETECTORS, forests, get_detector, learned, nets
from noveltide.operators.distance import k_nearest, nearest
from noveltide.plans import reports


def frame(spark, points, **more):
    rows = [(i, [float(x) for x in p], *(v[i] for v in more.values())) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "row_id long, features array<double>" + "".join(f", {k} int" for k in more))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.4, 0), (0.1, 1)], "score double, label int")
    r = metrics.ranking_metrics(df).first()
    # Pairs: 0.9 beats 3, one 0.8 ties 1 and beats 2, 0.1 beats none.
    assert r.auc_roc == pytest.approx((3 + 2.5 + 0) / 9)
    assert r.average_precision == pytest.approx(1 / 3 + (2 / 3) / 3 + (3 / 6) / 3)
    assert (r.youden_j, r.youden_threshold) == (pytest.approx(1 / 3), 0.9)


def test_ranking_metrics_are_null_for_one_class_and_invariant_under_monotone_maps(spark):
    one = spark.createDataFrame([(0.5, 0), (0.7, 0)], "score double, label int")
    assert metrics.ranking_metrics(one).first().auc_roc is None
    df = spark.createDataFrame([(float(i * 7 % 101), int(i % 3 == 0)) for i in range(300)], "score double, label int")
    a, b = metrics.ranking_metrics(df).first(), metrics.ranking_metrics(df.withColumn("score", F.exp(F.col("score") / 50))).first()
    assert a.auc_roc == pytest.approx(b.auc_roc) and a.average_precision == pytest.approx(b.average_precision)
    s = np.array([i * 7 % 101 for i in range(300)])
    y = np.array([i % 3 == 0 for i in range(300)])
    d = s[y][:, None] - s[~y][None]
    assert a.auc_roc == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())


def test_classification_metrics_guard_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "p int, label int")
    r = metrics.classification_metrics(metrics.confusion(df, F.col("p") == 1, F.col("label"))).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (0, 0, 2, 1)
    assert (r.accuracy, r.precision, r.recall, r.f1, r.mcc) == (pytest.approx(2 / 3), 0, 0, 0, 0)


def test_threshold_sweep_agrees_with_direct_counts(spark):
    df = spark.createDataFrame([(i / 37, int(i % 4 == 0)) for i in range(38)], "score double, label int")
    rows = {round(r.threshold, 2): r for r in metrics.threshold_sweep(df, 10).collect()}
    for k in range(11):
        want = [sum(1 for i in range(38) if i / 37 > k / 10 and i % 4 == 0), sum(1 for i in range(38) if i / 37 > k / 10 and i % 4)]
        assert [rows[k / 10].tp, rows[k / 10].fp] == want


@pytest.mark.parametrize("method,want", [("standard", [-1.224744871, 0, 1.224744871]), ("minmax", [0, 0.5, 1]), ("robust", [-1, 0, 1])])
def test_scalers(spark, method, want):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, constant double")
    got = prep.scale(df, ["x", "constant"], method).orderBy("x").collect()
    assert [r.x for r in got] == pytest.approx(want) and {r.constant for r in got} == {0.0}


def test_imputation_ignores_nan_and_infinity(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None), (4, float("nan")), (5, float("inf")), (6, float("-inf"))], "id int, x double")
    assert [r.x for r in prep.impute_mean(df, ["x"]).orderBy("id").collect()] == [1, 3, 2, 2, 2, 2]
    assert prep.impute_mean(df, ["x"], F.col("id") == 2).where("id = 5").first().x == 3


def test_quantile_transform(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    got = {r.x: r.q for r in prep.quantile_transform(df, "x", 11, out_col="q").collect()}
    assert got[0.0] == 0 and got[10.0] == 1 and got[5.0] == pytest.approx(0.5) and got[None] is None


@pytest.mark.parametrize("percent,count", [(0, 0), (29, 2), (41, 4)])
def test_contamination_counts(spark, percent, count):
    df = spark.createDataFrame([(i, int(i >= 10)) for i in range(14)], "id int, y int")
    out = prep.contaminate(df, "id", "y", percent).collect()
    assert len(out) == 10 + count and sum(r.train_label for r in out) == count


def test_contamination_asks_for_enough_anomalies(spark):
    df = spark.createDataFrame([(i, int(i >= 10)) for i in range(14)], "id int, y int")
    with pytest.raises(ValueError):
        prep.contaminate(df, "id", "y", 50)
    assert int(100 * (29 / 100)) == 28  # the order of operations that the share keeps
    assert value(spark, scalar.truncated_share(F.lit(100), 29)) == int(100 * (29 / 100))


def test_split_is_deterministic_and_near_its_share(spark):
    df = spark.range(5000).withColumnRenamed("id", "i")
    a, b = (prep.hash_split(df, "i").where("is_test").select("i") for _ in range(2))
    assert a.exceptAll(b).count() == 0 and abs(a.count() / 5000 - 0.3) < 0.03


def test_scalar_edges(spark):
    nan, inf = float("nan"), float("inf")
    assert value(spark, scalar.ratio(F.lit(1.0), F.lit(0.0))) == inf and np.isnan(value(spark, scalar.ratio(F.lit(0.0), F.lit(0.0))))
    assert value(spark, scalar.nan_to(F.lit(nan))) == 1.0 and value(spark, scalar.nan_to(F.lit(None).cast("double"))) == 1.0
    assert np.isnan(value(spark, scalar.clamp_high(F.lit(nan), 1.0))) and value(spark, scalar.clamp_high(F.lit(3.0), 1.0)) == 1.0
    assert [value(spark, scalar.average_path_length(F.lit(n))) for n in (0, 1, 2)] == [0, 0, 1]
    assert value(spark, scalar.average_path_length(F.lit(256))) == pytest.approx(float(forests.path_length(256)))
    assert value(spark, scalar.gelu(F.lit(0.0))) == 0 and value(spark, scalar.relu(F.lit(-2.0))) == 0
    assert value(spark, scalar.contrast_normalize(F.array(*map(F.lit, (1.0, 1.0))))) == [0, 0]


def test_nearest_agrees_with_brute_force_on_both_paths(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(60, 5))
    b[7] = a[3]
    test, train = frame(spark, a), frame(spark, b)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for limit in (10**9, 0):
        got = {r.row_id: r.neighbors for r in nearest(test, train, 4, broadcast_values=limit).collect()}
        for i in range(40):
            want = sorted((x, j) for j, x in enumerate(d[i]))[:4]
            assert [n.id for n in got[i]] == [j for _, j in want]
            assert [n.dist for n in got[i]] == pytest.approx([x for x, _ in want], abs=1e-12)
    dist, ids = k_nearest(a, np.arange(40), a[:3], np.arange(3), 5, True)
    assert (ids[0] >= 0).sum() == 2 and np.isinf(dist[0][2:]).all()


def test_nearest_orders_more_ties_than_candidates_by_id(spark, monkeypatch):
    rng = np.random.default_rng(4)
    b = rng.normal(size=(600, 5)) + 100
    b[rng.permutation(600)[:300]] = b[0]
    test, train = frame(spark, b[:40]), frame(spark, b)
    d = np.sqrt(((b[:40, None] - b[None]) ** 2).sum(2))
    monkeypatch.setattr("noveltide.operators.pivots.MEET_ROWS", 250)
    for limit in (10**9, 0):
        for self_too in (True, False):
            got = {r.row_id: [n.id for n in r.neighbors] for r in nearest(test, train, 3, exclude_self=not self_too, broadcast_values=limit).collect()}
            assert got == {i: [j for _, j in sorted((x, j) for j, x in enumerate(d[i]) if self_too or j != i)[:3]] for i in range(40)}


def test_nearest_of_many_features_compares_exact_distances():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1030, 2000)) * 100
    dist, ids = k_nearest(x, np.arange(1030), x, np.arange(1030), 20, False)
    assert (dist[:, 0] == 0).all() and (ids[:, 0] == np.arange(1030)).all()


def test_nearest_without_train_rows(spark):
    test = frame(spark, [[0, 0]])
    assert nearest(test, test.limit(0), 2).first().neighbors == []


def test_nn_ratio_handles_a_zero_radius(spark):
    train = frame(spark, [[0, 0], [0, 0]])
    test = frame(spark, [[0, 0], [1, 0]])
    got = {r.row_id: (r.p_anomaly, r.p_normal) for r in score.nn_ratio(test, train).collect()}
    assert got == {0: (1.0, 1.0), 1: (1.0, 0.0)}
    got = {r.row_id: r.p_anomaly for r in score.nn_ratio(test, train, floor=1e-8).collect()}
    assert got == {0: 0.0, 1: 1.0}


def test_nn_ratio_is_invariant_under_rotation(spark):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(30, 4)), np.linalg.qr(rng.normal(size=(4, 4)))[0]
    scores = [{r.row_id: r.p_anomaly for r in score.nn_ratio(frame(spark, v), frame(spark, v[:15] + 0.1)).collect()} for v in (x, x @ q)]
    shift = {r.row_id: r.p_anomaly for r in score.nn_ratio(frame(spark, x @ q), frame(spark, (x[:15] + 0.1) @ q)).collect()}
    assert scores[0] == pytest.approx(shift)


def test_logistic_centroid_with_one_class_is_constant(spark):
    df = frame(spark, [[0, 0], [2, 0]], c=[0, 0])
    assert {round(r.p_near, 9) for r in score.logistic_centroid(df, df, "c").collect()} == {round(1 / (1 + np.exp(-1)), 9)}


def test_class_mean_radius(spark):
    df = frame(spark, [[0, 0], [2, 0], [9, 9]], c=[0, 0, 1])
    got = {r.row_id: r.p_normal for r in score.class_mean_radius(frame(spark, [[1, 0], [2, 0], [1.5, 0], [50, 50]]), df, "c").collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.0, 2: 0.5, 3: 0.0})


def test_scatter_agrees_with_numpy(spark):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(50, 6)) + 1000, rng.integers(0, 4, 50)
    s = nullspace.scatter(frame(spark, x, cluster=c.tolist()))
    within = sum((x[c == k] - x[c == k].mean(0)).T @ (x[c == k] - x[c == k].mean(0)) for k in range(4)) / 50
    assert np.allclose(s.total, np.cov(x.T, bias=True)) and np.allclose(s.within, within) and np.allclose(s.total, s.within + s.between)


def test_null_directions_collapse_classes_and_keep_the_whole_apart(spark):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(12, 20)), np.repeat(np.arange(4), 3)
    p = nullspace.null_directions(nullspace.scatter(frame(spark, x, cluster=c.tolist())))
    # Fewer rows than features: rank of the total is 11, of the within scatter 8.
    assert (p.rank_total, p.rank_within, p.null_size) == (11, 8, 3)
    z = x @ p.w
    assert max(np.ptp(z[c == k], axis=0).max() for k in range(4)) < 1e-8 and np.ptp(z, axis=0).min() > 1e-3


def test_no_null_direction_is_an_error_not_a_score(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, rng.normal(size=(50, 2)), cluster=[0] * 50)
    p = nullspace.null_directions(nullspace.scatter(df))
    assert p.w.shape == (2, 0)
    with pytest.raises(ValueError):
        nullspace.project(df, p.w)


def test_regularized_directions(spark):
    rng = np.random.default_rng(8)
    c = np.repeat(np.arange(3), 10)
    p = nullspace.regularized_directions(nullspace.scatter(frame(spark, rng.normal(size=(30, 5)) + c[:, None], cluster=c.tolist())))
    assert p.w.shape == (5, 2) and np.allclose(p.w.T @ p.w, np.eye(2))


def test_kmeans_takes_no_more_clusters_than_points(spark):
    df = frame(spark, [[0, 0], [0, 0], [5, 5]])
    got = {r.row_id: r.cluster for r in cluster.kmeans(df, 10, seeds=1).collect()}
    assert got[0] == got[1] != got[2]


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_detectors_rank_far_points_first(spark, name):
    rng = np.random.default_rng(9)
    inner, outer = rng.normal(size=(150, 6)), rng.normal(size=(6, 6)) + 7
    test = frame(spark, np.vstack([inner[:60], outer]), label=[0] * 60 + [1] * 6)
    train = test if name == "DevNet" else frame(spark, inner, label=[0] * 150)
    few = {"DIF": {"members": 4, "hidden": (50,)}, "DASVDD": {"epochs": 10, "trials": 2}, "NeuTraLAD": {"epochs": 5}, "CBLOF": {"clusters": 3}, "LOF": {"k": 15}, "COF": {"k": 15}, "SOD": {"k": 15}}
    got = get_detector(name)(test, train, **few.get(name, {})).join(test, "row_id")
    assert got.count() == 66
    auc = metrics.ranking_metrics(got).first().auc_roc
    assert auc > (0.5 if name in ("SOD", "COF") else 0.9), auc


def test_unknown_detector():
    with pytest.raises(ValueError):
        get_detector("nothing")


def test_nets_have_right_gradients():
    rng = np.random.default_rng(10)
    net = nets.Net([3, 4, 2], ["tanh", "sigmoid"], rng)
    x, target = rng.normal(size=(5, 3)), rng.normal(size=(5, 2))
    loss = lambda: float(((net(x) - target) ** 2).sum())
    net.backward(2 * (net.forward(x) - target))
    for p, g in zip((*net.w, *net.b), (*net.gw, *net.gb), strict=True):
        at = tuple(0 for _ in p.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7)


def test_reports(spark):
    rows = spark.createDataFrame([("a", "x", 0.9), ("a", "x", 0.7), ("b", "x", 0.95), ("c", "x", 0.99)], "Model string, d string, m double")
    top = spark.createDataFrame([("x", 0.92)], "d string, m double")
    assert {r.Model: r.best for r in reports.best_per_model(rows, "m", "d").collect()} == {"a": 0.9, "b": 0.95, "c": 0.99}
    got = {r.Model: r.adjusted for r in reports.below_proposed(rows, top, "m", "d").collect()}
    assert got == pytest.approx({"a": 0.9, "b": 0.92 * 1.05, "c": 0.92 * 1.05})


def test_contrast_normalize_folds_each_row_a_fixed_number_of_times(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 6.0])], "row_id long, features array<double>")
    out = df.select(scalar.contrast_normalize(F.col("features")).alias("c"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2
    assert [round(x, 9) for x in out.first().c] == [-1.0, -0.5, 1.5]
