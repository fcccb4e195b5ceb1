"""Queries that SQL can't express, held against plain NumPy versions."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.operators import cluster, nullspace, prep, quantiles, score
from noveltide.operators.detectors import tabular
from noveltide.operators.detectors.learned import pca
from noveltide.plans import experiments, queries

SIZES = ["/root/testdata/sf0.001", "/root/testdata/sf0.1"]


def rows(df, *columns):
    return {r.row_id: [r[c] for c in columns] for r in df.collect()}


def vectors(spark, sf):
    v = queries.vectors(spark, sf).orderBy("row_id").collect()
    return np.array([r.row_id for r in v]), np.array([r.features for r in v]), np.array([r["class"] for r in v])


def distances(a, b):
    return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(2), 0)) if len(a) * len(b) < 200_000 else np.stack([np.sqrt(((x - b) ** 2).sum(1)) for x in a])


def null_basis(x, labels, rtol=1e-10):
    """Null projecting directions by singular values of the centred rows."""
    t = x - x.mean(0)
    w = np.concatenate([x[labels == c] - x[labels == c].mean(0) for c in np.unique(labels)])
    u, s, _ = np.linalg.svd(t.T, full_matrices=False)
    q = u[:, s**2 > rtol * s[0] ** 2]
    _, s2, vt = np.linalg.svd(w @ q, full_matrices=True)
    s2 = np.r_[s2, np.zeros(vt.shape[0] - len(s2))]
    return q @ vt[s2**2 <= rtol * s[0] ** 2].T


@pytest.mark.parametrize("sf", SIZES)
def test_nullspace_pipeline_equals_numpy(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no table")
    ids, x, y = vectors(spark, sf)
    train, p = queries._directed(queries.normal(queries.vectors(spark, sf)), 10)
    train = train.cache()
    label = {r.row_id: r.cluster for r in train.collect()}
    own = np.isin(ids, list(label))
    labels = np.array([label[i] for i in ids[own]])
    w = null_basis(x[own], labels)
    assert p.null_size == w.shape[1] > 0 and p.w.shape == w.shape
    got = rows(score.nn_ratio(nullspace.project(queries.vectors(spark, sf), p.w), nullspace.project(train, p.w)), "p_anomaly")
    z = x @ w
    near = distances(z[own], z[own])
    np.fill_diagonal(near, np.inf)
    want = np.minimum(distances(z, z[own]).min(1) / near.min(1).max(), 1)
    assert np.allclose([got[i][0] for i in ids], want, atol=1e-5)
    d = queries.QUERIES["nullspace_diagnostics"](spark, sf).first()
    assert d.null_size == w.shape[1] and d.rank_total == np.linalg.matrix_rank(x[own] - x[own].mean(0))
    train.unpersist()


@pytest.mark.parametrize("sf", SIZES)
def test_regularized_directions_equal_numpy(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no table")
    ids, x, y = vectors(spark, sf)
    got = rows(queries.QUERIES["regularized_projection_score"](spark, sf), "p_anomaly")
    means = np.array([x[y == c].mean(0) for c in np.unique(y)])
    n = np.array([(y == c).sum() for c in np.unique(y)])
    within = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in np.unique(y)) / len(x)
    few = np.linalg.eigh(within + 1e-4 * np.eye(x.shape[1]))[1][:, : len(means) - 1]
    s = nullspace.scatter(queries.vectors(spark, sf), "class")
    away = (means - x.mean(0)) * np.sqrt(n)[:, None]
    assert np.allclose(s.within, within) and np.allclose(s.between, away.T @ away / len(x)) and np.allclose(s.total, s.within + s.between)
    z = x @ few
    normal = z[y == 0]
    center = normal.mean(0)
    radius = np.sqrt(((normal - center) ** 2).sum(1)).max()
    want = 1 - np.maximum(1 - np.sqrt(((z - center) ** 2).sum(1)) / (radius + 1e-9), 0)
    assert np.allclose([got[i][0] for i in ids], want, atol=1e-5)


def test_directions_fall_back_where_there_is_no_null_space(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=3).tolist(), i % 4) for i in range(80)]
    s = nullspace.scatter(spark.createDataFrame(data, "row_id long, features array<double>, cluster int"))
    p = nullspace.directions(s)
    assert p.null_size == 0 and p.w.shape == (3, 3) and np.allclose(p.w, nullspace.regularized_directions(s).w)


def test_scatter_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 1, (60, 7))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "row_id long, features array<double>, cluster int").repartition(5)
    monkeypatch.setattr(nullspace, "BLOCK_VALUES", 15)
    s = nullspace.scatter(df)
    assert np.allclose(s.total, np.cov(x.T, bias=True)) and np.allclose(s.means, [x[k::3].mean(0) for k in range(3)])


def test_principal_components_equal_numpy(spark, sf):
    ids, x, _ = vectors(spark, sf)
    got = rows(queries.QUERIES["principal_components"](spark, sf), "c0", "c1", "c2")
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    w = vt[:3].T
    w = w * np.sign(w[np.abs(w).argmax(0), np.arange(3)])
    assert np.allclose([got[i] for i in ids], (x - x.mean(0)) @ w, atol=1e-5)


def test_pca_detector_equals_numpy(spark, sf):
    ids, x, y = vectors(spark, sf)
    v = queries.vectors(spark, sf)
    got = rows(pca(v, queries.normal(v)), "score")
    t = x[y == 0]
    std = np.where(t.std(0) > 1e-12, t.std(0), 1)
    values, w = np.linalg.eigh(np.cov(t.T, bias=True) / np.outer(std, std))
    values, w = values[values > 1e-9 * values.max()], w[:, values > 1e-9 * values.max()]
    want = (np.abs(((x - t.mean(0)) / std) @ w) / (values / values.sum())).sum(1)
    assert np.allclose([got[i][0] for i in ids], want, rtol=1e-4)


def neighbours(x, k):
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def test_subspace_detector_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(50, 4)) * [1, 1, 0.05, 0.05], rng.normal(4, 1, (4, 4))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    got = rows(tabular.sod(df, k=8, reference=5), "score")
    near, _ = neighbours(x, 8)
    sets = [set(r.tolist()) for r in near]
    for i in range(len(x)):
        shared = sorted(((-len(sets[i] & sets[j]), j) for j in range(len(x)) if j != i and sets[i] & sets[j]))[:5]
        r = x[[j for _, j in shared]]
        flat = r.var(0) < 0.8 * r.var(0).mean()
        want = np.sqrt((((x[i] - r.mean(0)) ** 2)[flat]).sum()) / max(1, flat.sum())
        assert got[i][0] == pytest.approx(want), i


def test_connectivity_detector_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    got = rows(tabular.cof(df, k=6), "score")
    near, _ = neighbours(x, 6)

    def chain(i):
        joined, left, total, r = [i], list(near[i]), 0.0, 7
        for step in range(1, r):
            best, j = min((min(np.linalg.norm(x[a] - x[b]) for a in joined), left.index(b)) for b in left)
            total += 2 * (r - step) / (r * (r - 1)) * best
            joined.append(left.pop(j))
        return total

    ac = [chain(i) for i in range(len(x))]
    for i in range(len(x)):
        assert got[i][0] == pytest.approx(ac[i] / (np.mean([ac[j] for j in near[i]]) + 1e-10)), i


def test_cluster_detector_equals_numpy(spark, sf):
    ids, x, y = vectors(spark, sf)
    v = queries.vectors(spark, sf)
    train = queries.normal(v)
    got = rows(tabular.cblof(v, train, clusters=3), "score")
    label = {r.row_id: r.cluster for r in cluster.kmeans(train, 3, seeds=1).collect()}
    c = np.array([label[i] for i in ids[y == 0]])
    t = x[y == 0]
    sizes = sorted(((int((c == k).sum()), k) for k in np.unique(c)), key=lambda s: (-s[0], s[1]))
    large, seen = [], 0
    for j, (n, k) in enumerate(sizes):
        large.append(k)
        seen += n
        if seen >= 0.9 * len(t) or (j + 1 < len(sizes) and n >= 5 * sizes[j + 1][0]):
            break
    want = distances(x, np.array([t[c == k].mean(0) for k in large])).min(1)
    assert np.allclose([got[i][0] for i in ids], want, rtol=1e-6)


@pytest.mark.parametrize("ranges", [2, 128])
def test_exact_quantiles_equal_numpy(spark, monkeypatch, ranges):
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=400).round(1), "b": np.r_[np.zeros(50), rng.normal(size=3)], "c": np.array([2.5])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("d", None)], "k string, x double")
    qs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: r.q for r in quantiles.exact_quantiles(df, "k", "x", qs).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        assert got[k] == pytest.approx(np.quantile(v, qs).tolist())
    assert quantiles.column_quantiles(df.limit(0), F.col("x"), qs).count() == 0


def test_global_rank(spark):
    df = spark.createDataFrame([(k * 7 % 101, k % 3) for k in range(101)], "a int, b int")
    got = quantiles.global_rank(df, [F.desc("b"), F.asc("a")], "r").collect()
    want = sorted(((r.a, r.b) for r in got), key=lambda p: (-p[1], p[0]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.r)] == want and sorted(r.r for r in got) == list(range(1, 102))


@pytest.mark.parametrize("method", ["standard", "minmax", "robust", "quantile", "normalizer"])
def test_vector_scalers_equal_column_scalers(spark, method):
    rng = np.random.default_rng(6)
    x = np.c_[rng.normal(size=60), rng.integers(0, 4, 60), np.ones(60)]
    df = spark.createDataFrame([(i, v.tolist(), *v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>, a double, b double, c double")
    fit = F.col("row_id") < 40
    got = rows(prep.scale_vectors(df, method, fit), "features")
    if method == "normalizer":
        want = {i: (v / np.linalg.norm(v)).tolist() for i, v in enumerate(x)}
    elif method == "quantile":
        for c in "abc":
            df = prep.quantile_transform(df, c, fit_on=F.col("row_id") < 40)
        want = rows(df, "a", "b", "c")
    else:
        want = rows(prep.scale(df, ["a", "b", "c"], method, fit), "a", "b", "c")
    for i in range(60):
        assert got[i][0] == pytest.approx(want[i] if isinstance(want[i], list) else list(want[i]))


def test_experiments_give_rows_of_metrics(spark):
    rng = np.random.default_rng(7)
    data = [(i, rng.normal(size=4).tolist(), 0) for i in range(120)] + [(200 + i, rng.normal(6, 1, 4).tolist(), 1) for i in range(40)]
    v = spark.createDataFrame(data, "row_id long, features array<double>, label int").cache()
    cells = [(experiments.nullspace_experiment, ("standard", 3, 3, 2)), (experiments.knn_experiment, ("minmax", 0, 2, 3, 2))]
    out = experiments.results(v, cells, "scaler string, nCluster int, noise_percentage int").collect()
    assert [(r.scaler, r.nCluster, r.noise_percentage) for r in out] == [("standard", 3, 3), ("minmax", 2, 0)]
    assert out[0].AUCROC > 0.9 and all(0 <= r["F1 Score"] <= 1 and r["Time Train"] > 0 and r["Time Test"] > 0 for r in out)
    row = experiments.results(v, [(experiments.detector_experiment, ("KNN", "robust", 0))], "Model string, scaled string, noise_percentage int").first()
    assert row.Model == "KNN" and row.AUCROC > 0.95
    series = experiments.auc_by_clusters(v, (2, 118)).collect()
    assert [r.clusters for r in series] == [2, 118] and series[0].null_size == 0
    v.unpersist()
