"""Studies: resumed where they stopped, failed cells reported, full grids."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.operators import cluster, prep
from noveltide.plans import experiments, queries
from noveltide.sources import results


def table(spark):
    rng = np.random.default_rng(7)
    data = [(i, rng.normal(size=4).tolist(), 0) for i in range(120)] + [(200 + i, rng.normal(6, 1, 4).tolist(), 1) for i in range(40)]
    return spark.createDataFrame(data, "row_id long, features array<double>, label int")


KEYS = "Model string, scaled string, noise_percentage int"


def test_a_study_goes_on_where_it_was_and_reports_failed_cells(spark, tmp_path, monkeypatch):
    v, path, ran = table(spark), f"{tmp_path}/study", []
    real = experiments.detector_experiment

    def counted(v, name, scaler, noise):
        ran.append((name, scaler, noise))
        return real(v, name, scaler, noise)

    cells = [(counted, ("KNN", "minmax", 0)), (counted, ("NONE", "minmax", 0)), (counted, ("PCA", "minmax", 5))]
    out, failed = experiments.study(v, cells, path, KEYS)
    assert sorted((r.Model, r.noise_percentage) for r in out.collect()) == [("KNN", 0), ("PCA", 5)]
    assert [a for a, _ in failed] == [("NONE", "minmax", 0)] and "KeyError" in failed[0][1]
    again, failed = experiments.study(v, [*cells, (counted, ("PCA", "robust", 0))], path, KEYS)
    assert sorted(ran) == sorted([("KNN", "minmax", 0), ("NONE", "minmax", 0), ("NONE", "minmax", 0), ("PCA", "minmax", 5), ("PCA", "robust", 0)])
    assert again.count() == 3 and len(failed) == 1
    header = open(f"{path}/{results.HEADER}").read()
    assert header.startswith("Model,scaled,noise_percentage,AUCROC,AUCPR")


def test_cells_that_run_at_a_time_give_what_single_cells_give(spark):
    v = table(spark)
    cells = [(experiments.detector_experiment, ("PCA", s, n)) for s in ("minmax", "robust") for n in (0, 3)]
    got = [tuple(r)[:10] for r in experiments.results(v, cells, KEYS).collect()]
    want = [experiments.detector_experiment(v, *args)[:10] for _, args in cells]
    assert got == [pytest.approx(w) for w in want]


def test_directions_are_named_and_clusters_found(spark):
    v = table(spark)
    few = experiments.nullspace_experiment(v, "minmax", 0, 2, 2, True)
    many = experiments.nullspace_experiment(v, "minmax", 0, None, 2, True)
    assert few[-1] == "regularised" and many[-1] == "null" and many[1] > 10


def test_pseudo_labels_do_not_depend_on_cluster_numbers(spark, monkeypatch):
    v = table(spark)
    real = cluster.kmeans
    got = []
    for turn in (False, True):
        numbers = "1 - cluster" if turn else "cluster"
        monkeypatch.setattr(experiments.cluster, "kmeans", lambda df, k, n=numbers, **o: real(df, k, **o).withColumn("cluster", F.expr(n)))
        got.append(experiments.knn_experiment(v, "minmax", 5, 2, 3, 2)[:10])
    assert got[0] == pytest.approx(got[1])


def test_kmeans_finds_the_cheapest_partition(spark):
    """Of ten runs the best has the cost of the known partition, and equal points count once."""
    rng = np.random.default_rng(3)
    centers = np.array([[0, 0], [10, 0], [0, 10], [12, 12], [-9, 4]], "f8")
    x = np.concatenate([c + rng.normal(0, 0.5, (30, 2)) for c in centers])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    label = np.array([r.cluster for r in cluster.kmeans(df, 5).orderBy("row_id").collect()])
    assert all(len(set(label[30 * k : 30 * k + 30])) == 1 for k in range(5)) and len(set(label)) == 5
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(20)], "row_id long, features array<double>")
    assert {r.cluster for r in cluster.kmeans(same, 7, seeds=2).collect()} == {0, 1}


def test_mixture_separates_clouds(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(12, [1, 3], (60, 2)), rng.normal([0, 20], 1, (60, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    label = np.array([r.cluster for r in cluster.gaussian_mixture(df, 3).orderBy("row_id").collect()])
    assert all(len(set(label[60 * k : 60 * k + 60])) == 1 for k in range(3)) and len(set(label)) == 3


def test_study_by_outlier_mode_equals_numpy(spark, sf):
    got = {(r.Model, r.outlier_mode, r.scaler): r.AUCROC for r in queries.QUERIES["outlier_mode_study"](spark, sf).collect()}
    assert len(got) == 12
    v = prep.hash_split(queries.vectors(spark, sf), "row_id").collect()
    x, y, c, t = (np.array([r[k] for r in v]) for k in ("features", "label", "class", "is_test"))
    train = (y == 0) & ~t
    for scaler in ("minmax", "standard"):
        z = x[train]
        z = (x - z.min(0)) / (z.max(0) - z.min(0)) if scaler == "minmax" else (x - z.mean(0)) / z.std(0)
        for k, mode in enumerate(experiments.OUTLIER_MODES):
            test = ((y == 0) & t) | ((y == 1) & (c % 3 == k))
            s = np.sort(np.sqrt(((z[test][:, None, :] - z[train][None]) ** 2).sum(2)), 1)[:, 4]
            a, b = s[y[test] == 1], s[y[test] == 0]
            auc = ((a[:, None] > b[None]).sum() + 0.5 * (a[:, None] == b[None]).sum()) / (len(a) * len(b))
            assert got["KNN", mode, scaler] == pytest.approx(auc, abs=1e-6)


def test_studies_by_mode_are_resumed_by_mode_and_scaler(spark, tmp_path):
    v = table(spark).withColumn("split", F.when((F.col("label") == 0) & (F.col("row_id") < 80), "train").otherwise("test")).withColumn("scaler", F.lit("minmax"))
    v = v.crossJoin(spark.createDataFrame([("local",), ("global",)], "outlier_mode string"))
    cells = [(experiments.outlier_experiment, (mode, "minmax", 3, 1)) for mode in ("local", "global", "cluster")]
    keys, more = "outlier_mode string, scaler string", "nCluster int, "
    out, failed = experiments.study(v, cells, f"{tmp_path}/study", keys + ", " + more.rstrip(", "))
    assert {(r.outlier_mode, r.scaler, r.nCluster) for r in out.collect()} == {("local", "minmax", 3), ("global", "minmax", 3)}
    assert [a[0] for a, _ in failed] == ["cluster"]
    assert all(r.AUCROC > 0.9 for r in out.collect())
