"""K-means whose runs share passes, and the experiments that need many clusters."""

from __future__ import annotations

import numpy as np

from noveltide.operators import cluster
from noveltide.plans import experiments, queries


def test_many_clusters_none_empty_and_no_dearer_than_spark(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4))
    x = np.r_[x, x[:20]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    found = cluster.kmeans_centers(df, [3, 117, 500], 3)
    assert len(found[500]) == 120
    for centers in found.values():
        d = ((x[:, None] - centers[None]) ** 2).sum(2)
        assert len(set(d.argmin(1))) == len(centers)
    label = np.array([r.cluster for r in cluster.kmeans(df, 3, 3).orderBy("row_id").collect()])
    theirs = sum(((x[label == k] - x[label == k].mean(0)) ** 2).sum() for k in range(3))
    assert ((x[:, None] - found[3][None]) ** 2).sum(2).min(1).sum() <= 1.1 * theirs


def test_large_tables_take_as_many_clusters_as_a_null_direction(spark):
    """Beyond 500 clusters the experiment took ten, and other directions."""
    v = spark.range(700).selectExpr("id AS row_id", "array(rand(1), rand(2), rand(3)) AS features")
    assert experiments._clusters(v, None) == 698


def test_the_sweep_takes_every_number_of_clusters(spark, sf, monkeypatch):
    """It took every tenth."""
    monkeypatch.setattr(experiments, "auc_by_clusters", lambda v, counts: list(counts))
    assert queries.QUERIES["cluster_count_sweep"](spark, sf) == list(range(1, 311, 3))
