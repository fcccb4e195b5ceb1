"""Distributed optimisation against a full-batch NumPy run."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.operators import optimize
from noveltide.plans import queries


def newton(x, y, penalty):
    """The optimum by Newton steps, and its objective."""
    x = np.c_[x, np.ones(len(x))]
    damp = np.r_[np.full(x.shape[1] - 1, penalty), 0.0]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / len(x) + damp * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(damp) + 1e-12 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    z = x @ w
    return w, float((np.logaddexp(0, z) - y * z).mean() + (damp * w * w).sum() / 2)


def plain(x, y, penalty, epochs):
    """The same steps over one array."""
    class One:
        pass

    losses = []
    w, pairs = np.zeros(x.shape[1] + 1), []
    damp = np.r_[np.ones(x.shape[1]), 0.0]

    def evaluate(w):
        loss, g = optimize.logistic(x, y, w)
        return loss.mean() + penalty / 2 * (damp * w * w).sum(), g / len(x) + penalty * damp * w, loss.sum()

    value, g, total = evaluate(w)
    for epoch in range(epochs):
        losses.append(total)
        if np.linalg.norm(g) < 1e-7 or epoch == epochs - 1:
            break
        way = -optimize._direction(g, pairs)
        step = 1.0 if pairs else 1.0 / max(1.0, np.linalg.norm(g))
        while (after := evaluate(w + step * way))[0] > value + 1e-4 * step * (g @ way) and step >= 1e-10:
            step /= 2
        if after[0] >= value:
            break
        moved, turned = step * way, after[1] - g
        if moved @ turned > 1e-12 * (turned @ turned):
            pairs = [*pairs, (moved, turned)][-optimize.MEMORY :]
        w, (value, g, total) = w + moved, after
    return losses


def table(spark, x, y):
    return spark.createDataFrame([(i, list(map(float, v)), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "row_id long, features array<double>, label int").repartition(7)


@pytest.mark.parametrize("n,d", [(300, 3), (2500, 8)])
def test_losses_by_epoch_and_optimum(spark, n, d):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) * np.linspace(0.3, 3, d)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ rng.normal(size=d)) - 0.5))).astype(int)
    fit = optimize.fit_logistic(table(spark, x, y), "label", penalty=1e-3, batches=4)
    by_epoch = {}
    for e, b, rows, loss in fit.losses:
        by_epoch.setdefault(e, []).append((b, rows, loss))
    assert all(sum(r for _, r, _ in v) == n and len(v) == 4 for v in by_epoch.values())
    totals = [sum(loss for _, _, loss in by_epoch[e]) for e in sorted(by_epoch)]
    want = plain(x, y, 1e-3, 30)
    assert np.allclose(totals[: min(len(totals), len(want), 12)], want[: min(len(totals), len(want), 12)], rtol=1e-6)
    w, best = newton(x, y, 1e-3)
    z = x @ fit.parameters[:-1] + fit.parameters[-1]
    got = float((np.logaddexp(0, z) - y * z).mean() + 1e-3 / 2 * (fit.parameters[:-1] ** 2).sum())
    assert best <= got + 1e-12 and got < best * 1.01 and np.allclose(fit.parameters, w, atol=1e-2)


def test_batches_and_losses_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 2, 400)
    a = optimize.fit_logistic(table(spark, x, y), "label", batches=5, epochs=6).losses
    b = optimize.fit_logistic(table(spark, x, y).coalesce(1), "label", batches=5, epochs=6).losses
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3] for r in a], [r[3] for r in b], rtol=1e-9)


def test_null_labels_one_label_and_no_rows(spark):
    df = table(spark, np.eye(3), [1, 1, 1]).withColumn("label", F.when(F.col("row_id") > 0, F.col("label")))
    fit = optimize.fit_logistic(df, "label", epochs=5)
    assert fit.losses[0][2] == 2 and fit.losses[-1][3] < fit.losses[0][3]
    with pytest.raises(ValueError, match="no rows"):
        optimize.fit_logistic(df.where("false"), "label")


def test_registered_losses_fall_to_the_optimum(spark, sf):
    rows = queries.QUERIES["training_losses"](spark, sf).toPandas()
    by_epoch = rows.groupby("epoch").loss.sum()
    assert by_epoch.iloc[-1] < by_epoch.iloc[1] < by_epoch.iloc[0] and rows.groupby("epoch").rows.sum().nunique() == 1
    v = queries.vectors(spark, sf).orderBy("row_id").collect()
    x, y = np.array([r.features for r in v]), np.array([r.label for r in v])
    w, best = newton(x, y, 1e-3)
    assert by_epoch.iloc[-1] / len(x) < best * 1.01
    scores = {r.row_id: r.p for r in queries.QUERIES["logistic_score"](spark, sf).collect()}
    z = x @ w[:-1] + w[-1]
    assert np.allclose([scores[r.row_id] for r in v], 1 / (1 + np.exp(-z)), atol=0.02)
