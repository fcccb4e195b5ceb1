"""Null directions of wide tables against singular values of the centred rows."""

from __future__ import annotations

import numpy as np
import pytest

from noveltide.operators import nullspace


def frame(spark, x, c):
    return spark.createDataFrame([(i, list(map(float, v)), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "row_id long, features array<double>, cluster int").repartition(5)


def classes(n, d, k, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (n, d)) + 100, np.arange(n) % k


def projector(w):
    q, _ = np.linalg.qr(w)
    return q @ q.T


def test_equal_to_the_scatter_matrices_at_64_features(spark):
    x, c = classes(60, 64, 12)
    df = frame(spark, x, c)
    got, want = nullspace.wide_directions(df), nullspace.null_directions(nullspace.scatter(df))
    assert got[1:] == want[1:] and got.w.shape == want.w.shape == (64, 11)
    assert np.allclose(projector(got.w), projector(want.w), atol=1e-8) and np.allclose(got.w.T @ got.w, np.eye(11), atol=1e-10)
    for k in range(12):
        assert np.ptp(x[c == k] @ got.w, axis=0).max() < 1e-8


def test_six_thousand_features(spark):
    x, c = classes(90, 6000, 6)
    p = nullspace.wide_directions(frame(spark, x, c))
    assert p.w.shape == (6000, 5) and p.rank_total == 89 and p.rank_within == 84
    t = x - x.mean(0)
    assert np.allclose(t.T @ (np.linalg.pinv(t.T, rcond=1e-10) @ p.w), p.w, atol=1e-8)  # inside the rows' span
    for k in range(6):
        assert np.ptp(x[c == k] @ p.w, axis=0).max() < 1e-7
    with pytest.raises(ValueError, match="wide_directions"):
        nullspace.scatter(frame(spark, x[:3], c[:3]))


def test_small_spread_keeps_its_digits(spark):
    """A spread of 1e-7 of the largest is not null, though its square drowns in a product matrix's rounding."""
    x, c = classes(50, 8, 4, seed=3)
    x = np.c_[x * 1e4, np.random.default_rng(4).normal(size=50) * 2e-3]
    p = nullspace.wide_directions(frame(spark, x, c), rtol=1e-18)
    assert p.rank_within == 9 and p.null_size == 0


def test_more_rows_than_rank_and_classes_of_one_row(spark):
    x, c = classes(300, 20, 3, seed=5)
    x[:, 10:] = x[:, :10] @ np.random.default_rng(6).normal(size=(10, 10))
    p = nullspace.wide_directions(frame(spark, x, c), rank=15)
    assert p.rank_total == 10 and p.null_size == 0 and p.w.shape == (20, 0)
    one = nullspace.wide_directions(frame(spark, x[:4], np.arange(4)))
    assert one.w.shape[1] == 3 and one.rank_within == 0
    with pytest.raises(ValueError, match="no rows"):
        nullspace.wide_directions(frame(spark, x[:1], [0]).where("false"))


def test_absolute_tolerance(spark):
    x, c = classes(40, 45, 5)
    s = nullspace.scatter(frame(spark, x * 1e-12, c))
    assert nullspace.null_directions(s, atol=1e-8).null_size == s.total.shape[0] - 6 or nullspace.null_directions(s, atol=1e-8).null_size > nullspace.null_directions(s).null_size
