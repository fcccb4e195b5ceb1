import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.llm import whitening


def exact_covariance(x):
    """By rational numbers."""
    n, d = len(x), len(x[0])
    mean = [sum(map(Fraction, c)) / n for c in zip(*x, strict=True)]
    return [[sum((Fraction(r[i]) - mean[i]) * (Fraction(r[j]) - mean[j]) for r in x) / n for j in range(d)] for i in range(d)]


def far_rows(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return (1e6 + rng.normal(0, 1, (n, d)) @ rng.normal(0, 1, (d, d)) * np.logspace(0, -6, d)).tolist()


def expected(rows):
    """op11's rows but for signs, by whole numbers and one eigenproblem: {(id, component): (n, deviation, whitened, explained)}."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    apart = [[n * a - s for a, s in zip(x, total, strict=True)] for x in fit]
    v = np.array([[sum(r[i] * r[j] for r in apart) / n**3 for j in range(len(total))] for i in range(len(total))])
    e, w = np.linalg.eigh(v)
    first = np.argsort(-e)[:16]
    out = []
    for i, x in good:
        own = [n * a - s for a, s in zip(x, total, strict=True)]
        y = np.array(own) / n @ w[:, first] / np.sqrt(e[first])
        out += [(i, k + 1, n, sum(c * c for c in own), abs(float(y[k])), float(e[first][k] / np.trace(v))) for k in range(len(first))]
    return sorted(out, key=lambda r: (r[0] is None, r[0], r[1]))


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, x string, whitened double").write.parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op11_whitening(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("n,d", [(1, 3), (7, 3), (700, 6)])
def test_covariance_is_exact_to_double_double(spark, n, d):
    x = far_rows(n, d)
    df = spark.createDataFrame([(v,) for v in x], "x array<double>").repartition(5)
    hi, lo = whitening.covariance(df, whitening.sums(df))
    want = exact_covariance(x)
    for i in range(d):
        for j in range(d):
            got = Fraction(hi[i, j]) + Fraction(lo[i, j])
            assert abs(got - want[i][j]) <= Fraction(1, 2**90) * max(1, abs(want[i][i]), abs(want[j][j]))


def test_plain_doubles_would_fail_where_the_compensated_sums_hold():
    x = np.array(far_rows(4000, 4))
    hi, lo = whitening.column_sums(x)
    for k in range(4):
        assert Fraction(hi[k]) + Fraction(lo[k]) == sum(map(Fraction, x[:, k].tolist()))
    # Slices add up to the entry, and each lies on its grid.
    parts = whitening.slices(x - x.mean(0), np.zeros_like(x))
    for r in range(0, 4000, 500):
        for k in range(4):
            assert sum(Fraction(p[r, k]) for p in parts) == Fraction(float((x - x.mean(0))[r, k]))


@pytest.mark.parametrize("a,b", [(1.0, 2.0**-70), (1e300, -1e284), (0.1, 0.2)])
def test_error_free_transformations(a, b):
    s, e = whitening.two_sum(np.float64(a), np.float64(b))
    assert Fraction(float(s)) + Fraction(float(e)) == Fraction(a) + Fraction(b)
    p, e = whitening.two_product(np.float64(0.1), np.float64(b if abs(b) < 1 else 0.3))
    assert Fraction(float(p)) + Fraction(float(e)) == Fraction(0.1) * Fraction(b if abs(b) < 1 else 0.3)


def test_query_against_whole_numbers(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3 + 0.05 * k) for k in range(20)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(300)]  # a hot vector counts once in the fit
    rows += [(7, rows[5][1]), (None, rows[6][1]), (900, None), (901, [0.1] * 19 + [None]), (902, [math.nan] + [0.2] * 19), (903, [0.1] * 19 + [-math.inf]), (904, [])]
    got = sorted(run(spark, tmp_path, rows), key=lambda r: (r.vec_id is None, r.vec_id, r.component))
    want = expected(rows)
    assert len(got) == len(want) == 452 * 16
    for g, w in zip(got, want, strict=True):
        assert (g.vec_id, g.component, g.n, g.deviation) == w[:4]
        assert abs(g.whitened) == pytest.approx(w[4], abs=1e-9) and g.explained == pytest.approx(w[5], rel=1e-9)
    assert {g.identity_error for g in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    # One sign for all rows: products of a component's values over two rows tell.
    by = {(g.vec_id, g.component): g.whitened for g in got if g.vec_id is not None}
    for k in range(1, 17):
        assert by[203, k] == by[3, k]


def test_vectors_of_other_lengths_and_components_without_variance(spark, tmp_path):
    rows = [(i, [i % 3 / 2, i % 5 / 4, 0.25]) for i in range(30)] + [(50, [1.0, 2.0]), (51, [9.0])]
    got = run(spark, tmp_path, rows)
    assert len(got) == 90 and {r.vec_id for r in got} == set(range(30)) and {r.n for r in got} == {15}
    third = [r for r in got if r.component == 3]
    assert all(r.whitened is None and r.explained == 0.0 for r in third) and got[0].identity_error < 1e-12
    assert sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)


@pytest.mark.parametrize("rows,n", [([], 0), ([(1, None)], 0), ([(1, [0.5, 0.5])], 2), ([(1, [0.5]), (2, [0.5])], 2)])
def test_empty_tables_and_single_vectors(spark, tmp_path, rows, n):
    got = run(spark, tmp_path, rows)
    assert len(got) == n and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0.0 for r in got)


def test_general_interface(spark):
    x = np.array(far_rows(500, 5))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, features array<double>")
    model = whitening.fit(df.select("features"), 4)
    out = np.array([r.whitened for r in whitening.whiten(df, model).orderBy("id").collect()])
    assert out.shape == (500, 4) and np.allclose(np.cov(out.T, bias=True), np.eye(4), atol=1e-6)
    with pytest.raises(ValueError, match="no rows"):
        whitening.fit(df.where(F.lit(False)).select("features"))
