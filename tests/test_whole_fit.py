"""Detectors that are fitted on all training rows, however many there are."""

from __future__ import annotations

import numpy as np

from noveltide.operators.detectors import DETECTORS, learned


def fitted_on(spark, monkeypatch, name):
    asked = []
    real = learned.sample_matrix
    monkeypatch.setattr(learned, "sample_matrix", lambda df, most: asked.append(most) or real(df, most))
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))], "row_id long, features array<double>")
    assert DETECTORS[name](df, df, epochs=1).count() == 40
    return asked


def test_lunar_has_no_bound(spark, monkeypatch):
    """It was fitted on 20,000 rows at most."""
    assert fitted_on(spark, monkeypatch, "LUNAR") == [None]


def test_neutralad_has_no_bound(spark, monkeypatch):
    """It was fitted on 20,000 rows at most."""
    assert fitted_on(spark, monkeypatch, "NeuTraLAD") == [None]
