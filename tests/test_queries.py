"""Every registered core query runs, and equals its SQL where it has one."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from noveltide.plans import queries
from noveltide.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(repr([round(v, 5) + 0.0 if isinstance(v, float) else v.item() if hasattr(v, "item") else v for v in r]) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_registered_detectors_have_production_parameters(spark, sf, monkeypatch):
    given = {}
    for name in ("DIF", "IForest", "AutoEncoder", "VAE", "DeepSVDD", "DASVDD", "NeuTraLAD", "DevNet"):
        monkeypatch.setitem(queries.DETECTORS, name, lambda test, train, name=name, **options: given.update({name: options}) or test.selectExpr("row_id", "0D AS score"))
        QUERIES[f"detector_{name.lower()}"](spark, sf)
    assert {k: v for k, v in given.items() if v} == {"DASVDD": {"epochs": 100}, "NeuTraLAD": {"epochs": 200}} and len(given) == 8


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
