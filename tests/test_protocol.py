"""Detectors as pipeline stages, the CSV sink of one header, places in files, minibatches."""

from __future__ import annotations

import csv
import glob
import hashlib
import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from noveltide.operators.detectors import DETECTORS
from noveltide.operators.detectors.estimator import Detector, DetectorModel
from noveltide.plans import queries
from noveltide.sources import results, tables


def frame(spark, n=500, d=4):
    rng = np.random.default_rng(n)
    return spark.createDataFrame([(i, list(map(float, v)), f"t{i}") for i, v in enumerate(rng.normal(size=(n, d)))], "row_id long, features array<double>, tag string")


@pytest.mark.parametrize("name,options", [("PCA", {}), ("IForest", {"members": 20, "sample": 64}), ("LODA", {"cuts": 20})])
def test_fit_transform_save_load(spark, tmp_path, name, options):
    import json

    df = frame(spark)
    model = Detector(algorithm=name, options=json.dumps(options), contamination=0.1).fit(df)
    out = model.transform(df).toPandas().set_index("row_id")
    short = {"members": "trees"}
    want = DETECTORS[name](df, df, **{short.get(k, k): v for k, v in options.items()}).toPandas().set_index("row_id").score
    assert np.allclose(out.score.sort_index(), want.sort_index()) and (out.tag == [f"t{i}" for i in out.index]).all()
    assert model.threshold == pytest.approx(np.quantile(out.score, 0.9)) and (out.prediction == (out.score > model.threshold)).all() and out.prediction.sum() == 50
    assert out.p_anomaly.min() == 0 and out.p_anomaly.max() == pytest.approx(1)
    model.save(f"{tmp_path}/model")
    again = DetectorModel.load(f"{tmp_path}/model")
    assert again.uid == model.uid and again.getOrDefault("contamination") == 0.1
    assert np.array_equal(again.transform(df).toPandas().set_index("row_id").score.sort_index(), out.score.sort_index())
    far = spark.createDataFrame([(1, [1e6] * 4)], "row_id long, features array<double>")
    r = again.transform(far).first()
    assert r.prediction == 1 and r.p_anomaly == 1.0 and again.transform(df.where("false")).count() == 0


def test_loaded_in_another_session(spark, tmp_path):
    df = frame(spark, 200)
    model = Detector(algorithm="IForest", scoreCol="s", seed=3).fit(df)
    model.save(f"{tmp_path}/model")
    df.write.parquet(f"{tmp_path}/rows")
    code = f"""
from noveltide.session import local_session
from noveltide.operators.detectors.estimator import DetectorModel
spark = local_session(1, 1)
DetectorModel.load("{tmp_path}/model").transform(spark.read.parquet("{tmp_path}/rows")).select("row_id", "s").write.parquet("{tmp_path}/scores")
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=os.getcwd(), capture_output=True)
    got = {r.row_id: r.s for r in spark.read.parquet(f"{tmp_path}/scores").collect()}
    assert got == {r.row_id: r.s for r in model.transform(df).collect()}


def test_pipeline_stage_and_errors(spark, tmp_path):
    df = frame(spark, 100)
    fitted = Pipeline(stages=[Detector(algorithm="PCA")]).fit(df)
    fitted.save(f"{tmp_path}/pipeline")
    assert PipelineModel.load(f"{tmp_path}/pipeline").transform(df).count() == 100
    with pytest.raises(ValueError, match="no algorithm"):
        Detector(algorithm="KNNX").fit(df)


def test_saved_detector_query_equals_the_detector(spark, sf):
    got = queries.QUERIES["saved_detector"](spark, sf).toPandas().set_index("row_id")
    want = queries.QUERIES["detector_pca"](spark, sf).toPandas().set_index("row_id").score
    assert np.allclose(got.score.sort_index(), want.sort_index())


def lines(path):
    return [r for f in [f"{path}/{results.HEADER}", *sorted(glob.glob(f"{path}/part-*"))] for r in csv.reader(open(f, newline=""))]


def test_appends_have_one_header(spark, tmp_path):
    path = f"{tmp_path}/results"
    rows = [("a,b", 1.5, None, True), ('say "x"\nand y', math.nan, 3, False), ("", math.inf, -1, None), (None, 1e-300, 2**60, True)]
    df = spark.createDataFrame(rows, "Model string, AUCROC double, n long, ok boolean").repartition(3)
    for _ in range(3):
        results.append_csv(df, path)
    assert sum(r == ["Model", "AUCROC", "n", "ok"] for r in lines(path)) == 1 and len(lines(path)) == 13
    got = results.read_results(spark, path, df.schema).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(r) for r in rows * 3)
    results.append_csv(df.limit(1), path, overwrite=True)
    assert results.read_results(spark, path, df.schema).count() == 1
    with pytest.raises(Exception, match="other columns"):
        results.append_csv(df.select("n"), path)
    assert results.read_results(spark, path, df.schema).count() == 1 and not glob.glob(f"{path}/_staged*")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/results"
    good = spark.range(6).select(F.col("id").alias("n"))
    results.append_csv(good, path)
    bad = good.repartition(4).select(F.when(F.col("n") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("n")).cast("long").alias("n"))
    with pytest.raises(Exception, match="broken"):
        results.append_csv(bad, path)
    assert sorted(r.n for r in results.read_results(spark, path, "n long").collect()) == list(range(6))
    assert not glob.glob(f"{path}/_staged*") and len(lines(path)) == 7
    results.append_csv(good.where("false"), path)
    assert len(lines(path)) == 7


def test_places_follow_files_and_blocks(spark, tmp_path):
    path = f"{tmp_path}/rows"
    os.makedirs(path)
    want = []
    for f in range(5):
        with open(f"{path}/part-{f}.csv", "w") as out:
            for k in range(f * 300):
                out.write(f"{f},{k}\n")
                want.append((f, k))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = tables.numbered(spark.read.schema("f int, k int").csv(path))
        assert [(r.f, r.k) for r in sorted(out.collect(), key=lambda r: r.position)] == want
        assert sorted(r.position for r in out.collect()) == list(range(len(want)))
        split = tables.head_split(spark.read.schema("f int, k int").csv(path), 0.25)
        assert {(r.f, r.k) for r in split.where("is_test").collect()} == set(want[: len(want) // 4])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("drop_last,n", [(False, 103), (True, 100)])
def test_minibatches_are_a_seeded_permutation_per_epoch(spark, drop_last, n):
    df = spark.range(103).withColumnRenamed("id", "row_id")
    got = tables.minibatches(df, "row_id", 20, 3, drop_last, seed=7).collect()
    orders = []
    for e in range(3):
        want = sorted(range(103), key=lambda i: hashlib.md5(f"7:{e}:{i}".encode()).hexdigest())
        own = {}
        for r in got:
            if r.epoch == e:
                own.setdefault(r.batch, set()).add(r.row_id)
        assert own == {b: set(want[20 * b : 20 * b + 20]) for b in range(-(-n // 20))}
        orders.append(want)
    assert len(got) == 3 * n and orders[0] != orders[1]
    assert tables.minibatches(df.where("false"), "row_id", 20, 1).count() == 0
