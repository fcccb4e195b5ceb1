"""The IDX source and sink, and the profile sink."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.operators import prep
from noveltide.sources import idx, profile


def put(path, code, array):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(struct.pack(f">BBBB{array.ndim}I", 0, 0, code, array.ndim, *array.shape))
        f.write(array.astype(idx.TYPES[code]).tobytes())


@pytest.mark.parametrize("range_bytes", [7, 100, 784 * 3 + 16, 1 << 20])
def test_images_and_labels_by_any_ranges(spark, tmp_path, range_bytes):
    rng = np.random.default_rng(1)
    images, labels = rng.integers(0, 256, (23, 4, 5)), rng.integers(0, 10, 23)
    put(f"{tmp_path}/train-images", 0x08, images)
    put(f"{tmp_path}/train-labels", 0x08, labels)
    df = idx.read_idx(spark, f"{tmp_path}/train-images", f"{tmp_path}/train-labels", range_bytes)
    assert df.rdd.getNumPartitions() == -(-(16 + 23 * 20) // range_bytes)
    got = df.orderBy("place").collect()
    assert [r.place for r in got] == list(range(23)) and {r.file for r in got} == {"train-images"}
    assert np.array_equal([r.features for r in got], images.reshape(23, 20)) and [int(r.label) for r in got] == labels.tolist()
    target = int(labels[0])
    assert [r.label for r in prep.one_class(df, "label", target).orderBy("place").collect()] == [int(x != target) for x in labels]


@pytest.mark.parametrize("code", sorted(idx.TYPES))
def test_every_type_and_no_labels(spark, tmp_path, code):
    values = np.array([[0, 1, 100], [7, 8, 9], [0, 0, 127]])
    put(f"{tmp_path}/x", code, values)
    got = idx.read_idx(spark, f"{tmp_path}/x").orderBy("place").collect()
    assert [r.features for r in got] == values.tolist() and all(r.label is None for r in got)


def test_empty_and_broken_files(spark, tmp_path):
    put(f"{tmp_path}/none", 0x08, np.zeros((0, 4)))
    put(f"{tmp_path}/two", 0x08, np.zeros((2, 4)))
    put(f"{tmp_path}/three", 0x08, np.zeros(3))
    assert idx.read_idx(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="labels of dimensions"):
        idx.read_idx(spark, f"{tmp_path}/two", f"{tmp_path}/three").collect()
    raw = open(f"{tmp_path}/two", "rb").read()
    for name, data, message in (("short", raw[:-1], "the header tells of"), ("long", raw + b"x", "the header tells of"), ("cut", raw[:6], "header is cut off"), ("other", b"\x1f\x8b" + raw, "not an IDX file")):
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
        with pytest.raises(Exception, match=message):
            idx.read_idx(spark, f"{tmp_path}/{name}").collect()
    with pytest.raises(Exception, match="gone"):
        idx.read_idx(spark, f"{tmp_path}/gone").collect()


def test_written_vectors_come_back(spark, tmp_path, monkeypatch):
    df = spark.range(500).select(F.array(F.rand(1), F.rand(2), F.col("id").cast("double")).alias("features"), (F.col("id") % 3).alias("label"), F.lit("x").alias("file"), F.lit(1).alias("place")).repartition(3)
    want = {(r.label, *r.features) for r in df.collect()}
    path = f"{tmp_path}/out"
    for n in (1, 2):
        idx.write_idx(df, path, (3,))
        got = idx.read_idx(spark, f"{path}/images", f"{path}/labels").collect()
        assert len(got) == 500 * n and {(int(r.label), *r.features) for r in got} == want
    idx.write_idx(df.limit(10), path, (1, 3), code=0x0D, overwrite=True)
    got = idx.read_idx(spark, f"{path}/images", f"{path}/labels").collect()
    assert len(got) == 10 and all(abs(r.features[0]) <= 1 for r in got)
    assert sorted(os.listdir(f"{path}/images")) == sorted(os.listdir(f"{path}/labels"))
    idx.write_idx(df.where("false"), path, (3,), overwrite=True)
    assert idx.read_idx(spark, f"{path}/images", f"{path}/labels").count() == 0


def test_a_task_cuts_its_rows_into_files(tmp_path, monkeypatch):
    monkeypatch.setattr(idx, "FILE_BYTES", 80)
    writer = idx._Writer(f"{tmp_path}/out", [2], 0x0E, False)
    writer.commit([writer.write(iter([([i, i], i) for i in range(12)])), None])
    assert len([f for f in os.listdir(f"{tmp_path}/out/images") if f.startswith("part-")]) == 3
    rows = [r for part in idx._Reader(f"{tmp_path}/out/images", f"{tmp_path}/out/labels", 50).partitions() for b in idx._Reader(f"{tmp_path}/out/images", None, 50).read(part) for r in b.to_pylist()]
    assert sorted((r["label"], r["features"]) for r in rows) == [(i, [i, i]) for i in range(12)]


@pytest.mark.parametrize("bad", ["array(1.0D)", "array(1.0D, null)", "null", "array(1.0D, 300.0D)"])
def test_a_failed_job_leaves_nothing_to_read(spark, tmp_path, bad):
    df = spark.range(40).select(F.expr(f"CASE WHEN id = 33 THEN {bad} ELSE array(1.0D, 2.0D) END").alias("features"), F.lit(0).alias("label")).repartition(4)
    with pytest.raises(Exception, match="must hold 2 values|hold values that the type"):
        idx.write_idx(df, f"{tmp_path}/out", (2,), code=0x08)
    assert [f for _, _, files in os.walk(f"{tmp_path}/out") for f in files if not f.startswith("_staged-")] == []
    os.makedirs(f"{tmp_path}/out/images", exist_ok=True)
    assert idx.read_idx(spark, f"{tmp_path}/out/images", f"{tmp_path}/out/labels").count() == 0


def test_profile_counts_rows_by_stage(spark, tmp_path):
    spark.range(1000, numPartitions=4).select((F.col("id") % 10).alias("k")).write.parquet(f"{tmp_path}/t")
    spark.range(5).count()
    df = spark.read.parquet(f"{tmp_path}/t").groupBy("k").count()
    p = profile.profile(spark, lambda: df.write.parquet(f"{tmp_path}/out"), "one")
    rows = p.collect()
    assert sum(r.rows_read for r in rows) == 1000 and sum(r.rows_written for r in rows) == 10
    assert sum(r.shuffle_rows_written for r in rows) == sum(r.shuffle_rows_read for r in rows) > 0
    assert {r.run_id for r in rows} == {"one"} and {r.status for r in rows} == {"COMPLETE"} and all(r.failed_tasks == 0 < r.tasks for r in rows)
    assert [r.run_ms for r in rows] == sorted((r.run_ms for r in rows), reverse=True)


def test_profiles_of_no_jobs_of_errors_and_appended(spark, tmp_path):
    assert profile.profile(spark, lambda: None).count() == 0
    with pytest.raises(ZeroDivisionError):
        profile.append_profile(spark, lambda: 1 // 0, f"{tmp_path}/p")
    assert not os.path.exists(f"{tmp_path}/p")
    for run in ("a", "b"):
        profile.append_profile(spark, lambda: spark.range(10).count(), f"{tmp_path}/p", run)
    assert {r.run_id for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {"a", "b"}
