import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.llm import quality
from tests.llm.conftest import long_text

BIG = "/root/testdata/sf0.1"
GOOD, BAD = "It was a fine day. We went out.", "BUY!! NOW!! *** CHEAP ***"


def plain_buckets(text):
    words = re.findall(r"\w+|[^\w\s]+", text)
    code = [zlib.crc32(w.encode()) + 1 for w in words]
    m, out = (1 << 64) - 1, set()
    for k in range(len(code)):
        v = 0
        for n in range(1, quality.GRAM + 1):
            if k + n <= len(code):
                v = (v * 0x9E3779B97F4A7C15 + code[k + n - 1]) & m
                out.add((((v + n) * 0x9E3779B97F4A7C15 & m) >> 24) % quality.BUCKETS)
    return out


def plain_ftrl(texts, labels, seed=7):
    """The published updates over dicts, coordinate by coordinate."""
    z, n = {}, {}
    alpha, beta, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    rows = [plain_buckets(t) for t in texts]
    rng = np.random.default_rng(seed)
    weight = lambda i, l1, l2: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)
    for _ in range(max(quality.EPOCHS, -(-quality.LEAST_UPDATES // len(rows)))):
        for k in rng.permutation(len(rows)):
            w = {i: weight(i, l1, l2) for i in rows[k]}
            b = weight("bias", 0.0, 0.0)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - labels[k]
            for i, own in [*w.items(), ("bias", b)]:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * own
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i, l1, l2) for i in z if i != "bias"}, weight("bias", 0.0, 0.0)


def test_training_equals_plain_updates(monkeypatch):
    monkeypatch.setattr(quality, "LEAST_UPDATES", 200)
    texts = [f"{GOOD} {k % 7}" if k % 3 else f"{BAD} {k % 5} fine day" for k in range(40)]
    labels = [int(k % 3 > 0) for k in range(40)]
    model = quality.train(texts, labels)
    want, bias = plain_ftrl(texts, labels)
    assert model.bias == pytest.approx(bias, abs=1e-6)
    assert {i for i in want if want[i]} == set(np.flatnonzero(model.weight).tolist())
    assert all(model.weight[i] == pytest.approx(w, abs=1e-5) for i, w in want.items())
    scorer = quality.Scorer(model)
    for t in (GOOD, BAD, "", "day", "fine day BUY!!"):
        plain = 1 / (1 + math.exp(-(sum(float(model.weight[i]) for i in plain_buckets(t)) + model.bias)))
        assert scorer(t) == pytest.approx(plain, abs=1e-6)
    assert scorer(GOOD) > 0.9 > 0.1 > scorer(BAD)


def test_score_handles_nulls_long_texts_and_clashing_columns(spark, make):
    model = quality.train([GOOD, BAD] * 10, [1, 0] * 10)
    docs = make([GOOD, BAD, "", None, " \n", long_text(200_000), GOOD], ids=[1, 2, 3, 4, 5, 6, 1]).withColumn("Score", F.lit("own"))
    out = quality.score(docs, model, score_col="q").collect()
    s = {}
    for r in out:
        s.setdefault(r.doc_id, []).append(r.q)
        assert r.predicted == int(r.q >= 0.3) and r.Score == "own" and 0 <= r.q <= 1
    assert s[3] == s[4] == s[5] and len(set(s[1])) == 1 and len(s[1]) == 2
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 2 not in {r.doc_id for r in kept.collect()}
    assert quality.score(docs.where("false"), model).count() == 0


def test_fit_without_labels_or_with_one_label(spark, make):
    docs = make([GOOD, BAD])
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0), (7, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert not model.weight.any() and model.bias == pytest.approx(math.log(2))
    assert quality.fit(docs, labels.where("false")).bias == 0.0


def test_sample_is_bounded_by_parameters(spark, make, monkeypatch):
    given = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: given.append(texts))
    docs = make([f"text {k} {'x' * k}" for k in range(50)])
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    quality.fit(docs, labels, sample_rows=20)
    quality.fit(docs, labels, sample_chars=300)
    quality.fit(docs, labels.unionByName(labels), F.col("doc_id") < 5)
    assert len(given[0]) == 20 and 0 < sum(map(len, given[1])) <= 300 and len(given[2]) == 5


def test_held_out_accuracy(spark):
    if not os.path.isdir(BIG):
        pytest.skip("no table")
    out = quality.op13_quality(spark, BIG).where("held_out").join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").toPandas()
    y, s = out.quality.to_numpy(), out.score.to_numpy()
    better = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert better > 0.98 and (out.predicted[y == 1] == 1).mean() > 0.98 and (out.predicted[y == 0] == 0).mean() > 0.75
