import math
import random

import duckdb
import numpy as np
import pytest

from noveltide.llm import license_scan
from tests.llm.conftest import long_text
from tests.llm.test_decontaminate import words


def brute(texts, templates, similarity=0.8):
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    out = {}
    for i, t in enumerate(texts):
        found = grams(words(t))
        for name, template in templates.items():
            want = set(grams(words(template)))
            stride, size = license_scan.window_shape(len(words(template)))
            hits = []
            for k in range(len(found) // stride + 1):
                own = [(p, found[p]) for p in range(k * stride, min(len(found), k * stride + size - 4)) if found[p] in want]
                share = len({g for _, g in own}) / len(want)
                if own and share >= similarity:
                    hits.append((-share, own[0][0]))
            if hits:
                out[i, name] = (-min(hits)[0], min(hits)[1], len(hits))
    return out


MIT, APACHE = license_scan.TEMPLATES["MIT-permission"], license_scan.TEMPLATES["Apache-2.0-header"]
TEXTS = [
    None, "", "four words only here", "released UNDER the mit license", "Released under the MIT", long_text(500) + " " + MIT, MIT.replace("free of charge", "for no money"), MIT[: len(MIT) // 2],
    APACHE + "\n" + APACHE, long_text(13) + " Licensed under the Apache License, Version 2.0. " + long_text(9000, 50) + " Licensed under CC BY-NC 4.0.", "\n".join([license_scan.TEMPLATES["GPL-3.0"]] * 5), " ".join(license_scan.TEMPLATES.values()), "same Released under the MIT License.",
]


@pytest.mark.parametrize("most", [50_000, 0])
def test_against_brute_force(make, most):
    got = {(r.doc_id, r.license): (pytest.approx(r.containment), r.first_word, r.n_windows) for r in license_scan.scan_licenses(make(TEXTS), most_keys=most).collect()}
    assert got == brute(TEXTS, license_scan.TEMPLATES)


def test_recall_of_edited_licenses(make):
    rng = random.Random(8)
    texts = []
    for k in range(240):
        name = rng.choice(sorted(license_scan.TEMPLATES))
        w = license_scan.TEMPLATES[name].split()
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            j = rng.randrange(len(w))
            w[j : j + rng.randint(0, 2)] = rng.choice([[], ["other"], ["two", "more"]])
        between = [license_scan.TEMPLATES[rng.choice(sorted(license_scan.TEMPLATES))]] if k % 3 == 0 else []
        texts.append(" ".join([long_text(rng.randint(0, 60), 100 * k), *between, *w, long_text(rng.randint(0, 60), 50_000 + 100 * k)]))
    got = {(r.doc_id, r.license): (pytest.approx(r.containment), r.first_word, r.n_windows) for r in license_scan.scan_licenses(make(texts)).collect()}
    want = brute(texts, license_scan.TEMPLATES)
    assert len(want) > 200 and got == want


def test_long_templates_and_many_classes(make):
    templates = {f"t{n}": long_text(n, 1000 * n) for n in (5, 6, 13, 100, 1500, 6000)}
    texts = [long_text(50, 10**6) + " " + t + " " + long_text(90, 2 * 10**6) for t in templates.values()] + [" ".join(templates["t1500"].split()[:1150]), " ".join(templates["t1500"].split()[100:1400])]
    got = {(r.doc_id, r.license): (pytest.approx(r.containment), r.first_word, r.n_windows) for r in license_scan.scan_licenses(make(texts), templates).collect()}
    assert got == brute(texts, templates) and (7, "t1500") in got and (6, "t1500") not in got


def test_bands_are_those_of_whole_windows():
    """Of windows that hold 0.8 of a template, hardly any agrees in no band, whatever else they hold."""
    rng = np.random.default_rng(3)
    bits = np.uint64(64 - license_scan.BAND_BITS)

    def signature(x):
        return {int(p): int(x[x >> bits == p].min()) for p in np.unique(x >> bits)}

    for n in (5, 6, 7, 13, 40, 200):
        m, size = n - 4, license_scan.window_shape(n)[1] - 4
        missed, held = 0, math.ceil(0.8 * m - 1e-9)
        for _ in range(2000):
            t = rng.integers(0, 2**64, m, dtype="u8")
            w = np.r_[t[:held], rng.integers(0, 2**64, size - held, dtype="u8")]
            missed += not set(signature(t).items()) & set(signature(w).items())
        assert missed / 2000 <= (0.02 if m == 1 else 0.002)
        assert license_scan.least_similarity(n) >= 0.35


def test_rejects_short_templates(make):
    with pytest.raises(ValueError):
        license_scan.scan_licenses(make(["a"]), {"x": "too short"})


def test_repeated_rows_nulls_and_empty_tables(make):
    t = "Released under the MIT License."
    assert [(r.doc_id, r.license) for r in license_scan.scan_licenses(make([t, t, t], ids=[1, 1, None])).orderBy("doc_id").collect()] == [(None, "MIT"), (1, "MIT")]
    assert license_scan.scan_licenses(make([t]).limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute("SELECT doc_id, license, containment, first_word, n_windows FROM (" + license_scan.ORACLES["op2_license_scan"] + ")").fetchall())
    got = sorted(tuple(r) for r in license_scan.op2_license_scan(spark, sf).select("doc_id", "license", "containment", "first_word", "n_windows").collect())
    assert got == want


@pytest.mark.parametrize("most", [50_000, 0])
def test_no_join_moves_or_sends_the_texts(spark, make, most):
    """However large the table of texts: templates are sent, shingles of texts aren't dealt by their words."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = license_scan.scan_licenses(make(TEXTS), most_keys=most)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.doc_id, r.license): (pytest.approx(r.containment), r.first_word, r.n_windows) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin [gram" in plan and "hashpartitioning(gram" not in plan and "BuildLeft" not in plan
    assert got == brute(TEXTS, license_scan.TEMPLATES)


def test_clashing_columns_are_ignored(spark, make):
    docs = make([MIT]).withColumnsRenamed({"h": "gram", "id": "license", "w": "at", "th": "hits"})
    assert [(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()] == sorted((0, k) for _, k in brute([MIT], license_scan.TEMPLATES))
