import re

import pytest
from pyspark.sql import functions as F

from noveltide.llm import decontaminate
from tests.llm.conftest import long_text

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(texts, items, size=13):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for p in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for t in texts:
        w, covered, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if own := grams.get(tuple(w[p : p + n])):
                    covered |= set(range(p + 1, p + n + 1))
                    found |= own
        out.append((len(w), sorted(covered), sorted(map(str, found))))
    return out


PASSAGE = "The quick, brown fox jumps over the lazy dog and then naps 10 hours in É sun-light today again"
ITEMS = [(1, PASSAGE), (2, "short item"), (3, None), (4, "..."), (12, PASSAGE.upper().replace("É", "é")), (5, long_text(60)), (6, "short item")]
TEXTS = [PASSAGE, "x " * 30 + PASSAGE.lower() + " y" * 600, PASSAGE.replace("fox", "cat"), None, "", "Short... ITEM!", "a short item here short item", PASSAGE + " " + PASSAGE, long_text(9000), "é" * 20, PASSAGE.replace("É", "é"), "--a--", "shortitem", "same", "same"]


@pytest.mark.parametrize("most,hashes", [(50_000, 0), (0, 50_000), (0, 0)])
def test_against_brute_force(spark, make, most, hashes):
    bench = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, gram string")
    got = decontaminate.find_hits(make(TEXTS), bench, broadcast_pairs=most, broadcast_hashes=hashes).collect()
    got = {r.id: (r.n_words, sorted(r.covered), list(r["items"])) for r in got}
    assert got == dict(enumerate(brute(TEXTS, ITEMS)))


def test_removal(spark, make):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = make(TEXTS)
    want = [i for i, (n, c, _) in enumerate(brute(TEXTS, ITEMS)) if not (c and 20 * len(c) >= n)]
    kept = decontaminate.remove_documents(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == df.columns
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(df, bench).collect()}
    assert cut[0] == "" and cut[6] == "a here" and cut[5] == "!" and cut[3] is None and cut[8].startswith(" w60x") and cut[13] == "same"


def test_repeated_rows_nulls_and_empty_tables(spark, make):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = make([PASSAGE, PASSAGE, PASSAGE, None], ids=[1, 1, None, None])
    n = len(words(PASSAGE))
    assert sorted(len(r.covered) for r in decontaminate.find_hits(df, bench).collect()) == [0, n, n, n]
    assert decontaminate.remove_documents(df, bench).count() == 1
    assert decontaminate.find_hits(df.limit(0), bench).count() == 0
    assert decontaminate.find_hits(df, bench.limit(0)).where(F.size("covered") > 0).count() == 0


def test_windows_beyond_the_literals_are_dropped_before_any_shuffle(spark, make, monkeypatch):
    """Of the documents' windows only hits are dealt, with broadcasts left to the operator."""
    plans = []
    real = decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bench = spark.createDataFrame(ITEMS, "item_id long, text string")
        got = {r.id: (r.n_words, sorted(r.covered), list(r["items"])) for r in decontaminate.find_hits(make(TEXTS), bench, broadcast_pairs=0).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == dict(enumerate(brute(TEXTS, ITEMS)))
    lines = plans[-1].split("\n")
    explode = next(k for k, x in enumerate(lines) if "Generate inline(concat" in x or "Generate inline(" in x and "placed" in x or "n:int" in x and "Generate" in x) if any("Generate" in x for x in lines) else None
    above = [x for x in lines[:explode] if "Join" in x or "Exchange" in x]
    assert "BroadcastHashJoin" in above[-1] and "LeftSemi" in above[-1]


def test_remove_spans_with_repeated_rows_clashing_columns_and_empty_tables(spark, make):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = make([PASSAGE, PASSAGE, "same", None], ids=[1, 1, 2, None]).withColumn("covered", F.lit("own"))
    out = decontaminate.remove_spans(df, bench)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.text or "", r.covered) for r in out.collect()) == [(0, "", "own"), (1, "", "own"), (1, "", "own"), (2, "same", "own")]
    assert decontaminate.remove_spans(df.limit(0), bench).count() == 0 and decontaminate.remove_spans(df, bench.limit(0)).count() == 4
