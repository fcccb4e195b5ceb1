"""Rows that share most neighbours, against counting all pairs."""

from __future__ import annotations

import random

import pytest

from noveltide.operators.detectors.tabular import most_shared


def brute(lists, top):
    out = {}
    for a, x in lists.items():
        n = sorted((-len(x & y), b) for b, y in lists.items() if b != a and x & y)
        out[a] = [(b, -c) for c, b in n[:top]]
    return out


def check(spark, lists, top):
    df = spark.createDataFrame([(a, i) for a, x in lists.items() for i in sorted(x)], "row_id long, nid long")
    got = {}
    for r in most_shared(df, top).collect():
        got.setdefault(r.row_id, []).append((r.other, r.n))
    got = {a: sorted(v, key=lambda p: (-p[1], p[0])) for a, v in got.items()}
    assert got == {a: v for a, v in brute(lists, top).items() if v}


@pytest.mark.parametrize("k,ids,top", [(6, 60, 3), (8, 400, 4), (5, 12, 2)])
def test_equal_to_counting_all_pairs(spark, k, ids, top):
    rng = random.Random(k)
    check(spark, {a: set(rng.sample(range(ids), rng.randint(1, k))) for a in range(150)}, top)


def test_a_hub_in_every_list(spark):
    """Rows that share the hub alone get the least ids; the hub's list isn't met with itself."""
    rng = random.Random(1)
    lists = {a: {0, *rng.sample(range(1, 100_000), 5)} for a in range(3000)}
    for a in range(0, 3000, 100):
        lists[a + 1] = set(list(lists[a])[:4]) | {0, 200_000 + a}
    check(spark, lists, 4)


def test_lists_of_one_and_rows_alone(spark):
    check(spark, {1: {5}, 2: {5}, 3: {6}, 4: {5, 6}}, 3)
    assert most_shared(spark.createDataFrame([], "row_id long, nid long"), 3).count() == 0
