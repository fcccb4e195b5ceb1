import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from noveltide.llm import conversations as C

NAMES = {"s": "system", "u": "user", "a": "assistant", "t": "tool", " ": " ", "": ""}


def cheapest(rows, most=2):
    """(cost, audit) by trying all edits; rows are (fault, initial). Up to `most` inserts in each gap."""
    best = None

    def inserts():
        return [w for n in range(most + 1) for w in itertools.product("ua", repeat=n)]

    def go(i, roles, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        for w in inserts():
            now, paid, letters = roles + "".join(w), cost + 5 * len(w), audit + "I" * len(w)
            if i == len(rows):
                if re.fullmatch(r"(s?(ua)+)?", now) and (best is None or (paid, letters) < best):
                    best = (paid, letters)
                continue
            fault, c = rows[i]
            go(i + 1, now, paid + 2, letters + "D")
            if fault in (C.NONE, C.CUT):
                charge = 5 if fault == C.CUT else 0
                go(i + 1, now + (c or "?"), paid + charge, letters + "K")
                go(i + 1, now + "u", paid + charge + 1, letters + "R")
                go(i + 1, now + "a", paid + charge + 1, letters + "R")

    go(0, "", 0, "")
    return best


def piece(rows):
    p = C.Piece()
    for k, (fault, c) in enumerate(rows):
        p.add(k, NAMES[c], f"text {k}", 1, fault)
    return p


def test_search_equals_trying_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice([0, 0, 0, 1, 2, 3]), rng.choice("suuaaat")) for _ in range(rng.randrange(5))]
        ((_, way),) = C.search(rows, C.START, True).items()
        assert way == cheapest(rows), rows


def test_chunks_and_ranges_give_what_one_search_gives(monkeypatch):
    rng = random.Random(2)
    for _ in range(150):
        rows = [(rng.choice([0, 0, 0, 1, 2, 3]), rng.choice("suuaaat")) for _ in range(rng.randrange(1, 40))]
        ((_, want),) = C.search(rows, C.START, True).items()
        monkeypatch.setattr(C, "CHUNK", rng.randrange(1, 6))
        assert piece(rows).repair(C.START, None)[:2] == want
        cuts = sorted(rng.sample(range(len(rows) + 1), min(2, len(rows))))
        parts = [piece(rows[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        state, cost, audit, turns = C.START, 0, "", []
        for p, ahead in zip(parts, C._ahead([p.matrix() for p in parts]), strict=True):
            own, letters, after = p.repair(state, ahead)
            turns += p.repaired(state, letters)
            cost, audit, state = cost + own, audit + letters, after
        assert (cost, audit) == want, (rows, cuts)
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in turns))


def test_the_heuristic_spares_nodes():
    """Deletions that can't be avoided don't make the search try other ways first."""
    import heapq

    rows = [(C.NONE, "ua"[k % 2]) for k in range(40)] + [(C.BLANK, "u")] * 60
    calls = []
    push = heapq.heappush
    try:
        C.heapq.heappush = lambda h, x: (calls.append(x), push(h, x))
        C.search(rows, C.START, True)
    finally:
        C.heapq.heappush = push
    assert len(calls) < 5 * len(rows)


def table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, part string, copies int, conv string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op12_conversations(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    return got, con.execute(C.ORACLES["op12_conversations"]).fetchall()


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_equals_sql_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = ["Yes.", "No", " ", "", None, "a. b", "Who? \t\n", "Done!\n", " ", "Ünï. 🙂", "x" * 3000 + "."]
    rows = [(rng.randrange(80) if rng.random() < 0.95 else None, rng.randrange(9) if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)) for _ in range(600)]
    rows += rows[:60]
    got, want = table(spark, tmp_path, rows)
    assert len(got) == len({r[0] for r in rows})
    same(got, want)


def test_one_conversation_of_a_third_of_all_rows_spans_ranges(spark, tmp_path):
    rng = random.Random(4)
    rows = [(5, k, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.choice(['Yes', 'No', 'Well'])} {rng.randrange(200)}{rng.choice('.!? ,')}") for k in range(1500)]
    rows += [(None, None, "user", "Same.") for _ in range(1500)]
    rows += [(k // 4 + 10, k % 4, "ua"[k % 2] + "x", f"{k}.") for k in range(1500)]
    got, want = table(spark, tmp_path, rows)
    spans = C.repair(spark.read.parquet(f"{tmp_path}/conversations.parquet")).where("not whole")
    assert spans.where("conv = 5").count() > 1 and spans.where("conv is null").count() == 0
    same(got, want)


def test_empty_table_and_all_rows_dropped(spark, tmp_path):
    got, want = table(spark, tmp_path / "a", [])
    assert got == want == []
    dropped = next(k for k in range(1000) if spark.range(1).select(F.crc32(F.lit(f"{k}:0").cast("binary")) % 20).first()[0] == 0)
    got, want = table(spark, tmp_path / "b", [(dropped, 0, "user", "Hi.")])
    same(got, want)
    assert tuple(got[0])[1:8] == (0, 0, 0, 0, 0, 0, "")


def test_repair_returns_turns_for_any_key(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "user", "Well."), ("b", 1, "assistant", "So.")]
    out = {"a": [], "b": []}
    for r in sorted(C.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect(), key=lambda r: r.part):
        out[r.conv] += [tuple(t) for t in r.turns]
    assert out == {"a": [("user", "Hi."), ("assistant", "Well.")], "b": []}


@pytest.mark.parametrize("rows,want", [([], (0, "")), ([(0, "u")], (2, "D")), ([(0, "u"), (3, "a")], (4, "DD")), ([(0, "s"), (0, "u"), (0, "a")], (0, "KKK")), ([(0, "a"), (0, "u")], (2, "RR"))])
def test_small_cases(rows, want):
    ((_, way),) = C.search(rows, C.START, True).items()
    assert way == want
