import hashlib

from noveltide.llm.line_dedup import drop_common_lines


def brute(texts, least):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\v\f\r").translate(low)
    seen = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_against_brute_force(make):
    texts = ["Common Line\nown a", " common line\t\nown b\n", "COMMON LINE", None, "", "\n\n", "éÉ\nÉé", "x\ncommon line\nx", "  \n \n", "a\rb\nc", "own a", "É", "common line ", "same", "same", "same", "tail\n" * 5000 + "end"]
    got = {r.doc_id: r for r in drop_common_lines(make(texts), 3).collect()}
    for i, (n, dropped, kept) in enumerate(brute(texts, 3)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].text or "") == (n, dropped, kept), i
    assert got[3].text is None and got[0].h == "h0" and got[0].w == "x"


def test_repeated_rows_and_ids_count_each(make):
    out = drop_common_lines(make(["a\nb", "a\nb", "a\nc"], ids=[7, 7, None]), 3).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "c"), (7, "b"), (7, "b")]
    assert drop_common_lines(make(["a"]).limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    import duckdb

    from noveltide.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(ORACLES["op6_line_dedup"]).fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op6_line_dedup"](spark, sf).collect()}
    assert got == want and hashlib.sha256(b"").hexdigest() not in {v[2] for v in list(got.values())[:3]}
