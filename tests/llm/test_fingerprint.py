import hashlib
import unicodedata

from pyspark.sql import functions as F

from noveltide.llm import fingerprint
from tests.llm.conftest import long_text


def canon(t):
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold())
    return " ".join(t.split())


def brute(rows):
    """(id, n_chars, edited, canonical text, canonical edited text, canonical next text), ids unique and not null."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, follow = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + follow[:cut] if cut else t
        out[i] = (len(t), edited, canon(t), canon(edited), canon(follow))
    return out


TEXTS = ["Hello  World", "hello world ", "HELLO\tWORLD\n", None, "", "a", "ab", "abc", "Straße", "STRASSE", "é", "é", "É", "🙂🙃🙂🙃🙂🙃", "x" * 30_000, long_text(4000), "same same", "same same"]


def check(rows, got):
    want = brute(rows)
    assert len(got) == len(rows)
    by_canon, by_print = {}, {}
    for r in got:
        n, edited, c, ce, cn = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(c == ce), float(c == cn))
        for text, mark in ((c, r.fingerprint), (ce, r.edited_fingerprint)):
            assert by_canon.setdefault(text, mark) == mark and by_print.setdefault(mark, text) == text


def test_against_brute_force(make, monkeypatch):
    ids = [k * 5 for k in range(len(TEXTS))]
    df = make(TEXTS, ids=ids)
    check(list(zip(ids, TEXTS, strict=True)), fingerprint.fingerprint_with_edits(df).collect())
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 10)
    monkeypatch.setattr(fingerprint, "MARKS", 4)
    check(list(zip(ids, TEXTS, strict=True)), fingerprint.fingerprint_with_edits(df).collect())


def test_canonical_text_of_odd_characters(spark):
    spaces = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts = ["\x01 a \x02", "\x00", "|a|", " | ", "||", *spaces, *(f"{x}a{x}{x} b{x}" for x in spaces), *(f"a{x} {y}b" for x in spaces[:3] for y in spaces[-3:]), "ǰ ΐ İ ß ﬃ", "e\u0301E\u0301", "🙂\u200b x", "ΑΣ", "a\u2060 b"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", fingerprint.canonical(F.col("t")).alias("c")).collect()
    assert {r.k: r.c for r in got} == {k: canon(t) for k, t in enumerate(texts)}


def test_order_of_many_null_ids(make, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 20)
    texts = [f"text {k} " * (k % 5 + 1) for k in range(40)]
    ids = [None if k % 2 else k for k in range(40)]
    found = {r.edited_sha256 for r in fingerprint.fingerprint_with_edits(make(texts, ids=ids)).collect()}
    known = sorted(((i, t) for i, t in zip(ids, texts, strict=True) if i is not None), reverse=True)
    rest = [t for i, t in zip(ids, texts, strict=True) if i is None]
    hashed = {r.t: r.h for r in make(rest).select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()}
    row = [t for _, t in known] + sorted(rest, key=lambda t: hashed[t])
    want = set()
    for k, t in enumerate(row):
        cut = len(t) // 3
        want.add(hashlib.sha256((t[: len(t) - cut] + row[(k + 1) % len(row)][:cut]).encode()).hexdigest())
    assert found == want


def test_bytes_decide_where_hashes_are_equal(make):
    ids = list(range(len(TEXTS)))
    weak = lambda c: (F.char_length(c) % 3).cast("string")
    check(list(zip(ids, TEXTS, strict=True)), fingerprint.fingerprint_with_edits(make(TEXTS), hash_of=weak).collect())


def test_ties_nulls_and_empty_tables(make):
    out = fingerprint.fingerprint_with_edits(make(["aaa", "aaa", "bbb", "ccc"], ids=[1, 1, None, None])).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out if r.doc_id == 1}) == 1
    one = fingerprint.fingerprint_with_edits(make(["abcdef"], ids=[3])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    assert fingerprint.fingerprint_with_edits(make(["a"]).limit(0)).count() == 0
