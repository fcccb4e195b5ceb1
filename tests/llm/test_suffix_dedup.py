import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.llm import suffix_dedup
from noveltide.llm import suffix_kernels as kernels

SPAN = kernels.SPAN


def brute(texts):
    """Covered bytes of each text."""
    count = Counter(t[p : p + SPAN] for t in texts for p in range(len(t) - SPAN + 1))
    out = []
    for t in texts:
        cover, end = bytearray(len(t)), 0
        for p in range(len(t) - SPAN + 1):
            if count[t[p : p + SPAN]] > 1:
                for q in range(max(p, end), p + SPAN):
                    cover[q] = 1
                end = p + SPAN
        out.append(cover)
    return out


def corpus(rng, alphabet=b"abcd "):
    word = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    pool = [word(rng.choice([199, 200, 201, 230, 400, 900])) for _ in range(5)]
    texts = []
    for _ in range(14):
        t = word(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            x = bytearray(rng.choice(pool))
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = ord("z")
            t += bytes(x[rng.randint(0, 20) : len(x) - rng.randint(0, 20)]) + word(rng.randint(0, 30))
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed", range(8))
def test_kernel_against_brute_force(seed):
    rng = random.Random(seed)
    texts = corpus(rng, b"ab" if seed % 4 == 3 else b"abcd ") + ([b"a" * 500, b"ab" * 300, b""] if seed % 2 else [])
    strings, places = {}, []
    for i, t in enumerate(texts):
        start, count, off, _ = kernels.runs(np.frombuffer(t, "u1"))
        assert count.sum() == max(0, len(t) - SPAN + 1)
        for s, n, a in zip(start.tolist(), count.tolist(), off.tolist(), strict=True):
            x = t[s : s + n + SPAN - 1]
            e = strings.setdefault(x, [a, 0])
            assert e[0] == a
            e[1] += 1
            places.append((i, s, x))
    keys = list(strings)
    marks = kernels.repeated_windows(keys, np.array([strings[k][0] for k in keys]), np.array([strings[k][1] for k in keys], "f8"), shard_symbols=rng.choice([40, 300, 1 << 14]))
    marks = dict(zip(keys, marks, strict=True))
    cover = [bytearray(len(t)) for t in texts]
    for i, s, x in places:
        for p in np.flatnonzero(marks[x]):
            cover[i][s + p : s + p + SPAN] = b"\x01" * SPAN
    assert cover == brute(texts)


def test_merge_is_the_transform_of_all_suffixes():
    rng = np.random.default_rng(1)
    shards = [np.r_[rng.integers(3, 5, 40), k] for k in range(3)]
    orders = [kernels.suffix_order(s) for s in shards]
    z, lcp = kernels.merge([s[o - 1] for s, o in zip(shards, orders, strict=True)], 12)
    merged = [(k, int(orders[k][i])) for k, i in zip(z, [int((z[:j] == z[j]).sum()) for j in range(len(z))], strict=True)]
    prefix = lambda k, p: tuple(np.r_[shards[k][p:], shards[k]][:12])
    rows = [prefix(k, p) for k, p in merged]
    assert rows == sorted(rows)
    for j in range(1, len(rows)):
        same = next((h for h in range(12) if rows[j][h] != rows[j - 1][h]), 12)
        assert lcp[j] == same


def test_classes_of_rows_whose_hashes_are_equal(monkeypatch):
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 4, 500).astype("u8") for _ in range(3)]
    want = np.unique(np.stack(columns), axis=1, return_inverse=True)[1]
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(kernels, "mixed", lambda columns: columns[0] % np.uint64(2))
        got = kernels.classes(columns)
        assert len(set(zip(got.tolist(), want.tolist(), strict=True))) == len(set(want.tolist())) == got.max() + 1
    assert len(kernels.classes([np.zeros(0, "u8")])) == 0


def test_runs_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(2)
    text = np.frombuffer(b"".join(corpus(rng)) * 3, "u1")
    whole = kernels.runs(text)
    monkeypatch.setattr(kernels, "CHUNK", 300)
    assert all((a == b).all() for a, b in zip(whole, kernels.runs(text), strict=True))


@pytest.mark.parametrize("hot,bits", [(2000, 26), (2, 6), (2, 26), (1, 26)])
def test_operator_against_brute_force(make, monkeypatch, hot, bits):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MARK_BITS", bits)
    rng = random.Random(3)
    texts = [t.decode() for t in corpus(rng)]
    twice = "é" + "".join(rng.choice("xyz ") for _ in range(240))
    texts += [None, "", "short", twice + "A" + twice, "B" * 700, texts[3], "".join(rng.choice("pqr ") for _ in range(30_000)) + twice]
    ids = [*range(len(texts)), 50, 50, None]
    texts += ["same row " * 40, "same row " * 40, "".join(rng.choice("mn ") for _ in range(300))]
    raw = [(t or "").encode() for t in texts]
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "", bytes(r.kept), [(s.s, s.e) for s in r.spans]) for r in suffix_dedup.remove_repeats(make(texts, ids=ids)).collect()), key=repr)
    want = []
    for i, t, b, c in zip(ids, texts, raw, brute(raw), strict=True):
        edges = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(bytes(c), "u1"), 0].astype("i1")))
        want.append((i if i is not None else -1, t or "", bytes(x for x, k in zip(b, c, strict=True) if not k), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))))
    assert got == sorted(want, key=repr)


def test_contexts_of_a_common_passage_part_their_keys(make, monkeypatch):
    rng = random.Random(6)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passage = word(260)
    texts = [word(150) + passage + word(150) for _ in range(60)]
    count = Counter()
    for t in texts:
        start, windows, off, ah = kernels.runs(np.frombuffer(t, "u1"))
        for s, n, o, h in zip(start.tolist(), windows.tolist(), off.tolist(), ah.view("i8").tolist(), strict=True):
            cores = [c for _, c, _, _, _ in suffix_dedup._pieces(t, h, s, n, o, set())]
            keys = {(x[0], x[1], t[x[2] : x[2] + x[3] + SPAN - 1]) for x in suffix_dedup._pieces(t, h, s, n, o, set(cores))}
            count.update((h, *k[:2]) for k in keys)
            assert sum(x[3] for x in suffix_dedup._pieces(t, h, s, n, o, set())) == n
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    hot = suffix_dedup._hot(make([t.decode() for t in texts]).select("text").rdd.map(lambda r: (r.text, [{"start": int(s), "count": int(n), "off": int(o), "ah": int(h), "often": True} for s, n, o, h in zip(*[x.tolist() for x in kernels.runs(np.frombuffer(r.text.encode(), "u1"))[:3]], kernels.runs(np.frombuffer(r.text.encode(), "u1"))[3].view("i8").tolist(), strict=True)])).toDF("text string, runs array<struct<start:long,count:int,off:int,ah:long,often:boolean>>"))
    assert 0 < len(hot.anchors) < 10 and 0 < len(hot.cores) < 40
    strings = Counter()
    for t in texts:
        for s, n, o, h in zip(*[x.tolist() for x in kernels.runs(np.frombuffer(t, "u1"))[:3]], kernels.runs(np.frombuffer(t, "u1"))[3].view("i8").tolist(), strict=True):
            if h in hot.anchors:
                strings.update({(h, x[0], x[1], t[x[2] : x[2] + x[3] + SPAN - 1]): 1 for x in suffix_dedup._pieces(t, h, s, n, o, hot.cores)}.keys())
    keys = Counter(k[:3] for k in strings)
    assert max(keys.values()) < 20


@pytest.mark.parametrize("bits", [8, 26])
def test_every_hot_key_is_marked_in_marks_of_fixed_size(spark, monkeypatch, bits):
    monkeypatch.setattr(suffix_dedup, "MARK_BITS", bits)
    keys = spark.range(200_000).select((F.col("id") % 2 == 1).alias("is_core"), F.xxhash64("id").alias("key"))
    hot = suffix_dedup._marked(keys)
    assert len(hot.anchors.marks) == len(hot.cores.marks) == 2**bits // 8
    assert all(r.key in (hot.cores if r.is_core else hot.anchors) for r in keys.collect())
    if bits == 26:
        assert 99_000 < len(hot.anchors) <= 100_000
        assert sum(r.key in hot.anchors for r in keys.where("is_core").collect()) < 1000
    none = suffix_dedup._marked(keys.limit(0))
    assert len(none.anchors) == len(none.cores) == 0


def test_empty_table(make):
    assert suffix_dedup.remove_repeats(make(["a"]).limit(0)).count() == 0
