import random
import re

import numpy as np
import pytest

from noveltide.llm import jaccard_join
from noveltide.llm.components import connected_components
from noveltide.llm.shingle_sets import shingles
from tests.llm.conftest import long_text

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, n=3):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def components(sets, percent=90):
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def near_copies(rng, words, copies, edits):
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_shingles_equal_sets_of_words():
    texts = ["a b c d", "A\tB  C\nd", "", " \n", "one", "one two", "two one", "x y z x y z x y z", "é É e", long_text(3000), "a b c d"]
    row, found = shingles([t.encode() for t in texts])
    mine = [set(found[row == k].tolist()) for k in range(len(texts))]
    want = sets_of(texts)
    assert [len(s) for s in mine] == [len(s) for s in want]
    for a in range(len(texts)):
        for b in range(a):
            assert len(mine[a] & mine[b]) == len(want[a] & want[b])


def test_link_components_equals_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200).astype("u8")
    sets = [np.unique(np.r_[base[rng.random(200) > rng.choice([0.02, 0.1])], rng.integers(0, 2**63, rng.integers(0, 9)).astype("u8")]) for _ in range(40)]
    want = components([set(s.tolist()) for s in sets])
    assert jaccard_join.link_components(sets, 90).tolist() == want


@pytest.mark.parametrize("percent", [80, 90])
def test_derived_answers_equal_brute_force(percent):
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 2**63, 300).astype("u8") for _ in range(3)]
    sets = []
    for k in range(160):
        b = base[k % 3]
        sets.append(np.unique(np.r_[b[rng.random(300) > rng.choice([0.01, 0.04, 0.12])], rng.integers(0, 2**63, rng.integers(0, 12)).astype("u8")]))
    tally = {}
    assert jaccard_join.link_components(sets, percent, tally=tally).tolist() == components([set(s.tolist()) for s in sets], percent)
    assert tally["listed"] < 30 and tally["derived"] + tally["bounded"] > 130 and tally["bounded"] > 0
    sides = rng.integers(0, 2, len(sets))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sides[a] != sides[b] and (i := len(set(sets[a].tolist()) & set(sets[b].tolist()))) and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i)]
    want = list(range(len(sets)))
    for a, b in links:
        old, new = max(want[a], want[b]), min(want[a], want[b])
        want = [new if x == old else x for x in want]
    assert jaccard_join.link_components(sets, percent, sides).tolist() == want


@pytest.mark.parametrize("percent", [80, 90])
def test_blocks_skip_what_a_walk_over_all_pairs_skips(percent):
    rng = np.random.default_rng(9)
    n = 3000
    lists, size = rng.integers(0, 60, n) ** 2 // 40, rng.integers(5, 60, n)
    size[rng.random(n) < 0.4] = 30
    pos = (rng.random(n) * jaccard_join.prefix_length(size, percent)).astype("i4")
    sketch = rng.multinomial(1, [1 / 32] * 32, (n, 60))
    sketch = np.where(np.arange(60)[None, :, None] < size[:, None, None], sketch, 0).sum(1).astype("u2")
    sketch[::3] = sketch[0]
    want, pairs = np.zeros(n, bool), 0
    for k in np.unique(lists):
        own = np.flatnonzero(lists == k)
        for x in range(len(own)):
            for y in range(x):
                a, b = sorted((own[x], own[y]), key=lambda e: size[e])
                least = -(-percent * (size[a] + size[b]) // (100 + percent))
                pairs += 1
                if 100 * size[a] >= percent * size[b] and 1 + min(size[a] - pos[a] - 1, size[b] - pos[b] - 1) >= least and abs(sketch[a].astype(int) - sketch[b]).sum() <= size[a] + size[b] - 2 * least:
                    want[[a, b]] = True
    tally = {}
    assert (jaccard_join.linkable(lists, size, pos, sketch, percent, tally) == want).all()
    assert tally["pairs"] == pairs and tally["sketches_left"] < tally["blocks_left"] < pairs / 2


def test_components_of_chains_stars_and_odd_edges(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 70)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(500, 500), (None, 7), (8, None), (3, 2), (3, 2)]
    want = {k: k for e in edges if None not in e for k in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                want[a] = want[b] = min(want[a], want[b])
    del want[500]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("limits", [{}, {"LONG_LIST": 3, "GROUP": 8}])
def test_operator_against_brute_force(make, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard_join, k, v)
    rng = random.Random(4)
    texts = [None, "", "  \n", "one", "ONE", "one two", "one two", "a b c", "a b c d", long_text(4000), long_text(3900)]
    for size in (12, 40, 150):
        words = [f"v{rng.randrange(60)}" for _ in range(size)]
        texts += near_copies(rng, words, 25, max(1, size // 25))
    texts += near_copies(rng, long_text(300, 9000).split(), 40, 3)
    rng.shuffle(texts)
    sets = sets_of(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(make(texts)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, components(sets), strict=True))}


def test_repeated_rows_null_ids_and_empty_tables(make):
    out = jaccard_join.similar_documents(make(["a b c", "a b c", "a b c", None, "q"], ids=[4, 4, None, None, 2])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == [(0, 0, 0), (0, 1, 4), (2, 1, 2), (4, 1, 4), (4, 1, 4)]
    assert jaccard_join.similar_documents(make(["a"]).limit(0)).count() == 0


def test_keep_one(make):
    df = make(["a b c d", "A b c d", None, "", "z"], ids=[9, 3, 4, 5, 6])
    assert sorted(r.doc_id for r in jaccard_join.keep_one(df).collect()) == [3, 4, 5, 6]
    assert jaccard_join.keep_one(df).columns == df.columns


def test_keep_one_takes_the_length_of_shingles(make):
    words = [f"v{k}" for k in range(100)]
    other = [w if k not in (30, 70) else f"e{k}" for k, w in enumerate(words)]
    df = make([" ".join(words), " ".join(other)])
    assert [r.doc_id for r in jaccard_join.keep_one(df, 80, n=5).collect()] == [0]
    assert sorted(r.doc_id for r in jaccard_join.keep_one(df, 83, n=5).collect()) == [0, 1]
    assert sorted(r.doc_id for r in jaccard_join.keep_one(df).collect()) == [0, 1]


def test_cut_groups_whose_leader_has_gone_to_a_smaller_one(make, monkeypatch):
    """A long row of texts of which each nearly links to the next: leaders are themselves under smaller leaders, and groups are cut."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    texts = [long_text(200, start) for start in np.cumsum([8, 11, 11] * 100).tolist()]
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(make(texts)).collect()}
    want = components(sets_of(texts))
    assert [got[k] for k in range(len(texts))] == want


@pytest.mark.parametrize("most_held", [10, 1_000_000])
def test_packed_lists_keep_every_pair_that_may_link(most_held, monkeypatch):
    """Entries come packed by bucket, sets more than once; long lists go on whole and under one leader, also where a bucket is gathered in parts."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "LONG_LIST", 12)
    rng = np.random.default_rng(5)
    sets, batches, lists = rng.integers(0, 2**63, (40, 2)).astype(">u8"), [], {}
    size, sketch = rng.integers(300, 330, 40), rng.integers(0, 40, (40, 32)).astype("u1")
    sketch[::2] = sketch[0]
    for bucket in range(2):
        for _ in range(9):
            who = rng.integers(0, 40, 30)
            token = (rng.geometric(0.2, 30) * 2 + bucket).astype("u8")
            batches.append(pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([jaccard_join._pack(token, sets[who], size[who], np.zeros(30, "i8"), sketch[who])], pa.binary())], ["bucket", "entries"]))
            for t, w in zip(token.tolist(), who.tolist(), strict=True):
                lists.setdefault(t, set()).add(w)
    groups = {}
    for b in jaccard_join._filter_lists(90, most_held)(iter(batches)):
        for leader, sid in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            groups.setdefault(leader, set()).add(sid)
    together = {(a, b) for g in groups.values() for a in g for b in g}
    name = [s.tobytes() for s in sets]
    assert all(leader in g for leader, g in groups.items())
    for t, held in lists.items():
        for a in held:
            for b in held:
                apart = np.abs((sketch[a] - sketch[b]).view("i1").astype(int)).sum()
                least = -(-90 * (size[a] + size[b]) // 190)
                if a != b and (len(held) > 12 or (100 * min(size[a], size[b]) >= 90 * max(size[a], size[b]) and apart <= size[a] + size[b] - 2 * least)):
                    assert (name[a], name[b]) in together, t


def test_finer_sketches_part_large_sets_and_keep_links():
    """Sets of thousands of shingles look alike in 32 cells; the finer sketch parts all that don't link and none that do, also across widths."""
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype="u8")) for n in (5000, 5010, 5100, 8190, 8200, 60, 61, 70_000, 70_001)]
    for k in (0, 3, 5, 7):
        for share in (0.06, 0.03):
            kept = sets[k][rng.random(len(sets[k])) >= share]
            sets.append(np.unique(np.r_[kept, rng.integers(0, 2**64, len(sets[k]) // 50, dtype="u8")]))
    coarse = np.stack([np.bincount((s >> np.uint64(59)).astype("i8"), minlength=32).astype("u1") for s in sets])
    size = np.array([len(s) for s in sets])
    assert jaccard_join.linkable(np.zeros(3, "u8"), size[:3], np.zeros(3, "i8"), coarse[:3], 90).all()
    want = components([set(s.tolist()) for s in sets])
    got = jaccard_join.sketch_components(size, [jaccard_join.fine_sketch(s) for s in sets], 90)
    assert all(got[a] == got[b] for a in range(len(sets)) for b in range(a) if want[a] == want[b])
    assert len({int(got[k]) for k in (0, 1, 2, 3, 4)}) == 5
    assert jaccard_join.sketch_components(size[:5], [jaccard_join.fine_sketch(s) for s in sets[:5]], 90).tolist() == list(range(5))


def test_texts_without_places_are_not_shuffled(make, spark, monkeypatch):
    """Large unlike texts that share a rare shingle have no place; whole groups beyond `COMPARED` do, with the same components."""
    blocks = [[" ".join(f"w{k}x{j}" for j in range(b, b + 60)) for b in range(0, 7980, 60)] for k in range(2)]
    texts = [long_text(300, 5), long_text(300, 6)] + [" ".join([*own, "one rare shingle"]) for own in blocks] + 3 * (blocks[0] + blocks[1])
    sent = []
    materialize = jaccard_join.materialize

    def seen(df, name):
        out = materialize(df, name)
        if name == "places":
            sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", seen)
    want = components(sets_of(texts))
    for most, places in ((4096, 2), (1, 4)):
        monkeypatch.setattr(jaccard_join, "COMPARED", most)
        got = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(make(texts)).collect()}
        assert [got[k] for k in range(len(texts))] == want
        assert sent[-1] == places
