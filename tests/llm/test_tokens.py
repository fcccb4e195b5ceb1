import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noveltide.llm import chunks, packing
from noveltide.llm.common import by_bytes
from noveltide.llm.token_counts import token_counts
from tests.llm.conftest import long_text

ODD = [
    "", None, " ", "\n", "a  b", "a   b c\n\n d", "x \n y", " lead", "trail  ", "tab\t\tq <|endoftext|> z", "a\x1c b", "é ́ x", "don't  'll we'll'd I'LL", "жab ab5 5ab aж x² ²5", "a_b _c a'b 'tis ''s",
    "日本 語a a日", "naïve café́s", "| foo | bar", "%%%a***b", "\r\na\r\n\r\n b", "\xa0x\xa0 y", "x y", "<|startoftext|>Hi", "🙂🙃 🙂", "á ́b", "ΑΣ ΑΣΑ", "ſt ŉ ǅ", long_text(20_000), "q" * 50_000,
]


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(make):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in token_counts(make(ODD), public_tokenizers.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(ODD):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), repr(t)[:40]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_vocabularies(make, name):
    texts = [t for t in ODD if t and len(t) < 40_000]
    got = [r.n_tokens for r in token_counts(make(texts), public_tokenizers.path(name), drops_space=False).orderBy("doc_id").collect()]
    if name.endswith(".json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        assert got == [len(x) for x in library.encode(texts)]


def test_repeated_rows_nulls_and_empty_tables(make):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = token_counts(make(["a b", "a b", None], ids=[1, 1, None]), path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 0), (1, 2), (1, 2)]
    assert token_counts(make(["a"]).limit(0), path).count() == 0


def test_ids_equal_the_library(byte_level):
    texts = [t or "" for t in ODD]
    for encode in (chunks.Ids(public_tokenizers.path("byte_bpe_50k.json")),):
        for _ in range(2):
            for t, ids in zip(texts, encode(texts), strict=True):
                assert ids.tolist() == byte_level.encode(t, add_special_tokens=False).ids, repr(t)[:40]


def test_random_texts_equal_the_library(byte_level):
    rng = np.random.default_rng(1)
    letters = list("abcDE'é5²_ж .,-!\n\t\xa0|<>") + ["'s", "  ", " the", "<|endoftext|>", "日"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(800)]
    for t, ids in zip(texts, chunks.Ids(public_tokenizers.path("byte_bpe_50k.json"))(texts), strict=True):
        assert ids.tolist() == byte_level.encode(t, add_special_tokens=False).ids, repr(t)


def test_white_space_before_words_equals_the_library(byte_level):
    rng = np.random.default_rng(5)
    pieces = ["\n", "\n\n", "\t", "\r\n", " ", "  ", "foo", "a", "é", "5", ".", "'", "日", "_"]
    texts = ["First line.\n\nSecond line.", "a\n\nfoo", "\n\nfoo", "a\t\tfoo", "a \nfoo", "a\r\nfoo", "a\n\n foo", "a.\n\n\nfoo\n\n", "5\n\nfoo's\n\n'foo"]
    texts += ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(3000)]
    for t, ids in zip(texts, chunks.Ids(public_tokenizers.path("byte_bpe_50k.json"))(texts), strict=True):
        assert ids.tolist() == byte_level.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("n", [1, 511, 512, 1023, 1024, 1025, 1535, 1536, 2047, 2048, 2049, 3584, 4096, 10_000])
def test_cut_points(n):
    p = packing.cut_points(n)
    assert p[0] == 0 and p[-1] == n and all(0 < b - a <= 2048 for a, b in zip(p[:-1], p[1:], strict=True))


def test_assign_keeps_capacity_and_takes_the_cheapest_sequence():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 2049, 3000))[::-1]
    where, offset = packing.assign(lengths)
    for k in range(where.max() + 1):
        own = np.flatnonzero(where == k)
        assert offset[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()] and lengths[own].sum() <= 2048
    room, cost = [2048] * -(-int(lengths.sum()) // 2048), []
    cost = [0.0] * len(room)
    for n, k in zip(lengths.tolist(), where.tolist(), strict=True):
        able = [j for j in range(len(room)) if room[j] >= n]
        if able:
            assert k == min(able, key=lambda j: (cost[j], j))
        else:
            assert k == len(room)
            room.append(2048)
            cost.append(0.0)
        room[k] -= n
        cost[k] += packing.LINEAR * n + packing.QUADRATIC * n * n


def test_packing_holds_each_id_once(make, byte_level):
    texts = [t for t in ODD if t is None or len(t) < 40_000 or t.startswith("w")] + ["same text"] * 3
    ids = [*range(len(texts) - 3), 900, 900, None]
    rows = packing.pack_documents(make(texts, ids=ids), public_tokenizers.path("byte_bpe_50k.json")).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in zip(ids[:-3], texts, strict=False):
        want = np.array([*byte_level.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    assert len(pieces[900]) == 2 and len(pieces[None]) == 1
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(make(["a"]).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_rows_alike_in_all_keys_are_packed_a_bounded_number_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_TIMES", 2)
    rows = [(None, 0, 700, 5, 700)] * 95 + [(k, 0, 100 + k, k, 100 + k) for k in range(40)]
    pieces = spark.createDataFrame(rows, "id long, start long, length long, ids_crc32 long, doc_tokens long")
    out = packing.pack(pieces, group_pieces=10).collect()
    assert sorted((r.id if r.id is not None else -1, r.length) for r in out) == sorted((r[0] if r[0] is not None else -1, r[2]) for r in rows)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_batches_are_balanced_by_bytes():
    sizes = [5, 0, 90, 3, 3, 300, 1, 99, 1]
    cuts = list(by_bytes(sizes, 100))
    assert [i for i, _ in cuts][1:] == [j for _, j in cuts][:-1] and cuts[0][0] == 0 and cuts[-1][1] == len(sizes)
    assert all(sum(sizes[i:j]) <= 100 or j == i + 1 for i, j in cuts) and list(by_bytes([])) == []


def test_a_vocabulary_of_another_kind_goes_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, library = chunks.Ids(path), Tokenizer.from_file(path)
    assert encode.fast is None
    for t in ("Some words, AND more.", ""):
        assert encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
