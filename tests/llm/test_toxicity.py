import math
import os
import zlib

import duckdb
import numpy as np
import pytest

from noveltide.llm import toxicity
from tests.llm.conftest import long_text

BIG = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def model():
    """Trained on invented texts in which a few words are toxic."""
    rng = np.random.default_rng(1)
    clean = [f"{a}{b}" for a in ("lo", "ta", "mi", "ru", "se") for b in ("ven", "dor", "pil", "gast", "nim")]
    texts, labels = [], []
    for k in range(240):
        w = rng.choice(clean, rng.integers(20, 200)).tolist()
        if k % 3 == 0:
            for _ in range(max(1, len(w) // 50)):
                w[rng.integers(len(w))] = rng.choice(["gribblex", "zorkful", "quuxish"])
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    return toxicity.train(texts, labels)


def loops(text, model):
    """The score by plain loops over words, n-grams and buckets."""
    m64 = (1 << 64) - 1
    words = []
    for w in text.lower().split():
        core = w.strip(toxicity._EDGES) or w
        if len(core) > toxicity.LONG_WORD:
            marked, step = f"<{core}>", toxicity.PIECE - max(toxicity.GRAMS) + 1
            words += [marked[k : k + toxicity.PIECE] for k in range(0, len(marked) - max(toxicity.GRAMS) + 1, step)]
        else:
            words.append(f"<{core}>")
    evidence = []
    for w in words:
        values = []
        for n in toxicity.GRAMS:
            for k in range(len(w) - n + 1):
                v = 0
                for c in w[k : k + n]:
                    v = (v * 0x9E3779B1 + ord(c)) & m64
                values.append(((((v + n) & m64) * 0x9E3779B97F4A7C15) & m64) >> 40)
        v = 0
        for c in w:
            v = (v * 0x9E3779B1 + ord(c)) & m64
        values.append(((((v + 99) & m64) * 0x9E3779B97F4A7C15) & m64) >> 40)
        evidence.append(sum(float(model.logit[v % toxicity.BUCKETS]) for v in values) / len(values))
    z = model.bias
    if evidence:
        top = max(evidence)
        a = [math.exp(toxicity.SHARP * (s - top)) for s in evidence]
        z += sum(x * s for x, s in zip(a, evidence, strict=True)) / sum(a)
    return 1 / (1 + math.exp(-z))


def test_scores_equal_plain_loops(model):
    score = toxicity.Scorer(model)
    for text in ("", " \n", "gribblex", "loven tador (zorkful) rupil, x", "a b c " * 50 + "quuxish!", "日本語の文章" * 40 + "gribblex", "É é ... --a--", "w" * 65 + " W"):
        assert score(text) == pytest.approx(loops(text, model), rel=1e-6), text[:20]


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    b = toxicity.bags(["one two two three", "three four", "five one five six seven"])
    emb, out, bias = rng.normal(0, 0.03, (toxicity.BUCKETS, 3)), rng.normal(0, 0.3, (2, 3)), rng.normal(0, 0.1, 2)
    rows, y = np.array([2, 0, 1]), np.array([1, 0, 1])
    loss = lambda: toxicity.loss_and_gradients(emb, out, bias, b, rows, y)[0]
    _, used, gemb, gout, gbias = toxicity.loss_and_gradients(emb, out, bias, b, rows, y)
    cells = [(emb, (int(used[k]), j), gemb[k, j]) for k in range(0, len(used), 7) for j in range(3)] + [(out, (i, j), gout[i, j]) for i in range(2) for j in range(3)] + [(bias, (i,), gbias[i]) for i in range(2)]
    for p, at, want in cells:
        old, d = p[at], 1e-5
        p[at] = old + d
        high = loss()
        p[at] = old - d
        low = loss()
        p[at] = old
        assert (high - low) / (2 * d) == pytest.approx(want, abs=2e-6, rel=1e-3)


def test_misspelled_words_share_ngrams(model):
    words = toxicity.Words(model.logit)
    clean = words("lover tavem midora rusenim")
    for w in ("gribblexx", "zorkfull", "quuxishh"):
        assert words(w)[0] > clean.max() + 1


def test_held_out_accuracy():
    if not os.path.isdir(BIG):
        pytest.skip("no labelled table")
    rows = duckdb.connect().execute(f"SELECT d.doc_id, text, toxic FROM '{BIG}/documents.parquet' d JOIN '{BIG}/labels.parquet' l ON d.doc_id = l.doc_id WHERE text IS NOT NULL ORDER BY d.doc_id").fetchall()
    seen = [r for r in rows if not held(r[0])]
    seen = [r for r in seen if r[2]][:1600] + [r for r in seen if not r[2]][:1600]
    seen.sort(key=lambda r: zlib.crc32(b"o%d" % r[0]))
    scorer = toxicity.Scorer(toxicity.train([r[1] for r in seen], [r[2] for r in seen]))
    rest = [(scorer(r[1]), r[2]) for r in rows if held(r[0])]
    wrong = sum((p >= 0.5) != bool(y) for p, y in rest)
    pos, neg = [p for p, y in rest if y], [p for p, y in rest if not y]
    assert np.mean([p > np.array(neg) for p in pos]) > 0.93 and wrong / len(rest) < 0.02  # a sixteenth of the labels 1 is noise


def test_scores_of_odd_texts(make, model):
    texts = [None, "", " ", "...", "🙂", long_text(30_000), "gribblex " * 20, "lo ven same", "lo ven same"]
    out = toxicity.score(make(texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, 7]), model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert got[0].score == got[1].score == got[2].score and got[6].predicted == 1 and got[0].predicted == 0
    assert toxicity.score(make(["a"]).limit(0), model).count() == 0


def test_toxic_terms_deep_in_long_words_count(model):
    score = toxicity.Scorer(model)
    for joint in (",", "/", "_", ""):
        clean = joint.join(["tadorlo", "minimse", "rupilta"] * 20)
        toxic = joint.join(["tadorlo", "minimse", "rupilta"] * 10 + ["gribblex", "zorkful", "quuxish"] + ["tadorlo", "minimse", "rupilta"] * 10)
        assert clean[:64] == toxic[:64] and score(clean) < 0.5 <= score(toxic), joint


def test_pieces_of_long_words_hold_each_ngram():
    for n in (65, 66, 70, 75, 76, 77, 200, 5000):
        word = "".join(chr(0x4E00 + k) for k in range(n))
        marked = f"<{word}>"
        pieces = [p[1:] for p in toxicity.tokens(f"{word}")]
        for g in toxicity.GRAMS:
            assert {marked[k : k + g] for k in range(len(marked) - g + 1)} == {p[k : k + g] for p in pieces for k in range(len(p) - g + 1)}
    assert toxicity.tokens("w" * 64 + " B") == ["w" * 64, "b"]


def test_drop_toxic_keeps_columns(make, model):
    df = make(["gribblex zorkful gribblex", "tadorlo", None])
    assert [r.doc_id for r in toxicity.drop_toxic(df, model).orderBy("doc_id").collect()] == [1, 2]
    assert toxicity.drop_toxic(df, model).columns == df.columns


def test_held_out_rows_never_train(spark, make, monkeypatch):
    used = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: used.extend(zip(texts, labels, strict=True)))
    labels = spark.createDataFrame([(i, i % 2, None if i == 7 else i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    toxicity.fit(make([f"text {i}" if i != 9 else None for i in range(40)]), labels, ~toxicity.held_out())
    want = {(f"text {i}", i % 2) for i in range(40) if not held(i) and i not in (7, 9)}
    assert set(used) == want and len(used) == len(want)


def test_one_class_and_no_labels():
    assert 0 < toxicity.Scorer(toxicity.train(["a b"], [0]))("a") < 0.5
    assert toxicity.Scorer(toxicity.train([], []))("a") == pytest.approx(0.5)


def test_text_without_spaces_counts_to_its_end(model):
    filler = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(10_000))
    score = toxicity.Scorer(model)
    assert score(filler + "gribblexzorkful") > score(filler + "tadorloloventad") + 0.1
