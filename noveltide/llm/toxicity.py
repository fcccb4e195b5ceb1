"""Toxicity scores from subword-bag embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import fresh, prepare, table

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5, 6)
#: Passes over the sample, and the fewest steps; small samples have more passes.
EPOCHS = 5
LEAST_STEPS = 100
#: Scale of the averaged embeddings, how strongly a word's own evidence weights it, and the pull of embeddings to 0.
GAIN, SHARP, DECAY = 20.0, 4.0, 3e-4
#: Power of the loss (1 - p**q) / q: a label that the model finds unlikely pulls less, so wrong labels are hardly learnt by heart.
POWER = 0.7
#: Buckets of fewer sampled texts keep no evidence; words of one text say nothing about others.
LEAST_TEXTS = 5
#: The most labelled rows that training reads; they're those with the smallest hash of the id.
SAMPLE_ROWS = 3200
#: The most characters of sampled texts that the driver gathers; later sampled rows are left out whole.
SAMPLE_CHARS = 24_000_000
CACHE_ENTRIES = 400_000
_BASE, _MIX = np.uint64(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)
#: Words of more characters (URLs, lists without spaces, Chinese or Thai sentences) count as pieces, which overlap so that each n-gram is whole in one.
LONG_WORD, PIECE = 64, 16
_EDGES = ".,;:!?()[]{}\"'|#$%&*_-+=/\\<>~^`"


def tokens(text: str) -> list[str]:
    """Words between white space; a long word is given as its pieces, edges marked, each with a space before it to tell it from a word."""
    words = text.lower().split()
    if len(text) <= LONG_WORD or max(map(len, words), default=0) <= LONG_WORD:
        return words
    return [p for w in words for p in (_pieces(w) if len(w) > LONG_WORD else (w,))]


def _pieces(word: str) -> list[str]:
    core = word.strip(_EDGES) or word
    if len(core) <= LONG_WORD:
        return [word]
    marked, step = f"<{core}>", PIECE - max(GRAMS) + 1
    return [f" {marked[k : k + PIECE]}" for k in range(0, len(marked) - max(GRAMS) + 1, step)]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word or piece of `tokens` and of its character n-grams, edges marked: flat, and how many each word has.

    A bucket is a polynomial hash of the code points and the length, modulo
    `BUCKETS`, computed for all words at once.
    """
    marked = [w[1:] if w[0] == " " else f"<{w.strip(_EDGES) or w}>" for w in words]
    sizes = np.fromiter(map(len, marked), "i8", len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    begin = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    left = sizes[word] - (np.arange(len(code)) - begin[word])
    found, owner = [], []
    value = np.zeros(len(code), "u8")
    for n in range(1, max(GRAMS) + 1):
        value = value * _BASE
        value[: max(0, len(code) - n + 1)] += code[n - 1 :]
        if n in GRAMS:
            fits = left >= n
            found.append((value[fits] + np.uint64(n)) * _MIX >> np.uint64(40))
            owner.append(word[fits])
    powers = _BASE ** (left - 1).astype("u8")
    whole = np.add.reduceat(code * powers, begin) if len(code) else np.zeros(0, "u8")
    found.append((whole + np.uint64(99)) * _MIX >> np.uint64(40))
    owner.append(np.arange(len(sizes)))
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype("i4"), np.bincount(owner_all, minlength=len(sizes))


class Words:
    """Logits of a text's words, each distinct word computed once."""

    def __init__(self, logit: np.ndarray):
        self.logit = logit
        self.cache: dict[str, float] = {}

    def __call__(self, text: str) -> np.ndarray:
        cache, words = self.cache, tokens(text)
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        if missing := [w for w in set(words) if w not in cache]:
            flat, sizes = subwords(missing)
            means = np.add.reduceat(self.logit[flat].astype("f8"), np.cumsum(sizes) - sizes) / sizes
            cache.update(zip(missing, means.tolist(), strict=True))
        return np.fromiter(map(cache.__getitem__, words), "f8", len(words))


class Bags(NamedTuple):
    """Texts as bags of words, and words as bags of buckets; both flat, with edges."""

    word: np.ndarray
    count: np.ndarray
    text_edge: np.ndarray
    bucket: np.ndarray
    word_edge: np.ndarray


def bags(texts: list[str]) -> Bags:
    known: dict[str, int] = {}
    word: list[np.ndarray] = []
    count: list[np.ndarray] = []
    edge = [0]
    for text in texts:
        own: dict[str, int] = {}
        for w in tokens(text):
            own[w] = own.get(w, 0) + 1
        word.append(np.array([known.setdefault(w, len(known)) for w in own], "i4"))
        count.append(np.array(list(own.values()), "f4"))
        edge.append(edge[-1] + len(own))
    every = list(known)
    parts = [subwords(every[k : k + 20_000]) for k in range(0, len(every), 20_000)]  # a part at a time bounds the driver's memory
    flat = np.concatenate([np.zeros(0, "i4"), *(f for f, _ in parts)])
    sizes = np.concatenate([np.zeros(0, "i8"), *(s for _, s in parts)])
    return Bags(np.concatenate([np.zeros(0, "i4"), *word]), np.concatenate([np.zeros(0, "f4"), *count]), np.array(edge, "i8"), flat, np.r_[0, np.cumsum(sizes)].astype("i8"))


def _spans(edge: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the given rows' entries, one row after the other, their numbers, and where each row begins."""
    n = edge[rows + 1] - edge[rows]
    begin = np.cumsum(n) - n
    return np.repeat(edge[rows] - begin, n) + np.arange(n.sum()), n, begin


def loss_and_gradients(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, b: Bags, rows: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The mean over the given texts (none empty) of (1 - p**POWER) / POWER, p being the label's probability; the buckets used; gradients of these embeddings, the softmax and its bias.

    A word's vector e is the mean of its buckets' embeddings, and its evidence s
    = GAIN * e . (out[1] - out[0]). A text's vector h is the average of its words', weighted by their counts times exp(SHARP * s),
    and GAIN * h goes through the linear softmax. Gradients go through the weights too.
    """
    at, n, begin = _spans(b.text_edge, rows)
    word, back = np.unique(b.word[at], return_inverse=True)
    flat, size, first = _spans(b.word_edge, word)
    used, place = np.unique(b.bucket[flat], return_inverse=True)
    e = (np.add.reduceat(emb[used][place], first) / size[:, None])[back]
    way = GAIN * (out[1] - out[0])
    t = SHARP * (e @ way)
    a = b.count[at] * np.exp(t - np.repeat(np.maximum.reduceat(t, begin), n))
    a /= np.repeat(np.add.reduceat(a, begin), n)
    h = np.add.reduceat(a[:, None] * e, begin)
    z = GAIN * (h @ out.T) + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    own = np.arange(len(rows))
    damped = p[own, y] ** POWER
    loss = float((1 - damped).mean() / POWER)
    p[own, y] -= 1
    g = p * (damped / len(rows))[:, None]
    gh = np.repeat(GAIN * (g @ out), n, axis=0)
    gs = SHARP * a * (gh * (e - np.repeat(h, n, axis=0))).sum(1)
    ge = a[:, None] * gh + gs[:, None] * way
    turn = GAIN * (gs[:, None] * e).sum(0)
    gout = GAIN * (g.T @ h) + np.stack([-turn, turn])
    dim = emb.shape[1]
    gw = np.stack([np.bincount(back, ge[:, k], len(word)) for k in range(dim)], 1) / size[:, None]
    gw = np.repeat(gw, size, axis=0)
    gemb = np.stack([np.bincount(place, gw[:, k], len(used)) for k in range(dim)], 1)
    return loss, used, gemb, gout, g.sum(0)


class Model(NamedTuple):
    """All that a score needs of the trained net: each bucket's evidence, and the bias."""

    logit: np.ndarray
    bias: float


def train(texts: list[str], labels: list[int], rate: float = 0.03, batch: int = 64, seed: int = 7) -> Model:
    """Fit embeddings, pooling weights and linear softmax jointly with Adam.

    A plain average is a weak signal where a few words in a thousand are toxic,
    so a word's weight in the average grows with its own evidence, in training as in scoring. Without both labels all evidence is 0 and
    the bias is the (smoothed) log odds of label 1. Texts without words don't train.
    """
    y = np.asarray(labels, "i8")
    b = bags(texts)
    filled = np.flatnonzero(np.diff(b.text_edge))
    if len(set(y[filled].tolist())) < 2:
        return Model(np.zeros(BUCKETS, "f4"), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    texts_of = np.zeros(BUCKETS, "i4")
    for k in filled:
        texts_of[np.unique(b.bucket[_spans(b.word_edge, b.word[b.text_edge[k] : b.text_edge[k + 1]])[0]])] += 1
    kept = (texts_of >= min(LEAST_TEXTS, len(filled)))[:, None]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1e-3, (BUCKETS, DIM)).astype("f4") * kept
    out = rng.normal(0, 0.3, (2, DIM)).astype("f4")
    bias = np.zeros(2, "f4")
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    epochs, step = max(EPOCHS, -(-LEAST_STEPS * batch // len(filled))), 0
    for epoch in range(epochs):
        order = rng.permutation(filled)
        lr = rate * (1 - epoch / epochs)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            step += 1
            _, used, gemb, gout, gbias = loss_and_gradients(emb, out, bias, b, rows, y[rows])
            for p, gr, (m, v), at in ((out, gout, moments[1], slice(None)), (bias, gbias, moments[2], slice(None)), (emb, (gemb + DECAY * emb[used]) * kept[used], moments[0], used)):
                m[at] = 0.9 * m[at] + 0.1 * gr
                v[at] = 0.99 * v[at] + 0.01 * gr * gr
                p[at] -= lr * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-8)
    return Model((GAIN * (emb @ (out[1] - out[0]))).astype("f4"), float(bias[1] - bias[0]))


class Scorer:
    """The joint softmax's probability of label 1 for texts; a text without words has the bias alone."""

    def __init__(self, model: Model):
        self.words, self.bias = Words(model.logit), model.bias

    def __call__(self, text: str) -> float:
        s, z = self.words(text), self.bias
        if len(s):
            a = np.exp(SHARP * (s - s.max()))
            z += float((a @ s) / a.sum())
        return 1.0 / (1.0 + float(np.exp(-min(max(z, -700.0), 700.0))))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded, deterministic sample of labelled rows.

    `usable` is a condition on `labels`. The sample is half label 1 and half
    label 0 as far as there are that many, each the rows with the smallest
    hash of the id; texts that would bring the characters gathered over `sample_chars` are
    left out whole. Null labels, ids and texts don't train; of rows that repeat an id, one text does (the least).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    picked = None
    for value in (0, 1):
        some = known.where(F.col("y") == value).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_rows // 2)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").toLocalIterator(prefetchPartitions=False)
    chosen, size = [], 0
    for row in rows:
        if size + len(row.text) <= sample_chars:
            size += len(row.text)
            chosen.append(row)
    return train([r.text for r in chosen], [r.y for r in chosen])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Add `score` (double, 0 to 1) and `predicted` (1 if score >= 0.5) to `docs`.

    Every whole text is scored in Arrow batches; the broadcast model has
    `BUCKETS` numbers whatever the input. A null or empty text gets the
    intercept alone. Columns of the two new names are replaced, all others kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(tuple(model))

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(Model(*sent.value))
        for texts in batches:
            yield pa.array([scorer(t or "") for t in texts.to_pylist()], pa.float64())

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = docs.withColumn(score_col, F.arrow_udf(of, "double")(F.col(text_col)))
    return out.withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text the model predicts to be toxic; all columns stay."""
    score_, predicted = fresh(docs, "score", "predicted")
    scored = score(docs, model, text_col, score_, predicted)
    return scored.where(F.col(predicted) == 0).drop(score_, predicted)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
