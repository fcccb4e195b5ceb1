"""Quality scores: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import fresh, prepare, table
from noveltide.llm.toxicity import held_out

#: Weights of the model, whatever the input.
BUCKETS = 1 << 18
#: The longest n-gram, in words.
GRAM = 2
#: Step size, its offset, and the penalties of FTRL-proximal.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 1.0
#: Passes over the sample; small samples have more, so that there are at least so many updates.
EPOCHS, LEAST_UPDATES = 4, 12_000
#: The most labelled rows that training reads, those with the smallest hash of the id; and the most characters that the driver gathers.
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 24_000_000
#: Scores from here on predict label 1.
THRESHOLD = 0.3
CACHE_ENTRIES = 400_000
#: A word is a run of letters, digits and underscores, or a run of other signs.
_WORD = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Distinct buckets of a text's word n-grams; case counts, and each distinct word is hashed once."""

    def __init__(self, buckets: int = BUCKETS, gram: int = GRAM):
        self.buckets, self.gram = np.uint64(buckets), gram
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text)
        if not words:
            return np.zeros(0, "i8")
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        code = np.fromiter(map(known.__getitem__, words), "u8", len(words)) + np.uint64(1)
        found, value = [], np.zeros(len(code), "u8")
        for n in range(1, min(self.gram, len(code)) + 1):
            value = value[: len(code) - n + 1] * _MIX + code[n - 1 :]
            found.append((value + np.uint64(n)) * _MIX >> np.uint64(24))
        return np.unique(np.concatenate(found) % self.buckets).astype("i8")


class Model(NamedTuple):
    """Weights of the buckets, and the bias."""

    weight: np.ndarray
    bias: float


def sigmoid(z: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-min(max(z, -700.0), 700.0))))


def train(texts: list[str], labels: list[int], alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """FTRL-proximal over the texts in a seeded order, one update a text.

    Each coordinate i keeps z (its gradients, less what they moved the weight) and n (their squares). Its
    weight is 0 while |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2), so words that say nothing
    keep no weight. A feature is 1 if the text has the n-gram. The bias is a coordinate without penalties.
    Without both labels the weights are 0 and the bias is the smoothed log odds.
    """
    y = np.asarray(labels, "f8")
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, "f4"), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    grams = Grams()
    rows = [grams(t) for t in texts]
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias, zb, nb = 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(max(epochs, -(-LEAST_UPDATES // len(rows)))):
        for k in rng.permutation(len(rows)):
            at = rows[k]
            w = weights(at)
            g = sigmoid(float(w.sum()) + bias) - y[k]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    return Model(weights(np.arange(BUCKETS)).astype("f4"), bias)


class Scorer:
    """The model's probability of label 1 for texts: a sparse dot product; a text without words has the bias alone."""

    def __init__(self, model: Model):
        self.model, self.grams = model, Grams(len(model.weight))

    def __call__(self, text: str) -> float:
        return sigmoid(float(self.model.weight[self.grams(text)].sum(dtype="f8")) + self.model.bias)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded, deterministic sample of labelled rows.

    `usable` is a condition on `labels`. The sample is the `sample_rows` labelled rows with the smallest
    hash of the id, so labels keep their shares; texts that would bring the characters gathered over
    `sample_chars` are left out whole. Null labels, ids and texts don't train; of rows that repeat an id,
    one does (the greatest label, the least text).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    place = F.xxhash64(F.col("id").cast("string"))
    picked = known.orderBy(place, "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    chosen, size = [], 0
    for row in rows.orderBy(place, "id").toLocalIterator(prefetchPartitions=False):
        if size + len(row.text) <= sample_chars:
            size += len(row.text)
            chosen.append(row)
    return train([r.text for r in chosen], [r.y for r in chosen])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Add `score` (double, 0 to 1) and `predicted` (1 if score >= `threshold`) to `docs`.

    Every whole text is scored in Arrow batches; the broadcast model has `BUCKETS` numbers whatever the
    input. Null and empty texts, and texts of white space, get the bias alone. Rows that repeat are each
    scored alike; an empty table stays empty. Columns of the two new names are replaced, all others kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(tuple(model))

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(Model(*sent.value))
        for texts in batches:
            yield pa.array([scorer(t.as_py() or "") for t in texts], pa.float64())

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = docs.withColumn(score_col, F.arrow_udf(of, "double")(F.col(text_col)))
    return out.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text the model predicts to be of low quality; all columns stay."""
    score_, predicted = fresh(docs, "score", "predicted")
    return score(docs, model, threshold, text_col, score_, predicted).where(F.col(predicted) == 1).drop(score_, predicted)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
