"""Whitening of embeddings: compensated covariance, eigenvectors by divide and conquer, whitened components."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import prepare, table
from noveltide.session import materialize

COMPONENTS = 16
#: The driver solves a d x d problem; wider vectors must be reduced first.
MOST_FEATURES = 2048
#: Rows whose outer products are made together, and the bits that a slice of an entry keeps, so that sums of their products are exact.
ROWS, BITS = 1024, 21
#: Slices of an entry; products of slices beyond the double-double's last bit are left out.
SLICES = 5
#: Tasks' sums are first added up in so many groups.
GROUPS = 32
#: Components whose share of the largest eigenvalue is below this don't vary, but for rounding.
NO_VARIANCE = 1e-14


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and what rounding lost, exactly (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(hi: np.ndarray, lo: np.ndarray, more_hi: np.ndarray, more_lo: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-double numbers."""
    s, e = two_sum(hi, more_hi)
    t, f = two_sum(lo, np.broadcast_to(more_lo, np.shape(lo)))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def column_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums of the columns, by halving the rows."""
    hi, lo = x, np.zeros_like(x)
    while len(hi) > 1:
        half = len(hi) // 2
        rest = hi[2 * half :], lo[2 * half :]
        hi, lo = add(hi[:half], lo[:half], hi[half : 2 * half], lo[half : 2 * half])
        hi, lo = np.concatenate([hi, rest[0]]), np.concatenate([lo, rest[1]])
    return (hi[0], lo[0]) if len(hi) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))


def slices(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Parts whose sum is hi + lo, each of `BITS` bits on a grid of its column's own, largest first."""
    top = np.abs(hi).max(axis=0, initial=0.0)
    grid = np.ldexp(1.0, np.frexp(np.where(top > 0, top, 1.0))[1] - BITS)
    out = []
    for _ in range(SLICES):
        part = np.rint(hi / grid) * grid
        out.append(part)
        hi, lo = two_sum(hi - part, lo)
        grid = np.ldexp(grid, -BITS)
    return out


def outer_products(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum of the rows' outer products.

    The product of two slices is free of error, over up to `ROWS` rows, as each entry takes BITS bits on a fixed grid
    (error-free transformation of a matrix product); only adding these products rounds, and is compensated.
    """
    d = hi.shape[1]
    total = np.zeros((d, d)), np.zeros((d, d))
    for a in range(0, len(hi), ROWS):
        parts = slices(hi[a : a + ROWS], lo[a : a + ROWS])
        for i in range(SLICES):
            for j in range(i, SLICES - i):
                p = parts[i].T @ parts[j]
                total = add(*total, p)
                if i != j:
                    total = add(*total, p.T)
    return total


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(0)
    return np.asarray(flat.flatten()).reshape(len(flat), -1).astype("f8")


_PARTIAL = "n long, hi binary, lo binary"


def _reduced(partial: DataFrame, groups: int = GROUPS) -> tuple[int, np.ndarray, np.ndarray]:
    """The tasks' double-double sums added up, in groups and then all, high and low parts each; the driver gets one row."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hi, lo = 0, None, None
        for b in batches:
            for count, h, o in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h, o = np.frombuffer(h), np.frombuffer(o)
                n, (hi, lo) = n + count, (h, o) if hi is None else add(hi, lo, h, o)
        if hi is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([hi.tobytes()]), pa.array([lo.tobytes()])], ["n", "hi", "lo"])

    found = partial.repartition(groups).mapInArrow(merge, _PARTIAL).repartition(1).mapInArrow(merge, _PARTIAL).collect()
    return (found[0].n, np.frombuffer(found[0].hi), np.frombuffer(found[0].lo)) if found else (0, np.zeros(0), np.zeros(0))


class Sums(NamedTuple):
    """Rows, and each dimension's sum as high and low parts."""

    n: int
    hi: np.ndarray
    lo: np.ndarray

    def exact(self) -> list[int]:
        """The sums of whole numbers, as integers."""
        return [int(h) + int(o) for h, o in zip(self.hi, self.lo, strict=True)]

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The means as double-double numbers: the quotient, and what it leaves."""
        hi = (self.hi + self.lo) / self.n
        product, error = two_product(hi, np.full_like(hi, self.n))
        return hi, ((self.hi - product) - error + self.lo) / self.n


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded product and what rounding lost, exactly (Dekker)."""
    p = a * b
    split = lambda v: (t := 134217729.0 * v) - (t - v)
    ah, bh = split(a), split(b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def sums(vectors: DataFrame) -> Sums:
    """Compensated sums of the one array column of `vectors`; its arrays are of one length, without nulls."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hi, lo = 0, None, None
        for b in batches:
            if b.num_rows:
                own = column_sums(_rows_of(b))
                n, (hi, lo) = n + b.num_rows, own if hi is None else add(hi, lo, *own)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([hi.tobytes()]), pa.array([lo.tobytes()])], ["n", "hi", "lo"])

    return Sums(*_reduced(vectors.mapInArrow(partial, _PARTIAL)))


def covariance(vectors: DataFrame, s: Sums) -> tuple[np.ndarray, np.ndarray]:
    """Double-double covariance, divisor n, of the array column about the mean of `s`; entries are centred before they're multiplied."""
    d = len(s.hi)
    sent = vectors.sparkSession.sparkContext.broadcast(s.mean())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rest = sent.value
        n, hi, lo = 0, np.zeros((d, d)), np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                c_hi, c_lo = two_sum(_rows_of(b), -mean)
                n, (hi, lo) = n + b.num_rows, add(hi, lo, *outer_products(*two_sum(c_hi, c_lo - rest)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([hi.tobytes()]), pa.array([lo.tobytes()])], ["n", "hi", "lo"])

    n, hi, lo = _reduced(vectors.mapInArrow(partial, _PARTIAL))
    high = hi / n
    product, error = two_product(high, np.full_like(high, n))
    return high.reshape(d, d), (((hi - product) - error + lo) / n).reshape(d, d)


class Whitening(NamedTuple):
    """Mean (high and low), components as columns by falling eigenvalue, eigenvalues, and the trace of the covariance."""

    n: int
    mean: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def varies(self) -> np.ndarray:
        """Which components vary at all."""
        return self.values > NO_VARIANCE * max(float(self.values.max(initial=0.0)), 0.0)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on the components over the root of the eigenvalue; NaN for components that don't vary."""
        scale = np.sqrt(np.where(self.varies, self.values, np.nan))
        return ((x - self.mean) - self.rest) @ self.vectors / scale


def fit(vectors: DataFrame, components: int = COMPONENTS, s: Sums | None = None) -> Whitening:
    """Fit on every row of the one array column of `vectors`, none null and all of one length.

    The eigenvectors are LAPACK's by Householder tridiagonal form and divide and conquer (syevd). Only d x d numbers
    come to the driver. Components beyond d don't exist. Raises for tables without rows and above `MOST_FEATURES`.
    """
    prepare(vectors.sparkSession)
    s = s or sums(vectors)
    if not s.n:
        raise ValueError("no rows to fit on")
    if len(s.hi) > MOST_FEATURES:
        raise ValueError(f"{len(s.hi)} features; at most {MOST_FEATURES}")
    hi, lo = covariance(vectors, s)
    both = hi + lo
    values, vecs = np.linalg.eigh((both + both.T) / 2)
    first = np.argsort(-values, kind="stable")[:components]
    return Whitening(s.n, *s.mean(), np.ascontiguousarray(vecs[:, first]), values[first], float(hi.trace() + lo.trace()))


def whiten(df: DataFrame, model: Whitening, features_col: str = "features", out_col: str = "whitened") -> DataFrame:
    """Add `out_col` (array<double>), one number a component (null where the component doesn't vary), in Arrow batches."""
    prepare(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(tuple(model))

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Whitening(*sent.value)
        k = len(own.values)
        for x in batches:
            flat = own.apply(np.asarray(x.flatten()).reshape(len(x), len(own.mean)).astype("f8")).ravel() if len(x) else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(flat, from_pandas=True))

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out_col, F.arrow_udf(of, "array<double>")(F.col(features_col)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry, by amount, of the whitened rows' covariance less the identity, over components that vary; 0.0 where none does."""
    some = np.flatnonzero(model.varies)
    if not len(some):
        return 0.0
    whitened = whiten(vectors.toDF("x"), model, "x", "w").select(F.slice("w", 1, len(some)).alias("w"))  # the values fall, so these come first
    hi, lo = covariance(whitened, sums(whitened))
    return float(np.abs(hi + lo - np.eye(len(some))).max())


def finite_vectors(df: DataFrame, features_col: str) -> DataFrame:
    """Rows whose vector is neither null nor empty, holds no null or non-finite entry, and is of the most frequent length (of several, the greatest)."""
    x = F.col(features_col)
    good = df.where(x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))))
    most = good.groupBy(F.size(x).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size(x) == most.d) if most else good


def whiten_distinct(df: DataFrame, features_col: str, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, Sums, float]:
    """Whiten `df` by its distinct vectors: (df with `whitened`, the model, sums of the distinct vectors, the identity's error).

    Repeated vectors count once, however many rows hold them; tasks drop their own repeats before anything is shuffled. `df`
    comes from `finite_vectors`; an empty one stays empty, with no model.
    """
    prepare(df.sparkSession)
    distinct = materialize(df.select(F.col(features_col).alias("x")).distinct(), "vectors")
    s = sums(distinct)
    if not s.n:
        return df.withColumn("whitened", F.array().cast("array<double>")), None, s, 0.0
    model = fit(distinct, components, s)
    return whiten(df, model, features_col), model, s, identity_error(distinct, model)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as whole numbers floor(64 c) + 1000000, whitened by their distinct values; a row per vector and component.

    Rows that repeat are each returned, a null id stays null. A component that doesn't vary has whitened null and
    explained 0; with fewer dimensions than 16 there are as many components. Deviations beyond a long raise an error.
    """
    rows = finite_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    rows = rows.select("vec_id", F.transform("embedding", lambda c: (F.floor(F.lit(64.0) * c.cast("double")) + 1_000_000).cast("long")).alias("x"))
    out, model, s, error = whiten_distinct(rows, "x")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    total = F.array(*map(F.lit, s.exact()))
    apart = F.zip_with("x", total, lambda x, t: F.lit(s.n) * x - t)
    out = out.withColumn("deviation", F.aggregate(apart, F.lit(0).cast("long"), lambda a, v: a + v * v))
    share = F.array(*(F.lit(float(e) / model.trace if v else 0.0) for e, v in zip(model.values, model.varies, strict=True)))
    out = out.select("vec_id", "deviation", "whitened", share.alias("explained"))
    out = out.select("vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(s.n).cast("long").alias("n"), "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), F.lit(error).alias("identity_error"))
