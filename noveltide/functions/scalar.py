"""Scalar and vector expressions; all run inside Spark, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def inf_to_nan(x: Column) -> Column:
    """Infinite values become NaN."""
    return F.when(F.abs(x) == float("inf"), float("nan")).otherwise(x)


def inf_to_null(x: Column) -> Column:
    """Infinite and NaN values become null, the form that aggregates skip."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def nan_to(x: Column, value: float = 1.0) -> Column:
    """NaN and null become `value`."""
    return F.coalesce(F.nanvl(x, F.lit(value)), F.lit(value))


def clamp_low(x: Column, low: float) -> Column:
    """The larger of x and `low`; NaN stays NaN, as in array code."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(x, F.lit(low)))


def clamp_high(x: Column, high: float) -> Column:
    """The smaller of x and `high`; NaN stays NaN, as in array code."""
    return F.when(F.isnan(x), x).otherwise(F.least(x, F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b under IEEE rules: x/0 is infinite, 0/0 is NaN."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or `default` where b is 0."""
    return F.when(b == 0, F.lit(default)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def is_close_to_zero(x: Column, atol: float = 1e-8) -> Column:
    return F.abs(x) <= atol


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def gelu(x: Column) -> Column:
    """The tanh form of the Gaussian error linear unit."""
    return 0.5 * x * (1 + F.tanh(F.sqrt(F.lit(2 / 3.141592653589793)) * (x + 0.044715 * x * x * x)))


def average_path_length(n: Column) -> Column:
    """Expected path length of an unsuccessful search among n points: 0 for n <= 1, 1 for 2."""
    m = F.greatest(n.cast("double"), F.lit(3.0))
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2.0 * (F.log(m - 1) + EULER_GAMMA) - 2.0 * (m - 1) / m)


def truncated_share(n: Column, percent: float) -> Column:
    """The whole part of n * (percent / 100), in that order of operations."""
    return F.floor(n * (F.lit(float(percent)) / F.lit(100.0))).cast("long")


def linspace(start: float, stop: float, n: int) -> Column:
    """n evenly spaced values as an array."""
    if n == 1:
        return F.array(F.lit(float(start)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i.cast("double") * ((stop - start) / (n - 1)))


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def mean_squared_error(a: Column, b: Column) -> Column:
    return squared_distance(a, b) / F.size(a)


def contrast_normalize(v: Column, scale: str = "l1") -> Column:
    """Subtract the mean, then divide by the mean absolute value (l1) or by sqrt(sum of squares) / n (l2).

    Mean, centred values and scale are each an element of an array, so that they are made once a row and not once a value.
    """
    n = F.size(v)

    def scaled(c: Column) -> Column:
        size = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.abs(x)) / n if scale == "l1" else norm(c) / n
        return F.get(F.transform(F.array(size), lambda d: F.when(d == 0, c).otherwise(F.transform(c, lambda x: x / F.when(d == 0, F.lit(1.0)).otherwise(d)))), F.lit(0))

    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    centred = F.get(F.transform(F.array(mean), lambda m: F.transform(v, lambda x: x - m)), F.lit(0))
    return F.get(F.transform(F.array(centred), scaled), F.lit(0))
