"""Words and word shingles with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide.llm.common import ascii_lower, barrier

#: Runs of other than ASCII letters and digits; all non-ASCII characters belong to words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_words(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the array of lower-case words of a text, in order; a null text has none."""
    raw = f"{name}_raw"
    df = barrier(df, **{raw: F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP)})
    w = F.col(raw)
    head = F.when(F.element_at(w, 1) == "", 1).otherwise(0)
    tail = F.when(F.element_at(w, -1) == "", 1).otherwise(0)
    return barrier(df, **{name: F.slice(w, head + 1, F.greatest(F.size(w) - head - tail, F.lit(0)))}).drop(raw)


def shingle_hashes(words: Column, n: int) -> Column:
    """The hash of the n words from each position; empty if there are fewer words."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def is_one_of(value: Column, literals: list) -> Column:
    """Membership in a bounded set of literals, which Spark evaluates with a hash set."""
    return value.isin(literals) if literals else F.lit(False)
