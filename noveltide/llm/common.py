"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide import session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Call before any plan with Python functions over whole texts."""
    session.ship(spark)
    session.small_batches(spark)


def by_bytes(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of `most` bytes at most together, or of one longer text; `sizes` are the texts' bytes."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names with as many underscores before them as it takes to clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast built-in serves where all is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row and that no later lambda evaluates anew.

    A generator's output is an attribute, so the optimizer can't fold the
    expression into functions that would run it for every array element.
    """
    packed = F.array(F.struct(*(c.alias(k) for k, c in columns.items())))
    return df.select("*", F.inline(packed))
