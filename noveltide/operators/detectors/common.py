"""What detectors share: the matrix forms of small and large tables, and the fit/score protocol."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide import session
from noveltide.operators.prep import hash_order

#: Rows that a model fitted on the driver sees at most: those first in hash order, so the sample is the same in each run.
SAMPLE_ROWS = 20_000


def matrix(features: pd.Series) -> np.ndarray:
    return np.array(features.tolist(), dtype="f8").reshape(len(features), -1 if len(features) else 0)


def sample_matrix(df: DataFrame, most: int | None = SAMPLE_ROWS, seed: int = 42) -> np.ndarray:
    """Up to `most` feature rows, or all of them, for a model that is fitted on the driver."""
    ordered = df.select("row_id", "features").orderBy(hash_order("row_id", seed), "row_id")
    rows = (ordered if most is None else ordered.limit(most)).toPandas()
    return matrix(rows["features"]) if len(rows) else np.zeros((0, 0))


def map_scores(df: DataFrame, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(row_id, score) by a function of feature matrices, in Arrow batches."""
    session.ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"row_id": f["row_id"], "score": np.asarray(score(matrix(f["features"])), "f8")})

    return df.select("row_id", "features").mapInPandas(run, "row_id long, score double")


def exploded(df: DataFrame) -> DataFrame:
    """(row_id, i, x): a row per feature."""
    return df.select("row_id", F.posexplode(F.col("features").cast("array<double>")).alias("i", "x"))
