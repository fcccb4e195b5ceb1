"""Cleaning, scaling, sampling and splitting of experiment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide.functions.scalar import inf_to_null, l2_normalize
from noveltide.operators.quantiles import column_quantiles, exact_quantiles, global_rank

#: Quantiles of the quantile transform.
QUANTILES = 101


def feature_table(df: DataFrame, id_col: str, feature_cols: list[str] | None = None, label_col: str | None = None) -> DataFrame:
    """(row_id, features array<double>, label): by position the last column is the label, the others but the id are features."""
    rest = [c for c in df.columns if c != id_col]
    label_col = label_col or rest[-1]
    feature_cols = feature_cols or [c for c in rest if c != label_col]
    return df.select(F.col(id_col).alias("row_id"), F.array(*(F.col(c).cast("double") for c in feature_cols)).alias("features"), F.col(label_col).cast("int").alias("label"))


def _fit(df: DataFrame, fit_on: Column | None) -> DataFrame:
    return df if fit_on is None else df.where(fit_on)


def _beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Each row with the columns of a table of one row (or none: nulls)."""
    return df.join(F.broadcast(one_row), F.lit(True), "left")


def impute_mean(df: DataFrame, cols: list[str], fit_on: Column | None = None) -> DataFrame:
    """Infinite, NaN and null values become the column's mean over the rows that `fit_on` picks; columns without any number stay null."""
    stats = _fit(df, fit_on).agg(*(F.avg(inf_to_null(F.col(c).cast("double"))).alias(f"__m_{c}") for c in cols))
    out = _beside(df, stats)
    out = out.withColumns({c: F.coalesce(inf_to_null(F.col(c).cast("double")), F.col(f"__m_{c}")) for c in cols})
    return out.drop(*(f"__m_{c}" for c in cols))


def scale(df: DataFrame, cols: list[str], method: str, fit_on: Column | None = None) -> DataFrame:
    """Scale columns by statistics of the rows that `fit_on` picks (all by default): standard, minmax or robust.

    Statistics are one row, joined by broadcast. A column without spread is centred only.
    """
    fitted = _fit(df, fit_on)
    if method == "robust":
        long = fitted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols))).alias("v")).select("v.c", "v.x")
        q = exact_quantiles(long, "c", "x", [0.25, 0.5, 0.75])
        own = lambda c, k: F.max(F.when(F.col("c") == c, F.get("q", F.lit(k))))
        stats = q.agg(*(x for c in cols for x in (own(c, 1).alias(f"__a_{c}"), (own(c, 2) - own(c, 0)).alias(f"__b_{c}"))))
    else:
        aggs: list[Column] = []
        for c in cols:
            x = F.col(c).cast("double")
            if method == "standard":
                aggs += [F.avg(x).alias(f"__a_{c}"), F.stddev_pop(x).alias(f"__b_{c}")]
            elif method == "minmax":
                aggs += [F.min(x).alias(f"__a_{c}"), (F.max(x) - F.min(x)).alias(f"__b_{c}")]
            else:
                raise ValueError(f"no scaler {method!r}")
        stats = fitted.agg(*aggs)
    out = _beside(df, stats)
    spread = lambda c: F.when(F.col(f"__b_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__b_{c}"))
    out = out.withColumns({c: (F.col(c).cast("double") - F.col(f"__a_{c}")) / spread(c) for c in cols})
    return out.drop(*(f"__{k}_{c}" for c in cols for k in "ab"))


def scale_vectors(df: DataFrame, method: str, fit_on: Column | None = None, features_col: str = "features", quantiles: int = QUANTILES) -> DataFrame:
    """Scale a vector column position by position: standard, minmax, robust or quantile; `normalizer` scales each row to length 1.

    Statistics are one row of a few numbers per position, joined by broadcast.
    """
    if method == "normalizer":
        return normalize_rows(df, features_col)
    long = _fit(df, fit_on).select(F.posexplode(F.col(features_col).cast("array<double>")).alias("i", "x"))
    if method == "standard":
        stats = long.groupBy("i").agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("b"))
    elif method == "minmax":
        stats = long.groupBy("i").agg(F.min("x").alias("a"), (F.max("x") - F.min("x")).alias("b"))
    elif method == "robust":
        stats = exact_quantiles(long, "i", "x", [0.25, 0.5, 0.75]).select("i", F.get("q", F.lit(1)).alias("a"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("b"))
    elif method == "quantile":
        stats = exact_quantiles(long, "i", "x", [k / (quantiles - 1) for k in range(quantiles)]).withColumnRenamed("q", "a").withColumn("b", F.lit(0))
    else:
        raise ValueError(f"no scaler {method!r}")
    row = stats.agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("__s"))
    x = F.col(features_col).cast("array<double>")
    if method == "quantile":
        def counted(v: Column, i: Column) -> Column:
            below, to = quantile_counts(v, F.get("__s", i)["a"])
            return F.struct(v.alias("v"), below.alias("below"), to.alias("to"))

        scaled = F.transform(F.transform(x, counted), lambda c, i: quantile_place(c["v"], c["below"], c["to"], F.get("__s", i)["a"], quantiles))
    else:
        spread = lambda i: F.when(F.get("__s", i)["b"] == 0, F.lit(1.0)).otherwise(F.get("__s", i)["b"])
        scaled = F.transform(x, lambda v, i: (v - F.get("__s", i)["a"]) / spread(i))
    return _beside(df, row).withColumn(features_col, scaled).drop("__s")


def normalize_rows(df: DataFrame, vector_col: str) -> DataFrame:
    """Each vector over its Euclidean length; zero vectors stay."""
    return df.withColumn(vector_col, l2_normalize(F.col(vector_col).cast("array<double>")))


def quantile_counts(x: Column, grid: Column) -> tuple[Column, Column]:
    """How many quantiles of the ascending `grid` are below x, and how many are up to it."""
    return F.size(F.filter(grid, lambda v: v < x)), F.size(F.filter(grid, lambda v: v <= x))


def quantile_place(x: Column, below: Column, to: Column, grid: Column, quantiles: int) -> Column:
    """Where x lies, 0 to 1, among the `grid` of so many quantiles, linear between them; equal neighbours give the middle of their places."""
    step = 1.0 / (quantiles - 1)
    lower, upper = F.element_at(grid, F.greatest(to, F.lit(1))), F.element_at(grid, F.least(to + 1, F.lit(quantiles)))
    inside = ((to - 1) + F.when(upper > lower, (x - lower) / F.when(upper > lower, upper - lower).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))) * step
    tied = (below + to - 1) / F.lit(2.0) * step
    place = F.when(to == 0, 0.0).when(below == quantiles, 1.0).when(to > below, tied).otherwise(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)))
    return F.when(x.isNotNull() & grid.isNotNull(), place)


def quantile_transform(df: DataFrame, col: str, quantiles: int = QUANTILES, fit_on: Column | None = None, out_col: str | None = None) -> DataFrame:
    """A column's place, 0 to 1, on its own quantiles, linear between them; see `quantile_place`."""
    x = F.col(col).cast("double")
    q = column_quantiles(_fit(df, fit_on), x, [i / (quantiles - 1) for i in range(quantiles)]).withColumnRenamed("q", "__q")
    below, to = quantile_counts(x, F.col("__q"))
    # Both counts are columns of their own, so each is made once a row.
    out = _beside(df, q).withColumns({"__below": below, "__to": to})
    return out.withColumn(out_col or col, quantile_place(x, F.col("__below"), F.col("__to"), F.col("__q"), quantiles)).drop("__q", "__below", "__to")


def hash_order(id_col: str, seed: int | str = 42) -> Column:
    """An order of rows that depends on seed and id alone and is the same in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def hash_split(df: DataFrame, id_col: str, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Add `is_test`: the first 32 bits of the hash of seed and id fall under the share."""
    part = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("is_test", part < test_share)


def sample_without_replacement(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the first in `hash_order`; a distributed top-n, not a sort of all rows."""
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def contaminate(df: DataFrame, id_col: str, label_col: str, percent: float, noise_label: int = 1, seed: int = 42) -> DataFrame:
    """All rows of label 0, and rows of label 1 that make `percent` of their number; `train_label` is `noise_label` for the latter."""
    n0 = df.where(F.col(label_col) == 0).count()
    n1 = int(n0 * (percent / 100))
    anomalies = df.where(F.col(label_col) == 1)
    if n1 > (have := anomalies.count()):
        raise ValueError(f"{percent} % of {n0} rows are {n1}; there are {have} anomalies")
    normal = df.where(F.col(label_col) == 0).withColumn("train_label", F.lit(0))
    return normal.unionByName(sample_without_replacement(anomalies, id_col, n1, seed).withColumn("train_label", F.lit(noise_label)))


def one_class(df: DataFrame, label_col: str, target: int) -> DataFrame:
    """`label` is 0 for the target class and 1 for all others."""
    return df.withColumn("label", F.when(F.col(label_col) == target, 0).otherwise(1))


def head_share_split(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """`is_test` for the first int(n * share) rows in the given order, which must tell all rows apart."""
    n = int(df.count() * share)
    return global_rank(df, order, "__rank").withColumn("is_test", F.col("__rank") <= n).drop("__rank")
