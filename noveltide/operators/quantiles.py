"""Exact quantiles and ranks of whole columns, in two levels, so that no task sorts all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noveltide.session import materialize

#: Ranges that a key's distinct values are cut into.
RANGES = 128


def exact_quantiles(long: DataFrame, key: str, value: str, qs: list[float]) -> DataFrame:
    """(key, q): each key's quantiles at `qs`, ascending, linear between neighbouring values, as SQL's continuous percentile has them.

    Nulls don't count, and a key without values has no row. Values are counted
    before anything else, then cut into `RANGES` ranges at approximate quantiles. Totals per
    range tell which ranges hold the wanted ranks, and only these are sorted. Keys are few (columns of a
    table): all that is gathered per key are its ranges' totals.
    """
    counted = long.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x")).where("x is not null").groupBy("k", "x").agg(F.count("*").alias("n"))
    marks = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    # Written, as approximate quantiles depend on the order in which parts arrive, and all uses must see the same.
    cuts = materialize(counted.groupBy("k").agg(F.percentile_approx("x", marks, F.lit(20 * RANGES)).alias("c")), "cuts")
    ranged = counted.join(cuts, "k").withColumn("part", F.size(F.filter("c", lambda v: v < F.col("x")))).drop("c")
    totals = ranged.groupBy("k", "part").agg(F.sum("n").alias("pn"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("k", "part", "pn", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("below"), F.sum("pn").over(Window.partitionBy("k")).alias("total"))
    # A row for each quantile, made from one array of numbers, and its two ranks as columns of that row.
    wanted = totals.select("k", "part", "pn", "below", "total", F.posexplode(F.array(*(F.lit(float(q)) for q in qs))).alias("i", "q"))
    wanted = wanted.withColumn("place", F.col("q") * (F.col("total") - 1)).withColumn("share", F.col("place") - F.floor("place"))
    wanted = wanted.withColumn("high", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("r", F.when(F.col("high") == 1, F.ceil("place")).otherwise(F.floor("place")))
    wanted = wanted.where("r >= below and r < below + pn").select("k", "part", "below", "i", "high", "r", "share")
    inside = ranged.join(wanted.select("k", "part", "below").distinct(), ["k", "part"])
    upto = Window.partitionBy("k", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("below") + F.sum("n").over(upto)).drop("below")
    found = inside.join(wanted.drop("below"), ["k", "part"]).where("r < upto and r >= upto - n")
    pairs = found.groupBy("k", "i").agg(F.max(F.when(F.col("high") == 0, F.col("x"))).alias("low"), F.max(F.when(F.col("high") == 1, F.col("x"))).alias("up"), F.max("share").alias("share"))
    between = F.when(F.col("low") == F.col("up"), F.col("low")).otherwise(F.col("low") + (F.col("up") - F.col("low")) * F.col("share"))
    packed = pairs.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", between.alias("x")))).alias("all"))
    return packed.select(F.col("k").alias(key), F.transform("all", lambda s: s["x"]).alias("q"))


def column_quantiles(df: DataFrame, value: Column, qs: list[float]) -> DataFrame:
    """One row, `q`: the quantiles of one column; no row where it has no values."""
    return exact_quantiles(df.select(F.lit(0).alias("k"), value.alias("x")), "k", "x", qs).select("q")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`: the row's place, from 1, in the given order, which must tell all rows apart.

    Rows are dealt to ranges of the order and written with their range, ranks are taken inside
    each range, and the ranges' totals, one row each, are added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__below"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(totals), "__part").withColumn(name, (F.col("__below") + inside).cast("long")).drop("__part", "__below")
