"""Detectors by distances, histograms and tails; all but SOD and COF are plain DataFrame plans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noveltide import session
from noveltide.functions.scalar import distance
from noveltide.operators.cluster import class_means, kmeans
from noveltide.operators.detectors.common import exploded
from noveltide.operators.distance import nearest


def knn(test: DataFrame, train: DataFrame, k: int = 5, method: str = "largest", exclude_self: bool = False) -> DataFrame:
    """Distance to the k-th nearest train row, or the mean or median over the k."""
    near = F.transform("neighbors", lambda n: n["dist"])
    how = {
        "largest": F.array_max(near),
        "mean": F.aggregate(near, F.lit(0.0), lambda s, x: s + x) / F.size(near),
        "median": (F.get(near, F.floor((F.size(near) - 1) / 2).cast("int")) + F.get(near, F.floor(F.size(near) / 2).cast("int"))) / 2,
    }
    return nearest(test, train, k, exclude_self).select("row_id", how[method].alias("score"))


def hbos(test: DataFrame, train: DataFrame, bins: int = 10, alpha: float = 0.1) -> DataFrame:
    """Histogram score: the sum over features of -log2(density + alpha), bins of equal width over the train range.

    Densities are scaled so that each feature's highest is 1; values outside the range have density 0.
    """
    x = exploded(train)
    span = x.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    place = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = x.join(span, "i").groupBy("i", place.alias("bin")).agg(F.count("*").alias("n"))
    top = counts.groupBy("i").agg(F.max("n").alias("top"))
    density = counts.join(top, "i").select(F.col("i").alias("di"), F.col("bin").alias("dbin"), (F.col("n") / F.col("top")).alias("density"))
    t = exploded(test).join(span, "i").withColumn("bin", F.when((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")), place))
    t = t.join(density, (F.col("i") == F.col("di")) & (F.col("bin") == F.col("dbin")), "left")
    return t.groupBy("row_id").agg(F.sum(-F.log2(F.coalesce("density", F.lit(0.0)) + alpha)).alias("score"))


def _tails(df: DataFrame) -> DataFrame:
    """(row_id, i, left, right, skew): -log of each value's empirical tails within its feature.

    Values are counted before ranks are taken, and ranks come from windows per feature and range,
    added to the ranges' totals; no task gets a whole feature of a large table.
    """
    x = exploded(df)
    counted = x.groupBy("i", "x").agg(F.count("*").alias("n"))
    # Written, as approximate quantiles depend on the order in which parts arrive, and all uses must see the same.
    cuts = session.materialize(counted.groupBy("i").agg(F.percentile_approx("x", F.array(*(F.lit(k / 32) for k in range(1, 32))), 1000).alias("c")), "cuts")
    ranged = counted.join(F.broadcast(cuts), "i").withColumn("part", F.size(F.filter("c", lambda v: v < F.col("x")))).drop("c")
    parts = ranged.groupBy("i", "part").agg(F.sum("n").alias("pn"))
    before = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("i", "part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("below"), F.sum("pn").over(Window.partitionBy("i")).alias("total"))
    w = Window.partitionBy("i", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(parts, ["i", "part"]).withColumn("upto", F.col("below") + F.sum("n").over(w))
    total = F.col("total").cast("double")
    tails = placed.select("i", "x", (-F.log(F.col("upto") / total)).alias("left"), (-F.log((F.col("total") - F.col("upto") + F.col("n")) / total)).alias("right"))
    skew = x.groupBy("i").agg(F.skewness("x").alias("skew"))
    return x.join(tails, ["i", "x"]).join(skew, "i").select("row_id", "i", "left", "right", F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0)).alias("skew"))


def _by_skew() -> Column:
    return F.when(F.col("skew") < 0, F.col("left")).when(F.col("skew") > 0, F.col("right")).otherwise(F.col("left") + F.col("right"))


def ecod(df: DataFrame) -> DataFrame:
    """Empirical-cumulative-distribution score: the largest of the sums of left tails, right tails, and tails chosen by skewness."""
    sums = _tails(df).groupBy("row_id").agg(F.sum("left").alias("l"), F.sum("right").alias("r"), F.sum(_by_skew()).alias("s"))
    return sums.select("row_id", F.greatest("l", "r", "s").alias("score"))


def copod(df: DataFrame) -> DataFrame:
    """Copula score: the sum over features of the larger of the skewness-chosen tail and the mean of both tails."""
    each = F.greatest(_by_skew(), (F.col("left") + F.col("right")) / 2)
    return _tails(df).groupBy("row_id").agg(F.sum(each).alias("score"))


def lof(df: DataFrame, k: int = 20) -> DataFrame:
    """Local outlier factor: the mean local reachability density of a row's k nearest over its own."""
    near = nearest(df, df, k, exclude_self=True)
    kdist = near.select(F.col("row_id").alias("nid"), F.array_max(F.transform("neighbors", lambda n: n["dist"])).alias("kdist"))
    links = near.select("row_id", F.explode("neighbors").alias("nb")).select("row_id", F.col("nb.id").alias("nid"), F.col("nb.dist").alias("dist"))
    lrd = links.join(kdist, "nid").groupBy("row_id").agg((1.0 / (F.avg(F.greatest("dist", "kdist")) + 1e-10)).alias("lrd"))
    other = lrd.select(F.col("row_id").alias("nid"), F.col("lrd").alias("nlrd"))
    return links.join(other, "nid").groupBy("row_id").agg(F.avg("nlrd").alias("mean")).join(lrd, "row_id").select("row_id", (F.col("mean") / F.col("lrd")).alias("score"))


def cblof(test: DataFrame, train: DataFrame, clusters: int = 8, alpha: float = 0.9, beta: float = 5.0) -> DataFrame:
    """Cluster-based score: the distance to the own cluster's mean if it is large, else to the nearest large one's.

    Large clusters are the biggest that hold `alpha` of the rows, or those before a drop in size by `beta`.
    """
    assigned = kmeans(train, clusters, seeds=1)
    means = class_means(assigned, "cluster")
    sizes = sorted(((r["class"], r.n, r["mean"]) for r in means.collect()), key=lambda r: -r[1])  # one row per cluster
    total, seen, cut = sum(s[1] for s in sizes), 0, len(sizes)
    for i, s in enumerate(sizes):
        seen += s[1]
        if seen >= alpha * total or (i + 1 < len(sizes) and s[1] >= beta * sizes[i + 1][1]):
            cut = i + 1
            break
    spark = train.sparkSession
    centers = spark.createDataFrame([(int(c), m, i < cut) for i, (c, _, m) in enumerate(sizes)], "class int, mean array<double>, large boolean")
    packed = centers.agg(F.collect_list(F.struct("class", "mean", "large")).alias("__c"))
    d = lambda c: F.struct(distance(F.col("features").cast("array<double>"), c["mean"]).alias("d"), c["large"].alias("large"))
    out = test.crossJoin(F.broadcast(packed)).withColumn("__all", F.transform("__c", d))
    return out.select("row_id", F.array_min(F.filter("__all", lambda c: c["large"]))["d"].alias("score"))


def _with_neighbors(df: DataFrame, k: int) -> DataFrame:
    """(row_id, features, nbrs): each row with its k nearest rows' features, nearest first."""
    near = nearest(df, df, k, exclude_self=True).select("row_id", F.posexplode("neighbors").alias("pos", "nb"))
    feats = df.select(F.col("row_id").alias("nid"), F.col("features").cast("array<double>").alias("nf"))
    near = near.select("row_id", "pos", F.col("nb.id").alias("nid")).join(feats, "nid")
    packed = near.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nid", "nf"))), lambda s: F.struct(s["nid"].alias("id"), s["nf"].alias("f"))).alias("nbrs"))
    return df.select("row_id", F.col("features").cast("array<double>").alias("features")).join(packed, "row_id")


def _chaining(points: np.ndarray) -> float:
    """Average chaining distance: the first point joined to the others one nearest link at a time, early links weighing more."""
    r = len(points)
    left, joined, total = list(range(1, r)), [0], 0.0
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    for i in range(1, r):
        sub = d[np.ix_(joined, left)]
        j = int(np.argmin(sub.min(0)))
        total += 2 * (r - i) / (r * (r - 1)) * float(sub[:, j].min())
        joined.append(left.pop(j))
    return total


def cof(df: DataFrame, k: int = 20) -> DataFrame:
    """Connectivity-based factor: a row's chaining distance over the mean of its k nearest rows'."""
    session.ship(df.sparkSession)
    rows = _with_neighbors(df, k)

    def chain(frames):
        for f in frames:
            acs = [_chaining(np.array([x, *(n["f"] for n in ns)])) for x, ns in zip(f["features"], f["nbrs"], strict=True)]
            yield pd.DataFrame({"row_id": f["row_id"], "ac": acs})

    ac = rows.select("row_id", "features", "nbrs").mapInPandas(chain, "row_id long, ac double")
    links = rows.select("row_id", F.explode("nbrs.id").alias("nid"))
    means = links.join(ac.select(F.col("row_id").alias("nid"), F.col("ac").alias("nac")), "nid").groupBy("row_id").agg(F.avg("nac").alias("m"))
    return ac.join(means, "row_id").select("row_id", (F.col("ac") / (F.col("m") + 1e-10)).alias("score"))


def _shared(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(row_id, other, n): how many ids the lists of both rows have in common."""
    own, others = lists.select("row_id", "ids"), lists.select(F.col("row_id").alias("other"), F.col("ids").alias("theirs"))
    return pairs.join(own, "row_id").join(others, "other").select("row_id", "other", F.size(F.array_intersect("ids", "theirs")).alias("n"))


def _first(pairs: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("row_id").orderBy(F.desc("n"), "other")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def most_shared(near: DataFrame, top: int) -> DataFrame:
    """(row_id, other, n): for each row the `top` others that share most of its list, ties by id; `near` is (row_id, nid), each id once a row.

    Ids are ordered by how many lists hold them, rarest first. Rows that share t ids share one of the first ones, all but
    t - 1, so the pairs of these prefixes hold all that share t or more; hubs come last and are in no prefix. t falls
    from half of a list to 2, and a row that has `top` others drops out, as nobody left shares more. What's missing then shares one
    id, of which the least rows of each inverted list, twice `top` and one, are enough. Lists of hubs are so never met with themselves; only
    rows whose lists hold several hubs and hardly any other id in common meet at t = 2.
    """
    often = near.groupBy("nid").agg(F.count("*").alias("often"))
    lists = near.join(often, "nid").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("often", "nid"))).alias("all"))
    lists = session.materialize(lists.select("row_id", F.transform("all", lambda s: s["nid"]).alias("ids")), "neighbor-lists")
    longest = lists.agg(F.max(F.size("ids"))).first()[0] or 0
    open_, done, found = lists.select("row_id"), None, None
    t = max(2, longest // 2)
    while True:
        prefix = lists.select("row_id", F.explode(F.slice("ids", 1, F.greatest(F.size("ids") - (t - 1), F.lit(0)))).alias("nid"))
        others = prefix.withColumnRenamed("row_id", "other")
        pairs = prefix.join(open_, "row_id", "left_semi").join(others, "nid").where("row_id <> other").select("row_id", "other").distinct()
        found = session.materialize(_first(_shared(pairs, lists).where(F.col("n") >= t), top), "most-shared")
        full = found.groupBy("row_id").agg(F.count("*").alias("c")).where(F.col("c") >= top).select("row_id")
        kept = found.join(full, "row_id", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        open_ = session.materialize(open_.join(full, "row_id", "left_anti"), "open-rows")
        if t == 2 or open_.isEmpty():
            break
        t = max(2, t // 2)
    least = lists.select("row_id", F.explode("ids").alias("nid"))
    for keys in (["nid", F.pmod(F.xxhash64("row_id"), F.lit(64))], ["nid"]):
        least = least.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id"))).where(F.col("r") <= 2 * top + 1).drop("r")
    rest = lists.join(open_, "row_id", "left_semi").select("row_id", F.explode("ids").alias("nid")).join(least.withColumnRenamed("row_id", "other"), "nid").where("row_id <> other")
    rest = rest.select("row_id", "other").unionByName(found.join(open_, "row_id", "left_semi").select("row_id", "other")).distinct()
    return done.unionByName(_first(_shared(rest, lists), top))


def sod(df: DataFrame, k: int = 20, reference: int = 10, alpha: float = 0.8) -> DataFrame:
    """Subspace outlier degree: the distance to the mean of the rows sharing most neighbours, in the features where these vary little."""
    session.ship(df.sparkSession)
    near = nearest(df, df, k, exclude_self=True).select("row_id", F.explode("neighbors.id").alias("nid"))
    best = most_shared(session.materialize(near, "neighbors"), reference)
    feats = df.select(F.col("row_id").alias("other"), F.col("features").cast("array<double>").alias("f"))
    sets = best.join(feats, "other").groupBy("row_id").agg(F.collect_list("f").alias("refs"))
    rows = df.select("row_id", F.col("features").cast("array<double>").alias("features")).join(sets, "row_id", "left")

    def degree(frames):
        for f in frames:
            out = []
            for x, refs in zip(f["features"], f["refs"], strict=True):
                if refs is None or len(refs) == 0:
                    out.append(0.0)
                    continue
                r = np.array(list(refs), "f8")
                var = r.var(0)
                flat = var < alpha * var.mean()
                out.append(math.sqrt(((np.array(x) - r.mean(0))[flat] ** 2).sum()) / max(1, flat.sum()))
            yield pd.DataFrame({"row_id": f["row_id"], "score": out})

    return rows.mapInPandas(degree, "row_id long, score double")
