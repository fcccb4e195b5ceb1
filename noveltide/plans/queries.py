"""The registered queries over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noveltide.functions import scalar
from noveltide.operators import cluster, metrics, nullspace, optimize, pivots, prep, quantiles, score
from noveltide.operators.detectors import DETECTORS, tabular
from noveltide.operators.detectors.estimator import Detector, DetectorModel
from noveltide.operators.distance import nearest, nearest_distance
from noveltide.plans import experiments, reports
from noveltide.session import shared_dir
from noveltide.sources import idx, profile, results, tables
from noveltide.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (row_id, features, class, label); label 0 is the normal class 0, 1 the others."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("class"), (F.col("label") != 0).cast("int").alias("label"))


def normal(v: DataFrame) -> DataFrame:
    return v.where("label = 0")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (row_id, score, label): the value scores purchases."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))


def holed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with nulls, NaN and infinities at some ids."""
    e = read(spark, sf_dir, "events").select("event_id", "value")
    hole = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 11 == 0, float("inf")).when(F.col("event_id") % 13 == 0, float("nan")).otherwise(F.col("value"))
    return e.select("event_id", hole.alias("value"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/noveltide/{name}-{uuid.uuid4().hex}"


_E = "(SELECT vec_id AS row_id, embedding::DOUBLE[] AS f, label AS class, (label <> 0)::INT AS label FROM embeddings)"
_S = "(SELECT event_id AS row_id, value AS score, (event_type = 'purchase')::INT AS label FROM events)"
_HOLED = "(SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS v, event_id % 7 = 0 AS is_null FROM events)"

# ---- sources and sinks


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_scan(spark, sf_dir):
    path = scratch(spark, "csv")
    tables.overwrite(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "csv")
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT n_nationkey AS _c0, n_name AS _c1 FROM nation")
def csv_scan_without_header(spark, sf_dir):
    path = scratch(spark, "csv")
    read(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(path)
    return tables.read_csv(spark, path, header=False)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def partition_scan(spark, sf_dir):
    path = scratch(spark, "parts")
    read(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").parquet(path)
    df = tables.read_partition(spark, path, o_orderstatus="F")
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT r_name, 2::BIGINT AS n FROM region")
def append_sink(spark, sf_dir):
    path = scratch(spark, "runs")
    for run in ("a", "b"):
        tables.append(read(spark, sf_dir, "region"), path, run)
    return spark.read.parquet(path).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS missing_rows, count(*)::BIGINT AS present_rows FROM region")
def existence_guard(spark, sf_dir):
    schema = "r_regionkey int, r_name string"
    gone = tables.read_if_exists(spark, scratch(spark, "none"), schema).agg(F.count("*").alias("missing_rows"))
    return gone.crossJoin(tables.read_if_exists(spark, f"{sf_dir}/region.parquet", schema).agg(F.count("*").alias("present_rows")))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) <= CAST(floor((SELECT count(*) FROM supplier) * 0.1) AS BIGINT) AS is_test FROM supplier")
def speech_source_split(spark, sf_dir):
    """The first tenth of a CSV source of several files, by place."""
    path = scratch(spark, "speech")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey").repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey")
    rows.write.option("header", True).csv(path)
    return tables.head_split(spark.read.option("header", True).schema("s_suppkey long").csv(path)).select("s_suppkey", "is_test")


@query("SELECT conv_id, n, chars, mean FROM (SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS chars, round(avg(turn), 6) AS mean FROM conversations GROUP BY 1), (SELECT unnest([1, 2]) AS run)")
def csv_results(spark, sf_dir):
    """Two runs appended to one CSV table of a single header, read back."""
    path = scratch(spark, "results")
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), r6(F.avg("turn"), "mean"))
    for _ in range(2):
        results.append_csv(rows, path)
    return results.read_results(spark, path, rows.schema)


@query("""WITH r AS (SELECT epoch, vec_id, label, row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || vec_id), vec_id) - 1 AS r FROM embeddings, (SELECT unnest([0, 1]) AS epoch))
SELECT epoch::INT AS epoch, (r // 64)::INT AS batch, count(*) AS n, sum(vec_id)::BIGINT AS ids, sum(label)::BIGINT AS labels FROM r WHERE r // 64 < (SELECT count(*) FROM embeddings) // 64 GROUP BY 1, 2""")
def minibatch_epochs(spark, sf_dir):
    out = tables.minibatches(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 64, 2, drop_last=True)
    return out.groupBy("epoch", "batch").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"), F.sum("label").alias("labels"))


@query("""SELECT vec_id, coalesce(label, -1)::BIGINT AS label, len(embedding)::BIGINT AS dims, embedding[1]::DOUBLE AS head, embedding[len(embedding)]::DOUBLE AS tail, list_min(embedding)::DOUBLE AS least, list_max(embedding)::DOUBLE AS most
FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings) AND list_count(embedding) = len(embedding)""")
def image_source(spark, sf_dir):
    """Vectors written as IDX images, their ids as last values, and read back by byte ranges with their labels."""
    e = read(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    whole = e.where((F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull()))
    rows = whole.select(F.concat(F.col("embedding").cast("array<double>"), F.array(F.col("vec_id").cast("double"))).alias("features"), F.coalesce("label", F.lit(-1)).alias("label"))
    path = scratch(spark, "images")
    idx.write_idx(rows, path, (width + 1,))
    back = idx.read_idx(spark, f"{path}/images", f"{path}/labels", range_bytes=1 << 20)
    v = back.select(F.element_at("features", -1).cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.slice("features", 1, width).alias("f"))
    return v.select("vec_id", "label", F.size("f").cast("long").alias("dims"), F.element_at("f", 1).alias("head"), F.element_at("f", -1).alias("tail"), F.array_min("f").alias("least"), F.array_max("f").alias("most"))


@query("SELECT count(*)::BIGINT AS rows_read, (SELECT count(*) FROM (SELECT DISTINCT conv_id FROM conversations))::BIGINT AS rows_written FROM conversations")
def profile_sink(spark, sf_dir):
    """The rows that another query's stages read and write, from its profile's table."""
    path = scratch(spark, "profile")
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    profile.append_profile(spark, lambda: turns.write.parquet(scratch(spark, "profiled")), path)
    return spark.read.parquet(path).where("status = 'COMPLETE'").agg(F.sum("rows_read").alias("rows_read"), F.sum("rows_written").alias("rows_written"))


@query("SELECT doc_id, row_number() OVER (ORDER BY toxic DESC, doc_id) <= CAST(floor((SELECT count(*) FROM labels) * 0.4) AS BIGINT) AS is_test FROM labels")
def sorted_source_split(spark, sf_dir):
    return tables.sorted_label_split(read(spark, sf_dir, "labels"), "doc_id", "toxic").select("doc_id", "is_test")


@query()
def synthetic_source(spark, sf_dir):
    return tables.synthetic(spark, 10_000, 10)


# ---- projections, filters, predicates


@query("SELECT p_partkey AS row_id, p_size::DOUBLE AS x0, p_retailprice AS x1, (p_size > 25)::INT AS label FROM part")
def feature_label_split(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") > 25).cast("int").alias("y"))
    out = prep.feature_table(p, "p_partkey")
    return out.select("row_id", F.get("features", F.lit(0)).alias("x0"), F.get("features", F.lit(1)).alias("x1"), "label")


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND value < 50 AND user_id <> 1")
def filters(spark, sf_dir):
    return read(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("value") < 50) & (F.col("user_id") != 1)).select("event_id")


@query("SELECT c_custkey, c_acctbal, 1 AS one, (c_acctbal > 0)::INT AS positive, c_mktsegment AS segment FROM customer")
def projections(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment").drop("c_name", "c_nationkey")
    return c.select("c_custkey", "c_acctbal", F.lit(1).alias("one"), (F.col("c_acctbal") > 0).cast("int").alias("positive"), "segment")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part) WHERE r > 100 AND r <= 200")
def row_slice(spark, sf_dir):
    return quantiles.global_rank(read(spark, sf_dir, "part").select("p_partkey"), [F.asc("p_partkey")], "r").where("r > 100 and r <= 200").select("p_partkey")


@query(f"SELECT event_id, value FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0")
def drop_missing(spark, sf_dir):
    return holed_events(spark, sf_dir).withColumn("value", scalar.inf_to_nan(F.col("value"))).dropna()


@query("SELECT vec_id, CASE WHEN label = 3 THEN 0 ELSE 1 END AS label FROM embeddings")
def one_class_relabel(spark, sf_dir):
    return prep.one_class(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 3)


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 4)")
def membership(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 4)).select("vec_id")


# ---- joins


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner_merge(spark, sf_dir):
    return read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT doc_id, text IS NOT NULL AS has_text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(spark, sf_dir):
    toxic = read(spark, sf_dir, "labels").where("toxic = 1")
    return read(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select("doc_id", F.col("text").isNotNull().alias("has_text"))


@query("SELECT l.doc_id, toxic, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def zip_by_id(spark, sf_dir):
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "toxic", "n_chars")


@query(f"SELECT a.row_id, round(min(list_distance(a.f, b.f)), 6) AS dist FROM {_E} a, {_E} b WHERE b.label = 0 GROUP BY 1")
def nearest_distance_join(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return nearest_distance(v, normal(v)).select("row_id", r6("dist", "dist"))


@query(f"SELECT a.row_id, round(min(list_distance(a.f, b.f)), 6) AS dist FROM {_E} a, {_E} b WHERE a.row_id <> b.row_id GROUP BY 1")
def nearest_other_distance(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return nearest_distance(v, v, exclude_self=True).select("row_id", r6("dist", "dist"))


@query(f"SELECT row_id, id, round(d, 6) AS dist FROM (SELECT a.row_id, b.row_id AS id, list_distance(a.f, b.f) AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.f, b.f), b.row_id) AS r FROM {_E} a, {_E} b WHERE b.label = 0 AND a.row_id <> b.row_id) WHERE r <= 3")
def three_nearest(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return nearest(v, normal(v), 3, exclude_self=True).select("row_id", F.inline("neighbors")).select("row_id", "id", r6("dist", "dist"))


@query(f"SELECT row_id, id, round(d, 6) AS dist FROM (SELECT a.row_id, b.row_id AS id, list_distance(a.f, b.f) AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.f, b.f), b.row_id) AS r FROM {_E} a, {_E} b WHERE a.row_id <> b.row_id) WHERE r <= 5")
def five_nearest_by_pivots(spark, sf_dir):
    """The same search through the index that tables beyond a broadcast take."""
    v = vectors(spark, sf_dir)
    return pivots.search(v, pivots.build(v, 5), exclude_self=True).select("row_id", F.inline("neighbors")).select("row_id", "id", r6("dist", "dist"))


_MEANS = f"(SELECT class, list(m ORDER BY i) AS m FROM (SELECT class, i, avg(x) AS m FROM (SELECT class, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM {_E}) GROUP BY class, i) GROUP BY class)"


@query(f"SELECT row_id, class, round(d, 6) AS dist FROM (SELECT e.row_id, c.class, list_distance(e.f, c.m) AS d, row_number() OVER (PARTITION BY e.row_id ORDER BY list_distance(e.f, c.m), c.class) AS r FROM {_E} e, {_MEANS} c) WHERE r = 1")
def nearest_centroid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out = cluster.assign_nearest(v, cluster.class_means(v, "class"))
    return out.select("row_id", F.col("cluster").alias("class"), r6("center_dist", "dist"))


@query(f"SELECT a.class, round(min(list_distance(a.m, b.m)), 6) AS dist FROM {_MEANS} a, {_MEANS} b WHERE a.class <> b.class GROUP BY 1")
def centroid_gaps(spark, sf_dir):
    m = cluster.class_means(vectors(spark, sf_dir), "class").select(F.col("class").cast("long").alias("row_id"), F.col("mean").alias("features"))
    return nearest_distance(m, m, exclude_self=True).select(F.col("row_id").cast("int").alias("class"), r6("dist", "dist"))


# ---- aggregations, windows, sorts, set operations

_TOP = "(SELECT max(o_totalprice) AS top FROM orders WHERE o_orderpriority = '1-URGENT')"


@query("SELECT o_orderpriority AS Model, max(o_totalprice) AS best FROM orders GROUP BY 1")
def best_per_model(spark, sf_dir):
    return reports.best_per_model(read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "Model"), "o_totalprice")


@query(f"SELECT o_orderpriority AS Model, round(coalesce(max(CASE WHEN o_totalprice < top THEN o_totalprice END), max(top) * 1.05), 4) AS adjusted FROM orders, {_TOP} GROUP BY 1")
def report_below_proposed_compat(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "Model")
    return reports.below_proposed(o, o.where("Model = '1-URGENT'"), "o_totalprice").select("Model", F.round("adjusted", 4).alias("adjusted"))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def top_row_per_group(spark, sf_dir):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b")
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(best).select("o_orderpriority", (-F.col("b.k")).alias("o_orderkey"), F.col("b.o_totalprice").alias("o_totalprice"))


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def distinct_counts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_returnflag").alias("flags"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_mktsegment").distinct()


@query("SELECT event_type, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 9) AS share FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    total = e.agg(F.count("*").alias("t"))
    return e.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("event_type", F.round(F.col("n") / F.col("t"), 9).alias("share"))


@query(f"SELECT class, i::INT AS i, round(m, 6) AS m FROM (SELECT class, i - 1 AS i, avg(x) AS m FROM (SELECT class, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM {_E}) GROUP BY class, i)")
def class_mean_vector(spark, sf_dir):
    m = cluster.class_means(vectors(spark, sf_dir), "class")
    return m.select("class", F.posexplode("mean").alias("i", "m")).select("class", "i", r6("m", "m"))


@query(f"SELECT i::INT AS i, round(var_pop(x), 6) AS total_var, round(avg((x - m) * (x - m)), 6) AS within_var FROM (SELECT class, i, x, avg(x) OVER (PARTITION BY class, i) AS m FROM (SELECT class, generate_subscripts(f, 1) - 1 AS i, unnest(f) AS x FROM {_E})) GROUP BY i")
def scatter_diagonals(spark, sf_dir):
    s = nullspace.scatter(vectors(spark, sf_dir), "class")
    rows = [(i, float(t), float(w)) for i, (t, w) in enumerate(zip(s.total.diagonal(), s.within.diagonal(), strict=True))]
    return spark.createDataFrame(rows, "i int, total_var double, within_var double").select("i", r6("total_var", "total_var"), r6("within_var", "within_var"))


@query("SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS med, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def score_summary(spark, sf_dir):
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    out = read(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("a"), q.alias("q"))
    return out.select("event_type", "lo", "hi", r6("a", "mean"), r6(F.col("q")[0], "med"), r6(F.col("q")[1], "p95"))


@query(f"SELECT c.class, round(max(list_distance(e.f, c.m)), 6) AS radius FROM {_E} e JOIN {_MEANS} c ON e.class = c.class GROUP BY 1")
def class_radius(spark, sf_dir):
    return score.class_radii(vectors(spark, sf_dir), "class").select("class", r6("radius", "radius"))


@query("SELECT c_nationkey AS k, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("side"))
    return c.unionByName(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("side")))


@query("SELECT c_nationkey AS k, round(c_acctbal, 2) AS a, 0 AS b FROM customer UNION ALL SELECT s_nationkey, 0, s_suppkey FROM supplier")
def union_fill_missing(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.round("c_acctbal", 2).alias("a"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("b"))
    return c.unionByName(s, allowMissingColumns=True).fillna(0)


@query("SELECT 'all' AS event_type, count(*) AS n, 0 AS place FROM events UNION ALL SELECT event_type, count(*), 1 FROM events GROUP BY 1")
def summary_row_first(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return reports.with_summary_first(e.groupBy("event_type").agg(F.count("*").alias("n")), e.agg(F.lit("all").alias("event_type"), F.count("*").alias("n")))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top_k(spark, sf_dir):
    return read(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


# ---- scalar and vector functions

_N = "(event_id % 300)"


@query(f"""SELECT event_id, round(sqrt(abs(value)), 6) AS root, round(1 / (1 + exp(-value / 100)), 6) AS logistic, round(ln(abs(value) + 1), 6) AS log1p, round(pow(2, -abs(value) / 100), 6) AS pow2,
CASE WHEN {_N} <= 1 THEN 0 WHEN {_N} = 2 THEN 1 ELSE round(2 * (ln({_N} - 1) + 0.5772156649015329) - 2.0 * ({_N} - 1) / {_N}, 6) END::DOUBLE AS path,
round(least(value, 10.0), 6) AS low, round(greatest(value, 10.0), 6) AS high, round(tanh(value / 100), 6) AS tanh, round(CASE WHEN value - 50 >= 0 THEN value - 50 ELSE (value - 50) * 0.01 END, 6) AS leaky,
floor(event_id * (29 / 100.0::DOUBLE))::BIGINT AS share, concat('Train_', event_type, '_', user_id) AS path_name FROM events""")
def scalar_functions(spark, sf_dir):
    v, n = F.col("value"), F.col("event_id") % 300
    return read(spark, sf_dir, "events").select(
        "event_id", r6(F.sqrt(F.abs(v)), "root"), r6(scalar.logistic(v / 100), "logistic"), r6(F.log(F.abs(v) + 1), "log1p"), r6(F.pow(F.lit(2.0), -F.abs(v) / 100), "pow2"),
        r6(scalar.average_path_length(n), "path"), r6(scalar.clamp_high(v, 10.0), "low"), r6(scalar.clamp_low(v, 10.0), "high"), r6(F.tanh(v / 100), "tanh"), r6(scalar.leaky_relu(v - 50), "leaky"),
        scalar.truncated_share(F.col("event_id"), 29).alias("share"), F.concat(F.lit("Train_"), "event_type", F.lit("_"), F.col("user_id").cast("string")).alias("path_name"),
    )


@query(f"SELECT row_id, round(list_sum(list_transform(f, lambda x: abs(x / n))), 6) AS l1_of_unit, round(list_sum(list_transform(f, lambda x: x * x)) / len(f), 6) AS mean_square FROM (SELECT row_id, f, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS n FROM {_E})")
def vector_functions(spark, sf_dir):
    v = prep.normalize_rows(vectors(spark, sf_dir).withColumn("raw", F.col("features")), "features")
    zero = F.transform("raw", lambda x: F.lit(0.0))
    return v.select("row_id", r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + F.abs(x)), "l1_of_unit"), r6(scalar.mean_squared_error(F.col("raw"), zero), "mean_square"))


@query("SELECT event_type, i::INT AS i, round(lo + (hi - lo) * (i / 9.0::DOUBLE), 6) AS x FROM (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), range(10) t(i)")
def linspace(spark, sf_dir):
    """Ten evenly spaced thresholds over each event type's range of values."""
    ends = read(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = ends.select("event_type", "lo", "hi", F.posexplode(scalar.linspace(0, 1, 10)).alias("i", "u"))
    return out.select("event_type", "i", r6(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("u"), "x"))


@query(f"SELECT row_id, round(list_sum(list_transform(f, lambda x: abs(x - m) / s)) / len(f), 6) AS mean_abs FROM (SELECT row_id, f, m, list_sum(list_transform(f, lambda x: abs(x - m))) / len(f) AS s FROM (SELECT row_id, f, list_sum(f) / len(f) AS m FROM {_E}))")
def contrast_normalization(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("c", scalar.contrast_normalize(F.col("features")))
    return v.select("row_id", r6(F.aggregate("c", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size("c"), "mean_abs"))


# ---- preprocessing


@query(f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {_HOLED})), 6) AS value FROM {_HOLED}")
def mean_imputation(spark, sf_dir):
    return prep.impute_mean(holed_events(spark, sf_dir), ["value"]).select("event_id", r6("value", "value"))


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value FROM events")
def standard_scaler(spark, sf_dir):
    return prep.scale(read(spark, sf_dir, "events").select("event_id", "value"), ["value"], "standard").select("event_id", r6("value", "value"))


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS value FROM events")
def minmax_scaler(spark, sf_dir):
    return prep.scale(read(spark, sf_dir, "events").select("event_id", "value"), ["value"], "minmax").select("event_id", r6("value", "value"))


@query("SELECT event_id, round((value - (SELECT quantile_cont(value, 0.5) FROM events)) / (SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) FROM events), 6) AS value FROM events")
def robust_scaler(spark, sf_dir):
    return prep.scale(read(spark, sf_dir, "events").select("event_id", "value"), ["value"], "robust").select("event_id", r6("value", "value"))


@query("""WITH g AS (SELECT quantile_cont(value, list_transform(range(0, 101), lambda k: k / 100.0::DOUBLE)) AS g FROM events),
p AS (SELECT event_id, value AS x, g, len(list_filter(g, lambda v: v < value)) AS below, len(list_filter(g, lambda v: v <= value)) AS upto FROM events, g)
SELECT event_id, round(CASE WHEN upto = 0 THEN 0 WHEN below = 101 THEN 1 WHEN upto > below THEN (below + upto - 1) / 2.0 / 100
ELSE ((upto - 1) + (x - g[upto]) / (g[least(upto + 1, 101)] - g[upto])) / 100 END, 6) AS value FROM p""")
def quantile_transformer(spark, sf_dir):
    return prep.quantile_transform(read(spark, sf_dir, "events").select("event_id", "value"), "value").select("event_id", r6("value", "value"))


@query(f"SELECT row_id, i::INT AS i, round(x / n, 6) AS x FROM (SELECT row_id, generate_subscripts(f, 1) - 1 AS i, unnest(f) AS x, sqrt(list_sum(list_transform(f, lambda y: y * y))) AS n FROM {_E})")
def row_normalizer(spark, sf_dir):
    v = prep.normalize_rows(vectors(spark, sf_dir), "features")
    return v.select("row_id", F.posexplode("features").alias("i", "x")).select("row_id", "i", r6("x", "x"))


@query("SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 AS is_test FROM documents")
def hash_split(spark, sf_dir):
    return prep.hash_split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, 0 AS train_label FROM labels WHERE toxic = 0 UNION ALL (SELECT doc_id, 1 FROM labels WHERE toxic = 1 ORDER BY md5('42:' || doc_id), doc_id LIMIT (SELECT CAST(floor(count(*) * (5 / 100.0::DOUBLE)) AS BIGINT) FROM labels WHERE toxic = 0))")
def contaminate(spark, sf_dir):
    return prep.contaminate(read(spark, sf_dir, "labels"), "doc_id", "toxic", 5).select("doc_id", "train_label")


# ---- clustering and projection


@query(f"WITH c AS (SELECT class, m FROM {_MEANS}), a AS (SELECT row_id, f, class FROM (SELECT e.row_id, e.f, c.class, row_number() OVER (PARTITION BY e.row_id ORDER BY list_distance(e.f, c.m), c.class) AS r FROM {_E} e, c) WHERE r = 1) SELECT class, i::INT AS i, round(avg(x), 6) AS m FROM (SELECT class, generate_subscripts(f, 1) - 1 AS i, unnest(f) AS x FROM a) GROUP BY class, i")
def lloyd_step(spark, sf_dir):
    v = vectors(spark, sf_dir)
    step = cluster.lloyd_step(v, cluster.class_means(v, "class"))
    return step.select("class", F.posexplode("mean").alias("i", "m")).select("class", "i", r6("m", "m"))


@query()
def kmeans_clusters(spark, sf_dir):
    return cluster.kmeans(vectors(spark, sf_dir), 10).select("row_id", "cluster")


@query()
def gaussian_mixture_clusters(spark, sf_dir):
    return cluster.gaussian_mixture(vectors(spark, sf_dir), 3).select("row_id", "cluster")


def _directed(train: DataFrame, clusters: int) -> tuple[DataFrame, nullspace.Projection]:
    """Pseudo-labels and directions: as many clusters as a null direction needs where that is few enough, else the regularised directions."""
    n, d = train.agg(F.count("*"), F.max(F.size("features"))).first()
    least = nullspace.least_clusters(n, d)
    train = cluster.kmeans(train, max(clusters, least) if least <= experiments.MOST_CLUSTERS else clusters)
    return train, nullspace.directions(nullspace.scatter(train))


@query()
def nullspace_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    train, p = _directed(normal(v), 10)
    out = score.nn_ratio(nullspace.project(v, p.w), nullspace.project(train, p.w))
    return out.select("row_id", r6("p_anomaly", "p_anomaly"), F.lit(p.kind).alias("directions"))


@query()
def nullspace_diagnostics(spark, sf_dir):
    _, p = _directed(normal(vectors(spark, sf_dir)), 10)
    return spark.createDataFrame([(p.rank_within, p.rank_total, p.null_size, p.least_clusters, p.kind)], "rank_within int, rank_total int, null_size int, least_clusters int, directions string")


@query()
def wide_nullspace(spark, sf_dir):
    """Diagnostics of the null directions that a search without a matrix of features by features finds, by the vectors' classes cut in eight."""
    v = vectors(spark, sf_dir).withColumn("cluster", F.col("class") * 8 + F.col("row_id") % 8)
    p = nullspace.wide_directions(v)
    return spark.createDataFrame([(p.rank_within, p.rank_total, p.null_size, p.least_clusters)], "rank_within int, rank_total int, null_size int, least_clusters int")


@query()
def regularized_projection_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    w = nullspace.regularized_directions(nullspace.scatter(v, "class")).w
    projected = nullspace.project(v, w)
    return score.class_mean_radius(projected, normal(projected), "class", 1e-9).select("row_id", r6("p_anomaly", "p_anomaly"))


@query()
def cluster_count_sweep(spark, sf_dir):
    return experiments.auc_by_clusters(vectors(spark, sf_dir), experiments.CLUSTER_COUNTS)


@query()
def principal_components(spark, sf_dir):
    v = vectors(spark, sf_dir)
    s = nullspace.scatter(v.withColumn("cluster", F.lit(0)))
    out = nullspace.project(v, nullspace.principal_directions(s, 3), center=s.mean)
    return out.select("row_id", *(r6(F.get("features", F.lit(k)), f"c{k}") for k in range(3)))


@query()
def rows_by_cluster(spark, sf_dir):
    return cluster.kmeans(vectors(spark, sf_dir), 10).select("row_id", "cluster").orderBy("cluster", "row_id")


@query()
def nullspace_experiment(spark, sf_dir):
    cells = [(experiments.nullspace_experiment, (scaler, noise, None, 10, True)) for scaler in experiments.SCALERS for noise in (0, 5)]
    return experiments.results(vectors(spark, sf_dir), cells, "scaler string, nCluster int, noise_percentage int", ", directions string")


@query()
def knn_experiment(spark, sf_dir):
    cells = [(experiments.knn_experiment, (scaler, 0)) for scaler in ("minmax", "normalizer")]
    return experiments.results(vectors(spark, sf_dir), cells, "scaler string, nCluster int, noise_percentage int")


@query()
def detector_experiment(spark, sf_dir):
    """Detectors as a study that is stopped halfway and goes on where it was."""
    cells = [(experiments.detector_experiment, (name, "minmax", noise)) for name in ("KNN", "IForest", "PCA") for noise in (0, 5)]
    path = scratch(spark, "study")
    rows = None
    for part in (cells[: len(cells) // 2], cells):
        rows, failed = experiments.study(vectors(spark, sf_dir), part, path, "Model string, scaled string, noise_percentage int")
        if failed:
            raise RuntimeError(f"failed cells: {failed}")
    return rows


# ---- scores

_NN = f"(SELECT a.row_id, any_value(a.label) AS label, min(list_distance(a.f, b.f)) AS nn FROM {_E} a, {_E} b WHERE b.label = 0 GROUP BY 1)"
_NEAR = f"(SELECT a.row_id, min(list_distance(a.f, b.f)) AS d FROM {_E} a, {_E} b WHERE a.label = 0 AND b.label = 0 AND a.row_id <> b.row_id GROUP BY 1)"
_RATIO = f"SELECT row_id, label, CASE WHEN r = 0 THEN 1 ELSE least(nn / r, 1) END AS p FROM {_NN}, (SELECT max(d) AS r FROM {_NEAR})"


@query(f"SELECT row_id, round(p, 6) AS p_anomaly, round(1 - p, 6) AS p_normal FROM ({_RATIO})")
def nn_ratio_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return score.nn_ratio(v, normal(v)).select("row_id", r6("p_anomaly", "p_anomaly"), r6("p_normal", "p_normal"))


@query(f"SELECT row_id, round(least(nn / greatest(r, 1e-8), 1), 6) AS p_anomaly FROM {_NN}, (SELECT max(d) AS r FROM {_NEAR})")
def nn_ratio_clamped(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return score.nn_ratio(v, normal(v), floor=1e-8).select("row_id", r6("p_anomaly", "p_anomaly"))


@query(f"SELECT row_id, round(least(nn / r, 1), 6) AS p_anomaly FROM {_NN}, (SELECT quantile_cont(d, 0.95) AS r FROM {_NEAR})")
def nn_ratio_percentile(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return score.nn_ratio(v, normal(v), how="p95").select("row_id", r6("p_anomaly", "p_anomaly"))


@query(f"SELECT i::INT AS i, round(avg(CASE WHEN r * (1 + i / 100.0) = 0 THEN 1 ELSE least(nn / (r * (1 + i / 100.0)), 1) END), 6) AS mean_p FROM {_NN}, (SELECT max(d) AS r FROM {_NEAR}), (SELECT unnest(range(-100, 100)) AS i) GROUP BY 1")
def radius_sweep(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return score.scaled_radius_sweep(v, normal(v)).groupBy("i").agg(F.round(F.avg("p_anomaly"), 6).alias("mean_p"))


@query(f"SELECT row_id, round(nn, 6) AS score FROM {_NN}")
def raw_min_distance(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return score.min_distance(v, normal(v)).select("row_id", r6("score", "score"))


@query(f"WITH c AS (SELECT c.class, any_value(c.m) AS m, max(list_distance(e.f, c.m)) AS r FROM {_E} e JOIN {_MEANS} c ON e.class = c.class GROUP BY 1) SELECT row_id, round(p, 6) AS p_normal, (1 - p > 0.9)::INT AS predicted FROM (SELECT row_id, max(greatest(1 - list_distance(e.f, c.m) / (c.r + 1e-9), 0)) AS p FROM {_E} e, c GROUP BY 1)")
def class_mean_radius_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out = score.class_mean_radius(v, v, "class", 1e-9)
    return out.select("row_id", r6("p_normal", "p_normal"), score.predict(F.col("p_anomaly"), threshold=0.9).alias("predicted"))


@query(f"WITH h AS (SELECT a.class, any_value(a.m) AS m, min(list_distance(a.m, b.m)) / 2 AS half FROM {_MEANS} a, {_MEANS} b WHERE a.class <> b.class GROUP BY 1) SELECT row_id, class, round(1 / (1 + exp(d / half - 1)), 6) AS p_near FROM (SELECT e.row_id, h.class, h.half, list_distance(e.f, h.m) AS d, row_number() OVER (PARTITION BY e.row_id ORDER BY list_distance(e.f, h.m), h.class) AS r FROM {_E} e, h) WHERE r = 1")
def logistic_centroid_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return score.logistic_centroid(v, v, "class").select("row_id", "class", r6("p_near", "p_near"))


_KNN = f"(SELECT row_id, label AS y, r FROM (SELECT a.row_id, b.label, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.f, b.f), b.row_id) AS r FROM {_E} a, {_E} b WHERE a.row_id <> b.row_id))"


@query(f"SELECT row_id, k::INT AS k, round(avg(y), 6) AS p_anomaly, (avg(y) > 0.5)::INT AS predicted FROM {_KNN}, (SELECT unnest([1, 3, 5, 7, 9, 11]) AS k) WHERE r <= k GROUP BY row_id, k")
def knn_vote_grid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out = score.knn_vote(v, v, "label", [1, 3, 5, 7, 9, 11], exclude_self=True)
    return out.select("row_id", "k", r6("p_anomaly", "p_anomaly"), "predicted")


_FOLD = f"(SELECT row_id, f, (class < 5)::INT AS y, row_id % 5 AS fold FROM {_E})"


@query(f"""WITH r AS (SELECT row_id, y, fold, ny, r FROM (SELECT a.row_id, a.y, a.fold, b.y AS ny, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.f, b.f), b.row_id) AS r FROM {_FOLD} a, {_FOLD} b WHERE a.fold <> b.fold)),
p AS (SELECT k, row_id, any_value(y) AS y, any_value(fold) AS fold, (avg(ny) > 0.5)::INT AS p FROM r, (SELECT unnest([1, 3, 5, 7, 9, 11]) AS k) WHERE r <= k GROUP BY k, row_id),
c AS (SELECT k, fold, sum((p = 1 AND y = 1)::INT) AS tp, sum((p <> y)::INT) AS wrong FROM p GROUP BY k, fold)
SELECT k::INT AS k, round(sum(CASE WHEN 2 * tp + wrong = 0 THEN 0 ELSE 2 * tp / (2 * tp + wrong)::DOUBLE END) / 5, 6) AS mean_f1 FROM c GROUP BY k""")
def knn_grid_search(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("y", (F.col("class") < 5).cast("int"))
    return score.knn_grid_search(v, "y", list(experiments.NEIGHBORS), F.col("row_id") % 5).select("k", r6("mean_f1", "mean_f1"))


# ---- optimisation


@query()
def training_losses(spark, sf_dir):
    """The summed log loss of each epoch and batch of a logistic regression over all vectors."""
    return optimize.fit_logistic(vectors(spark, sf_dir), "label", batches=8).table(read(spark, sf_dir, "embeddings"))


@query()
def logistic_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out = optimize.logistic_scores(v, optimize.fit_logistic(v, "label"))
    return out.select("row_id", r6("score", "p"), score.predict(F.col("score"), "ge", 0.5).alias("predicted"))


# ---- thresholds and metrics

_ROC = f"(SELECT s, tp, fp, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(fp) OVER (ORDER BY s DESC) AS cfp, sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM (SELECT score AS s, sum(label) AS tp, sum(1 - label) AS fp FROM {_S} GROUP BY score))"


@query(f"SELECT s, ctp::BIGINT AS ctp, cfp::BIGINT AS cfp FROM {_ROC}")
def roc_curve(spark, sf_dir):
    return metrics.roc_curve(scored_events(spark, sf_dir)).select("s", "ctp", "cfp")


@query(f"SELECT round(sum(fp * (ctp - tp + tp / 2.0::DOUBLE) / (p::DOUBLE * n)), 6) AS auc_roc, round(sum(tp::DOUBLE / p * (ctp::DOUBLE / (ctp + cfp))), 6) AS average_precision, round(greatest(max(ctp::DOUBLE / p - cfp::DOUBLE / n), 0), 6) AS youden_j FROM {_ROC}")
def ranking_metrics(spark, sf_dir):
    return metrics.ranking_metrics(scored_events(spark, sf_dir)).select(r6("auc_roc", "auc_roc"), r6("average_precision", "average_precision"), r6("youden_j", "youden_j"))


def _cells(where: str) -> str:
    return f"SELECT sum(({where} AND label = 1)::INT) AS tp, sum(({where} AND label = 0)::INT) AS fp, sum((NOT ({where}) AND label = 0)::INT) AS tn, sum((NOT ({where}) AND label = 1)::INT) AS fn FROM"


_CLASS = "round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp)::DOUBLE, 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn)::DOUBLE, 6) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) END AS f1, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) END AS mcc"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(r6(c, c) for c in ("accuracy", "precision", "recall", "f1", "mcc")))


@query(f"SELECT t AS threshold, {_CLASS} FROM (SELECT t, " + _cells("p > t")[7:] + f" ({_RATIO}), (SELECT unnest([0.001, 0.2, 0.5, 0.9]) AS t) GROUP BY t)")
def fixed_thresholds(spark, sf_dir):
    v = vectors(spark, sf_dir)
    p = score.nn_ratio(v, normal(v)).join(v.select("row_id", "label"), "row_id")
    p = p.withColumn("threshold", F.explode(F.array(*map(F.lit, (0.001, 0.2, 0.5, 0.9)))))
    return _rounded(metrics.classification_metrics(metrics.confusion(p, F.col("p_anomaly") > F.col("threshold"), F.col("label"), "threshold")), "threshold")


@query(f"SELECT {_CLASS} FROM (" + _cells("score > (SELECT quantile_cont(value, 0.5) FROM events)") + f" {_S})")
def median_threshold(spark, sf_dir):
    out = score.predict_above_median(scored_events(spark, sf_dir))
    return _rounded(metrics.classification_metrics(metrics.confusion(out, F.col("predicted") == 1, F.col("label"))))


@query(f"WITH b AS (SELECT max(s) AS t FROM (SELECT s, ctp::DOUBLE / p - cfp::DOUBLE / n AS j, max(ctp::DOUBLE / p - cfp::DOUBLE / n) OVER () AS top FROM {_ROC}) WHERE j = top) SELECT {_CLASS} FROM (" + _cells("score >= (SELECT t FROM b)") + f" {_S})")
def youden_threshold(spark, sf_dir):
    e = scored_events(spark, sf_dir)
    t = metrics.ranking_metrics(e).select("youden_threshold")
    cells = metrics.confusion(e.crossJoin(F.broadcast(t)), F.col("score") >= F.col("youden_threshold"), F.col("label"))
    return _rounded(metrics.classification_metrics(cells))


@query(f"SELECT round(100 * sum(fp * (ctp - tp + tp / 2.0::DOUBLE) / (p::DOUBLE * n)), 4) AS auc_roc, round(100 * sum(tp::DOUBLE / p * (ctp::DOUBLE / (ctp + cfp))), 4) AS average_precision FROM {_ROC}")
def percent_metrics(spark, sf_dir):
    out = reports.in_percent(metrics.ranking_metrics(scored_events(spark, sf_dir)), "auc_roc", "average_precision")
    return out.select(F.round("auc_roc", 4).alias("auc_roc"), F.round("average_precision", 4).alias("average_precision"))


@query("SELECT toxic AS y_true, (n_chars > 1500)::INT AS y_pred, count(*) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return j.groupBy(F.col("toxic").alias("y_true"), (F.col("n_chars") > 1500).cast("int").alias("y_pred")).agg(F.count("*").alias("n"))


_UNIT = "(SELECT (value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) + 1e-10 FROM events) AS p, (event_type = 'purchase')::INT AS label FROM events)"


@query(f"SELECT round(k / 1000.0, 6) AS threshold, {_CLASS} FROM (SELECT k, " + _cells("p > k / 1000.0::DOUBLE")[7:] + f" {_UNIT}, (SELECT unnest(range(0, 1001)) AS k) GROUP BY k)")
def threshold_sweep(spark, sf_dir):
    p = score.min_max_probability(scored_events(spark, sf_dir)).select(F.col("p_anomaly").alias("score"), "label")
    out = metrics.threshold_sweep(p)
    return _rounded(out, "threshold").withColumn("threshold", F.round("threshold", 6))


# ---- detectors

_FEATURES = "(SELECT s_suppkey AS row_id, s_acctbal AS x0, (s_suppkey % 7)::DOUBLE AS x1 FROM supplier)"


def _supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("row_id"), F.array("s_acctbal", (F.col("s_suppkey") % 7).cast("double")).alias("features"))


@query(f"SELECT row_id, round(max(d), 6) AS score FROM (SELECT a.row_id, list_distance(a.f, b.f) AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.f, b.f), b.row_id) AS r FROM {_E} a, {_E} b WHERE b.label = 0) WHERE r <= 5 GROUP BY 1")
def detector_knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return tabular.knn(v, normal(v)).select("row_id", r6("score", "score"))


@query(f"""WITH x AS (SELECT row_id, 0 AS i, x0 AS x FROM {_FEATURES} UNION ALL SELECT row_id, 1, x1 FROM {_FEATURES}),
s AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i),
b AS (SELECT row_id, i, least(floor((x - lo) / CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 1 END), 9) AS bin FROM x JOIN s USING (i)),
c AS (SELECT i, bin, count(*) AS n FROM b GROUP BY i, bin), d AS (SELECT i, bin, n / max(n) OVER (PARTITION BY i)::DOUBLE AS density FROM c)
SELECT row_id, round(sum(-log2(density + 0.1)), 6) AS score FROM b JOIN d USING (i, bin) GROUP BY row_id""")
def detector_hbos(spark, sf_dir):
    s = _supplier_features(spark, sf_dir)
    return tabular.hbos(s, s).select("row_id", r6("score", "score"))


_TAILS = f"""x AS (SELECT row_id, 0 AS i, x0 AS x FROM {_FEATURES} UNION ALL SELECT row_id, 1, x1 FROM {_FEATURES}),
m AS (SELECT i, avg(x) AS a, stddev_pop(x) AS sd, count(*)::DOUBLE AS n FROM x GROUP BY i),
k AS (SELECT x.i, avg(pow((x - a) / sd, 3)) AS skew FROM x JOIN m USING (i) GROUP BY x.i),
t AS (SELECT row_id, x.i, -ln(count(*) OVER (PARTITION BY x.i ORDER BY x) / n) AS l, -ln(count(*) OVER (PARTITION BY x.i ORDER BY x DESC) / n) AS r, skew FROM x JOIN m USING (i) JOIN k USING (i)),
u AS (SELECT *, CASE WHEN skew < 0 THEN l WHEN skew > 0 THEN r ELSE l + r END AS s FROM t)"""


@query(f"WITH {_TAILS} SELECT row_id, round(greatest(sum(l), sum(r), sum(s)), 6) AS score FROM u GROUP BY row_id")
def detector_ecod(spark, sf_dir):
    return tabular.ecod(_supplier_features(spark, sf_dir)).select("row_id", r6("score", "score"))


@query(f"WITH {_TAILS} SELECT row_id, round(sum(greatest(s, (l + r) / 2)), 6) AS score FROM u GROUP BY row_id")
def detector_copod(spark, sf_dir):
    return tabular.copod(_supplier_features(spark, sf_dir)).select("row_id", r6("score", "score"))


@query(f"""WITH nb AS (SELECT row_id, id, d FROM (SELECT a.row_id, b.row_id AS id, list_distance(a.f, b.f) AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.f, b.f), b.row_id) AS r FROM {_E} a, {_E} b WHERE a.row_id <> b.row_id) WHERE r <= 20),
kd AS (SELECT row_id AS id, max(d) AS k FROM nb GROUP BY 1), lrd AS (SELECT row_id, 1 / (avg(greatest(d, k)) + 1e-10) AS lrd FROM nb JOIN kd USING (id) GROUP BY 1)
SELECT nb.row_id, round(avg(o.lrd) / any_value(own.lrd), 6) AS score FROM nb JOIN lrd o ON nb.id = o.row_id JOIN lrd own ON nb.row_id = own.row_id GROUP BY 1""")
def detector_lof(spark, sf_dir):
    return tabular.lof(vectors(spark, sf_dir)).select("row_id", r6("score", "score"))


def _detector(name: str, **options: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return DETECTORS[name](v, v if name == "DevNet" else normal(v), **options).select("row_id", r6("score", "score"))

    return run


#: A detector's defaults, or the reference's epochs where these are more; nets but LUNAR's and NeuTraLAD's are fitted on `SAMPLE_ROWS` rows at most, all rows are scored.
for _name, _options in {
    "COF": {}, "SOD": {}, "CBLOF": {"clusters": 3}, "PCA": {}, "IForest": {}, "LODA": {}, "SUOD": {}, "DIF": {}, "OCSVM": {}, "AE1SVM": {},
    "AutoEncoder": {}, "VAE": {}, "DeepSVDD": {}, "DASVDD": {"epochs": 100}, "NeuTraLAD": {"epochs": 200}, "DevNet": {}, "LUNAR": {}, "ALAD": {}, "SO_GAAL": {}, "MO_GAAL": {},
}.items():
    QUERIES[f"detector_{_name.lower()}"] = _detector(_name, **_options)


@query()
def saved_detector(spark, sf_dir):
    """Components fitted on the normal vectors, saved, loaded, and applied to all."""
    v, path = vectors(spark, sf_dir), scratch(spark, "model")
    Detector(algorithm="PCA", contamination=0.05).fit(normal(v)).save(path)
    return DetectorModel.load(path).transform(v).select("row_id", r6("score", "score"), r6("p_anomaly", "p_anomaly"), "prediction")


@query(f"SELECT row_id, round(avg(s), 6) AS score FROM (SELECT row_id, (nn - min(nn) OVER ()) / (max(nn) OVER () - min(nn) OVER () + 1e-10) AS s FROM {_NN} UNION ALL SELECT row_id, (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER () + 1e-10) FROM (SELECT row_id, nn * nn AS q FROM {_NN})) GROUP BY 1")
def ensemble_average(spark, sf_dir):
    from noveltide.operators.detectors.learned import average

    v = vectors(spark, sf_dir)
    one = score.min_distance(v, normal(v))
    return average([one, one.withColumn("score", F.col("score") * F.col("score"))]).select("row_id", r6("score", "score"))


_WIDE = f"x AS (SELECT row_id, unnest(range(len(f))) AS i, unnest(f) AS x FROM {_E})"


def _on_vectors(sql: str) -> str:
    """A detector's SQL over two columns of suppliers, on every column of the vectors."""
    return sql.replace(f"x AS (SELECT row_id, 0 AS i, x0 AS x FROM {_FEATURES} UNION ALL SELECT row_id, 1, x1 FROM {_FEATURES})", _WIDE)


@query(_on_vectors(ORACLES["detector_hbos"]))
def hbos_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return tabular.hbos(v, v).select("row_id", r6("score", "score"))


@query(_on_vectors(ORACLES["detector_ecod"]))
def ecod_vectors(spark, sf_dir):
    return tabular.ecod(vectors(spark, sf_dir)).select("row_id", r6("score", "score"))


@query(_on_vectors(ORACLES["detector_copod"]))
def copod_vectors(spark, sf_dir):
    return tabular.copod(vectors(spark, sf_dir)).select("row_id", r6("score", "score"))


def outlier_table(spark: SparkSession, sf_dir: str, scalers: tuple[str, ...]) -> DataFrame:
    """A table by outlier mode, scaler and split, written and read by its partitions: each mode's outliers are every third class of the vectors."""
    v, parts = prep.hash_split(vectors(spark, sf_dir), "row_id"), None
    for scaler in scalers:
        scaled = prep.scale_vectors(v, scaler, ~F.col("is_test") & (F.col("label") == 0))
        kept = scaled.where("label = 1 OR label = 0").withColumn("split", F.when(F.col("is_test") | (F.col("label") == 1), "test").otherwise("train"))
        for k, mode in enumerate(experiments.OUTLIER_MODES):
            rows = kept.where((F.col("label") == 0) | (F.pmod("class", F.lit(3)) == k)).select("row_id", "features", "label", "split", F.lit(mode).alias("outlier_mode"), F.lit(scaler).alias("scaler"))
            parts = rows if parts is None else parts.unionByName(rows)
    path = scratch(spark, "outliers")
    parts.write.partitionBy("outlier_mode", "scaler", "split").parquet(path)
    return spark.read.parquet(path)


@query()
def outlier_mode_study(spark, sf_dir):
    """Nearest neighbours and components by outlier mode, two scalers, without times; held against NumPy in the tests."""
    scalers = ("minmax", "standard")
    cells = [(experiments.outlier_detector_experiment, (name, mode, scaler)) for name in ("KNN", "PCA") for mode in experiments.OUTLIER_MODES for scaler in scalers]
    out = experiments.results(outlier_table(spark, sf_dir, scalers), cells, "Model string, outlier_mode string, scaler string")
    return out.select("Model", "outlier_mode", "scaler", r6("AUCROC", "AUCROC"), r6("AUCPR", "AUCPR"), r6("Accuracy", "Accuracy"), r6("F1 Score", "F1 Score"))


# ---- reports and streams


@query("SELECT o_orderpriority AS Model, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS O, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS P FROM orders GROUP BY 1")
def pivot_report(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "Model")
    return reports.pivot_report(o, "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query("WITH t AS (SELECT o_orderstatus AS scaler, max(o_totalprice) AS top FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT scaler, sum((o_totalprice > top)::INT)::BIGINT AS losses FROM orders JOIN t ON o_orderstatus = scaler WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def losses_per_scaler(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "scaler")
    return reports.losses_per_scaler(o.where("o_orderpriority <> '1-URGENT'"), o.where("o_orderpriority = '1-URGENT'"), "o_totalprice")


@query("SELECT o_orderpriority AS Model, max(o_totalprice) AS best, (SELECT max(o_totalprice) FROM orders WHERE o_orderpriority = '1-URGENT') AS proposed FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def best_and_proposed(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "Model")
    return reports.with_best_proposed(o.where("Model <> '1-URGENT'"), o.where("Model = '1-URGENT'"), "o_totalprice")


@query("WITH r AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1) SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS events, sum((abs(value - mean) / CASE WHEN std = 0 THEN 1 ELSE std END > 2)::INT)::BIGINT AS alerts FROM events JOIN r USING (event_type) GROUP BY 1, 2")
def stream_alerts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    reference = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    source, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    e.write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    counted = scoring.windowed_alerts(scoring.score_stream(stream, reference), threshold=2.0)
    scoring.run_foreach(counted, lambda batch, _: batch.write.mode("overwrite").parquet(out), scratch(spark, "stream-state"), "complete").awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "alerts")


@query("WITH r AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1) SELECT event_id, round(abs(value - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS score FROM events JOIN r USING (event_type)")
def stream_scores(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    reference = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    source, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    e.write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    scoring.run_to_table(scoring.score_stream(stream, reference), out, scratch(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("event_id", r6("score", "score"))
