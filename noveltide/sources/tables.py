"""Sources and sinks of experiment tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from noveltide import session
from noveltide.operators.prep import hash_order, head_share_split
from noveltide.operators.quantiles import global_rank

# Columns of result tables.
NOISE_RESULT = "scaler string, nCluster int, noise_percentage int, AUCROC double, AUCPR double, Accuracy double, MCC double, `F1 Score` double, Precision double, Recall double, `Time Train` double, `Time Test` double"
OUTLIER_RESULT = "outlier_mode string, scaler string, nCluster int, AUCROC double, AUCPR double, Accuracy double, MCC double, `F1 Score` double, Precision double, Recall double, `Time Train` double, `Time Test` double"
BASELINE_RESULT = "Dataset string, Model string, scaled string, noise_percentage int, AUCROC double, AUCPR double, Accuracy double, MCC double, `F1 Score` double, Precision double, Recall double, `Time Train` double, `Time Test` double"


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, header: bool = True) -> DataFrame:
    """A CSV table; `~` in local paths is resolved. With a schema there's one pass, without one Spark infers types in a second."""
    if path.startswith("~"):
        path = os.path.expanduser(path)
    reader = spark.read.option("header", header)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark knows has the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one of the schema."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_partition(spark: SparkSession, root: str, **keys: object) -> DataFrame:
    """Of a table partitioned by scaler, dataset, mode or split, the directories with the given keys; others aren't listed in the scan."""
    df = spark.read.parquet(root)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def append(df: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append rows; a run id becomes a partition column, which takes the place of names that nobody has used."""
    if run_id is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def numbered(df: DataFrame, name: str = "position") -> DataFrame:
    """Add the row's place, from 0, in the files that `df` was read from: by file name, by place of the block in the file, by place in the block.

    `df` comes straight from a file source. Rows are written once with their block and their number in the task, so that
    places hold whatever happens to executors; then a row a block gives the rows before it. No rows are sorted.
    """
    file, block, at = "__file", "__block", "__at"
    rows = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(at))
    rows = session.materialize(rows, "numbered")
    blocks = rows.groupBy(file, block).agg(F.count("*").alias("__n"), F.min(at).alias("__first"))
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = session.materialize(blocks.select(file, block, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "blocks")
    return rows.join(blocks, [file, block]).withColumn(name, F.col("__before") + F.col(at) - F.col("__first")).drop(file, block, at, "__first", "__before")


def head_split(df: DataFrame, share: float = 0.1) -> DataFrame:
    """Add `is_test`: the first int(rows * share) rows in the order of the files."""
    rows = numbered(df, "__position")
    return rows.withColumn("is_test", F.col("__position") < int(rows.count() * share)).drop("__position")


def minibatches(df: DataFrame, id_col: str, size: int, epochs: int, drop_last: bool = False, seed: int = 42) -> DataFrame:
    """Each epoch's rows in an order of its own: `epoch` and `batch` from 0, `size` rows a batch; `drop_last` leaves out a short last one.

    Orders are those of md5 of seed, epoch and id, so they are the same in any run and engine. Ranks are taken in two
    levels, ranges of the order first; nothing is gathered. To train on one batch after the other, filter by both columns or write partitioned by them.
    """
    out = None
    for epoch in range(epochs):
        ranked = global_rank(df.withColumn("epoch", F.lit(epoch)), [hash_order(id_col, f"{seed}:{epoch}"), F.col(id_col)], "__rank")
        ranked = ranked.withColumn("batch", F.floor((F.col("__rank") - 1) / size).cast("int")).drop("__rank")
        if drop_last:
            ranked = ranked.where(F.col("batch") < df.count() // size)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def sorted_label_split(df: DataFrame, id_col: str, label_col: str, share: float = 0.4) -> DataFrame:
    """`is_test` for the first `share` of the rows sorted by label, descending; ids break ties."""
    order: list[Column] = [F.desc(label_col), F.asc(id_col)]
    return head_share_split(df, order, share)


def synthetic(spark: SparkSession, n: int, d: int, anomalies: float = 0.1, separation: float = 1.0, flip: float = 0.01, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n rows of d features (0.6 d informative, 0.1 d sums of them, the rest noise) in two classes, made in parallel from seeds."""
    informative, redundant = max(1, int(0.6 * d)), int(0.1 * d)
    df = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "row_id")
    df = df.withColumn("label", (F.rand(seed) < anomalies).cast("int"))
    cols = []
    for i in range(informative):
        cols.append(F.randn(seed + 1 + i) + F.col("label") * separation * (1 if i % 2 == 0 else -1))
    df = df.withColumn("base", F.array(*cols))
    extra = [F.get("base", F.lit(j % informative)) + F.get("base", F.lit((j + 1) % informative)) for j in range(redundant)]
    noise = [F.randn(seed + 10_007 + j) for j in range(d - informative - redundant)]
    df = df.withColumn("features", F.concat("base", F.array(*extra, *noise)) if extra or noise else F.col("base"))
    flipped = F.when(F.rand(seed + 99_991) < flip, 1 - F.col("label")).otherwise(F.col("label"))
    return df.select("row_id", "features", flipped.alias("label"))
