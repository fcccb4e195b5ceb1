"""Session helpers: package shipping, the shared folder, and intermediate tables."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipping = Lock()


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("noveltide")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("NOVELTIDE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Python functions are pickled by reference, so a worker must be able to import
    the module. Spark serves the zip to every executor, also to later ones, and takes one of a name only:
    of threads that come here at a time, one ships and the others wait for it.
    """
    sc = spark.sparkContext
    with _shipping:
        if getattr(sc, "_noveltide_shipped", False):
            return
        target = Path(tempfile.mkdtemp(prefix="noveltide-")) / "noveltide.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(_PACKAGE.rglob("*.py")):
                out.write(path, path.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(target))
        sc._noveltide_shipped = True


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a session of one process (tests, a single machine) uses a folder of its own;
    on a cluster the setting must name shared storage, and its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_noveltide_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="noveltide-shared-")
        spark.sparkContext._noveltide_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The files survive the loss of any executor, cut the lineage, and give the
    planner the true size, so that a join broadcasts it only when it is small.
    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noveltide/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._noveltide_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` returned; only where all that is made of it has been written itself."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._noveltide_path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bound Arrow batches of whole texts by rows and bytes, unless the user has set a size.

    The setting stays in the session, as Spark reads it when a plan runs. `spark.noveltide.smallBatches` = false leaves it alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get("spark.noveltide.smallBatches", "true") == "true" and spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not at the driver's next collection of garbage.

    This collects the driver's garbage; `spark.noveltide.freeShuffles` = false leaves it to the driver.
    """
    if spark.conf.get("spark.noveltide.freeShuffles", "true") == "true":
        gc.collect()
        spark.sparkContext._jvm.System.gc()
