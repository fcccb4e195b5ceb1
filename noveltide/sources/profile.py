"""What a query costs: its stages as a table, by Spark's own status store."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "run_id string, stage int, attempt int, name string, status string, tasks int, failed_tasks int, run_ms long, cpu_ms long, gc_ms long, "
    "rows_read long, bytes_read long, rows_written long, bytes_written long, shuffle_rows_read long, shuffle_bytes_read long, "
    "shuffle_rows_written long, shuffle_bytes_written long, spilled_bytes long"
)


def profile(spark: SparkSession, action: Callable[[], object], run_id: str | None = None) -> DataFrame:
    """Run an action and return its stages, a row per attempt, the longest first; stages that Spark skipped are left out.

    The jobs are those that this thread starts, or threads that inherit its properties, by a tag of their own. Rows come from
    the status store, which holds the last spark.ui.retainedStages stages: raise that for an action of more. An action without jobs gives an empty table; one
    that fails raises its error. The table has a row per stage, however large the action's data.
    """
    sc = spark.sparkContext
    run_id = run_id or uuid.uuid4().hex
    tag = f"profile-{uuid.uuid4().hex}"
    sc.addJobTag(tag)
    try:
        action()
    finally:
        sc.removeJobTag(tag)
    inner = sc._jsc.sc()
    inner.listenerBus().waitUntilEmpty()
    store, tracker = inner.statusStore(), inner.statusTracker()
    jobs = sorted(tracker.getJobIdsForTag(tag))
    stages = sorted({s for j in jobs for s in (tracker.getJobInfo(j).get().stageIds() if tracker.getJobInfo(j).isDefined() else ())})
    no_quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    rows = []
    for stage in stages:
        attempts = store.stageData(stage, False, sc._jvm.java.util.ArrayList(), False, no_quantiles)
        for i in range(attempts.size()):
            s = attempts.apply(i)
            if (status := s.status().toString()) != "SKIPPED":
                rows.append((
                    run_id, stage, s.attemptId(), s.name().split(" at ")[0], status, s.numTasks(), s.numFailedTasks(), s.executorRunTime(), s.executorCpuTime() // 1_000_000, s.jvmGcTime(),
                    s.inputRecords(), s.inputBytes(), s.outputRecords(), s.outputBytes(), s.shuffleReadRecords(), s.shuffleReadBytes(),
                    s.shuffleWriteRecords(), s.shuffleWriteBytes(), s.diskBytesSpilled(),
                ))
    rows.sort(key=lambda r: (-r[7], r[1], r[2]))
    return spark.createDataFrame(rows, SCHEMA)


def append_profile(spark: SparkSession, action: Callable[[], object], path: str, run_id: str | None = None) -> None:
    """Run an action and append its stages to the Parquet table at `path`; an action that fails appends nothing."""
    profile(spark, action, run_id).coalesce(1).write.mode("append").parquet(path)
