"""Result tables as the reports' readers know them: CSV with one header, whatever number of runs appended to it."""

from __future__ import annotations

import csv
import io
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType
from pyarrow import fs

from noveltide import session

#: The header is a file of its own. Spark's readers pass over names with an underscore; `cat _header.csv part-*` is the table as one file.
HEADER = "_header.csv"


class _Written(WriterCommitMessage):
    def __init__(self, staged: str, rows: int):
        self.staged, self.rows = staged, rows


def _line(values: list) -> str:
    """A line of CSV; null is an empty field and an empty text a quoted one."""
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_NOTNULL if any(v == "" for v in values) else csv.QUOTE_MINIMAL, lineterminator="\n").writerow(values)
    return out.getvalue()


def _text(v: object) -> object:
    """Values as Spark's CSV reader takes them."""
    if isinstance(v, float):
        return "NaN" if v != v else "Inf" if v == float("inf") else "-Inf" if v == float("-inf") else repr(v)
    return "true" if v is True else "false" if v is False else v


class _Writer(DataSourceWriter):
    """Two phases: tasks write files under a staging name that readers don't see, the driver renames those of a job whose tasks have all succeeded."""

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.job = path, columns, overwrite, uuid.uuid4().hex

    def _where(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = self._where()
        system.create_dir(root, recursive=True)
        staged, n = f"{root}/_staged-{self.job}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(staged) as out:
            for row in rows:
                out.write(_line([_text(v) for v in row]).encode())
                n += 1
        return _Written(staged, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = self._where()
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-")] if self.overwrite else []
        header = _line(self.columns)
        known = system.get_file_info(f"{root}/{HEADER}").type == fs.FileType.File
        if known and not self.overwrite:
            with system.open_input_stream(f"{root}/{HEADER}") as f:
                if (there := f.read().decode()) != header:
                    self.abort(messages)
                    raise ValueError(f"the file has other columns: {there.strip()}")
        else:
            with system.open_output_stream(f"{root}/{HEADER}") as out:
                out.write(header.encode())
        for k, m in enumerate(messages):
            if m is not None:
                system.move(m.staged, f"{root}/part-{self.job}-{k:05d}.csv") if m.rows else system.delete_file(m.staged)
        for f in old:
            system.delete_file(f)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What the job's tasks have staged goes, that of failed attempts too."""
        system, root = self._where()
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"_staged-{self.job}-"):
                system.delete_file(f.path)


class ResultsCsv(DataSource):
    """`df.write.format("results_csv").mode("append").save(path)`; see `append_csv`."""

    @classmethod
    def name(cls) -> str:
        return "results_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names, overwrite)


def append_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Append a table to a CSV directory of one header, or replace it.

    The first run writes the header, later ones must have the same columns. A job that fails leaves nothing. `path` is in a file
    system that pyarrow knows (a shared local folder, hdfs, s3, gs).
    """
    session.ship(df.sparkSession)
    df.sparkSession.dataSource.register(ResultsCsv)
    df.write.format("results_csv").mode("overwrite" if overwrite else "append").save(path)


def read_results(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All appended runs as one table, by Spark's own CSV reader."""
    return spark.read.schema(schema).options(nullValue="\u0000", escape='"', multiLine=True).csv(path)
