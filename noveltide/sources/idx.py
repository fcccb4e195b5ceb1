"""Image sources: tables of the IDX format, read by byte ranges and written in files of bounded size."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from noveltide import session

# The format's codes of element types; numbers are big-endian.
TYPES = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}

#: Bytes of a file that a task reads, and bytes of rows that it holds at a time.
RANGE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: Bytes of rows in a written file; a task holds one file's rows.
FILE_BYTES = 32 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _header(f, path: str) -> tuple[np.dtype, list[int], int]:
    """The element type, the dimensions, and the bytes of the header."""
    start = f.read(4)
    if len(start) < 4 or start[:2] != b"\0\0" or start[2] not in TYPES or start[3] == 0:
        raise ValueError(f"not an IDX file: {path}")
    sizes = f.read(4 * start[3])
    if len(sizes) < 4 * start[3]:
        raise ValueError(f"the header is cut off: {path}")
    return np.dtype(TYPES[start[2]]), list(struct.unpack(f">{start[3]}I", sizes)), 4 + len(sizes)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, size: int, labels: str | None):
        self.file, self.start, self.end, self.size, self.labels = file, start, end, size, labels


class _Reader(DataSourceReader):
    def __init__(self, path: str, labels: str | None, range_bytes: int):
        self.path, self.labels, self.range_bytes = path, labels, range_bytes

    def partitions(self) -> list[_Range]:
        """Ranges from the listing alone; no file is opened here."""
        system, root = _open(self.path)
        one = system.get_file_info(root)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if one.is_file:
            files = [(one, self.labels)]
        else:
            inside = sorted((f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
            files = [(f, self.labels and f"{self.labels.rstrip('/')}/{f.base_name}") for f in inside]
        out = []
        for f, labels in files:
            out += [_Range(f.path, a, min(a + self.range_bytes, f.size), f.size, labels) for a in range(0, max(f.size, 1), self.range_bytes)]
        return out

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        """The rows whose first byte lies in the range. Spark hands over None where there are no files."""
        if part is None:
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.file) as f:
            kind, sizes, at = _header(f, part.file)
            width = int(np.prod(sizes[1:], dtype=object)) if len(sizes) > 1 else 1
            bytes_ = width * kind.itemsize
            if part.size != at + sizes[0] * bytes_:
                raise ValueError(f"{part.size} bytes, the header tells of {at + sizes[0] * bytes_}: {part.file}")
            if bytes_ == 0:
                if sizes[0]:
                    raise ValueError(f"rows without values: {part.file}")
                return
            first, last = (min(sizes[0], max(0, -(-(x - at) // bytes_))) for x in (part.start, part.end))
            labels = self._labels(part.labels, sizes[0], first, last) if first < last else None
            step = max(1, BATCH_BYTES // (8 * width))
            for a in range(first, last, step):
                n = min(step, last - a)
                f.seek(at + a * bytes_)
                values = np.frombuffer(f.read(n * bytes_), kind).astype("f8")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * width, pa.int32()), pa.array(values))
                names = pa.array([part.file.rsplit("/", 1)[-1]] * n)
                mine = pa.nulls(n, pa.float64()) if labels is None else pa.array(labels[a - first : a - first + n])
                yield pa.RecordBatch.from_arrays([names, pa.array(np.arange(a, a + n)), lists, mine], names=["file", "place", "features", "label"])

    @staticmethod
    def _labels(path: str | None, rows: int, first: int, last: int) -> np.ndarray | None:
        if path is None:
            return None
        system, name = _open(path)
        with system.open_input_file(name) as f:
            kind, sizes, at = _header(f, path)
            if sizes != [rows]:
                raise ValueError(f"{rows} rows have labels of dimensions {sizes}: {path}")
            f.seek(at + first * kind.itemsize)
            raw = f.read((last - first) * kind.itemsize)
        if len(raw) < (last - first) * kind.itemsize:
            raise ValueError(f"the labels are cut off: {path}")
        return np.frombuffer(raw, kind).astype("f8")


class _Written(WriterCommitMessage):
    def __init__(self, staged: list[str]):
        self.staged = staged


class _Writer(DataSourceWriter):
    """Files are staged under names that readers pass over; the driver renames those of a job whose tasks have all succeeded."""

    def __init__(self, path: str, shape: list[int], code: int, overwrite: bool):
        self.path, self.shape, self.code, self.overwrite, self.job = path, shape, code, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = _open(self.path)
        width = int(np.prod(self.shape))
        most = max(1, FILE_BYTES // (8 * width))
        attempt, staged = uuid.uuid4().hex, []
        features: list[np.ndarray] = []
        labels: list[float] = []

        def put(kind: str, code: int, sizes: list[int], values: np.ndarray) -> None:
            dtype = np.dtype(TYPES[code])
            cast = values.astype(dtype)
            if dtype.kind != "f" and not np.array_equal(cast, values):
                raise ValueError(f"{kind} hold values that the type {dtype} can't")
            system.create_dir(f"{root}/{kind}", recursive=True)
            with system.open_output_stream(f"{root}/{kind}/_staged-{self.job}-{attempt}-{len(staged):05d}") as out:
                out.write(struct.pack(f">BBBB{len(sizes)}I", 0, 0, code, len(sizes), *sizes))
                out.write(cast.tobytes())

        def flush() -> None:
            if labels:
                put("images", self.code, [len(labels), *self.shape], np.stack(features))
                put("labels", 0x0C, [len(labels)], np.array(labels))
                staged.append(f"{attempt}-{len(staged):05d}")
                features.clear(), labels.clear()

        for row in rows:
            if row[0] is None or len(row[0]) != width or any(x is None for x in row[0]) or row[1] is None:
                raise ValueError(f"a row must hold {width} values and a label, none of them null")
            features.append(np.array(row[0], "f8"))
            labels.append(row[1])
            if len(labels) >= most:
                flush()
        flush()
        return _Written(staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Labels take their names first, so no image file is ever seen without its labels."""
        system, root = _open(self.path)
        for kind in ("labels", "images"):
            system.create_dir(f"{root}/{kind}", recursive=True)
            old = [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/{kind}")) if f.base_name.startswith("part-")] if self.overwrite else []
            for k, m in enumerate(messages):
                for i, name in enumerate(m.staged if m else []):
                    system.move(f"{root}/{kind}/_staged-{self.job}-{name}", f"{root}/{kind}/part-{self.job}-{k:05d}-{i:05d}.idx")
            for f in old:
                system.delete_file(f)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _open(self.path)
        for kind in ("images", "labels"):
            for f in system.get_file_info(fs.FileSelector(f"{root}/{kind}", allow_not_found=True)):
                if f.base_name.startswith(f"_staged-{self.job}-"):
                    system.delete_file(f.path)


class Idx(DataSource):
    """`spark.read.format("idx")` and `df.write.format("idx")`; see `read_idx` and `write_idx`."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return "file string, place long, features array<double>, label double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("labels"), int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], [int(x) for x in self.options["shape"].split(",")], int(self.options["code"]), overwrite)


def _register(spark: SparkSession) -> None:
    session.ship(spark)
    spark.dataSource.register(Idx)


def read_idx(spark: SparkSession, path: str, labels: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, place, features, label) of an IDX file or a folder of them; `place` is the row's number in its file, from 0.

    Files are cut into byte ranges, a task each, so one large file is read in parallel. `labels` is the file of their
    labels, or a folder with one of the same name for each; a task reads the labels of its own rows, so nothing is joined.
    Without it labels are null. A file without rows gives none; one whose size differs from its header's, labels of another number,
    and compressed files are errors. Values are as stored: pixels 0 to 255.
    """
    _register(spark)
    reader = spark.read.format("idx").option("rangeBytes", str(range_bytes))
    return (reader.option("labels", labels) if labels else reader).load(path)


def write_idx(df: DataFrame, path: str, shape: tuple[int, ...], features: str = "features", label: str = "label", code: int = 0x0E, overwrite: bool = False) -> None:
    """Write rows as IDX under `path`/images and `path`/labels, files of `FILE_BYTES` at most with equal names; appends unless `overwrite`.

    `shape` is a row's dimensions, `code` the element type of TYPES. A null vector or label, a null value, another
    length, and values or labels that their type (labels: int) can't hold are errors, and a job that fails leaves nothing that readers
    see (tasks that still run when it's aborted may leave staged files). Rows that repeat are written as often; other columns aren't written.
    """
    if code not in TYPES:
        raise ValueError(f"no IDX type: {code}")
    _register(df.sparkSession)
    rows = df.select(df[features].cast("array<double>").alias("features"), df[label].cast("double").alias("label"))
    rows.write.format("idx").mode("overwrite" if overwrite else "append").options(shape=",".join(map(str, shape)), code=str(code)).save(path)
