"""Removal of long byte strings that occur more than once, by merging shards' Burrows-Wheeler transforms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm import suffix_kernels as kernels
from noveltide.llm.common import fresh, prepare, table
from noveltide.session import discard, free_shuffles, materialize

#: Bytes of distinct strings that are transformed and merged at a time.
BATCH_BYTES = 4 << 20
#: Distinct strings that a task remembers having sent.
SENT = 300_000
#: Anchors with HOT different strings are hot: these are cut so that a key holds HOT_WINDOWS windows and one core each.
#: Cores with HOT different strings are hot too; their windows have keys of their own.
HOT = 2000
HOT_WINDOWS = 8
#: Hot keys go to all tasks as marks in 2**MARK_BITS bits, 8 MB of each kind whatever their number.
MARK_BITS = 26


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    x = keys.view("u8")
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Marked:
    """A set of 64-bit keys of fixed size: it holds each marked key, and may hold others, whose strings are then cut without need."""

    def __init__(self, bits: int, marks: bytes):
        self.bits, self.marks = bits, marks

    def __contains__(self, key: int) -> bool:
        x = key & (2**64 - 1)
        slot = ((x ^ (x >> 32)) * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> (64 - self.bits)
        return bool(self.marks[slot >> 3] >> (slot & 7) & 1)

    def __len__(self) -> int:
        return int.from_bytes(self.marks, "little").bit_count()


class Hot(NamedTuple):
    """Hot anchors and hot cores."""

    anchors: Marked
    cores: Marked


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", "u1") for x in column.cast(pa.binary()).to_pylist()]


def _pieces(text: bytes, ah: int, start: int, count: int, off: int, cores: set[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """A hot run as (key suffix, key hash, start, windows, anchor offset).

    It is cut where the anchor's distance passes a multiple of HOT_WINDOWS. The bytes that all windows
    of such a piece would share, whether the run has them all or not, are its core, and part its key. Pieces of hot cores are cut
    to single windows, whose bytes part their keys. Each cut depends on a window's own bytes, so equal windows meet.
    """
    at = 0
    while at < count:
        distance = off - at
        n = min(count - at, distance % HOT_WINDOWS + 1)
        low = distance - distance % HOT_WINDOWS
        anchor = start + off
        core = xxhash.xxh3_64_intdigest(text[anchor - low : anchor - low - HOT_WINDOWS + 1 + kernels.SPAN], seed=(ah ^ low) & (2**64 - 1)) - 2**63
        if core in cores:
            for k in range(at, at + n):
                window = text[start + k : start + k + kernels.SPAN]
                yield kernels.SPAN + off - k, xxhash.xxh3_64_intdigest(window) - 2**63, start + k, 1, off - k
        else:
            yield low // HOT_WINDOWS, core, start + at, n, distance
        at += n


def _contents(batch: pa.RecordBatch, hot: Hot) -> Iterator[tuple[int, int, int, int, int, int, bytes, bytes]]:
    """For each piece of each row: row number, anchor hash, key suffix, key hash, start, anchor offset, digest, bytes."""
    texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    for row, (text, runs) in enumerate(zip(texts, batch.column("runs").to_pylist(), strict=True)):
        for r in runs:
            ah, start, count, off = r["ah"], r["start"], r["count"], r["off"]
            pieces = _pieces(text, ah, start, count, off, hot.cores) if ah in hot.anchors else ((-1, 0, start, count, off),)
            for suffix, sub, s, n, o in pieces:
                content = text[s : s + n + kernels.SPAN - 1]
                yield row, ah, suffix, sub, s, o, xxhash.xxh3_128_digest(content), content


def _count_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(is_core, key, string): the different strings of frequent anchors and of their cores, as hashes, each once a batch."""
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        found: set[tuple[bool, int, int]] = set()
        for text, runs in zip(texts, batch.column("runs").to_pylist(), strict=True):
            for r in runs:
                if r["often"]:
                    ah, start, count, off = r["ah"], r["start"], r["count"], r["off"]
                    whole = (False, ah, xxhash.xxh3_64_intdigest(text[start : start + count + kernels.SPAN - 1]) - 2**63)
                    if whole not in found:
                        found.add(whole)
                        found.update((True, core, xxhash.xxh3_64_intdigest(text[s : s + n + kernels.SPAN - 1]) - 2**63) for _, core, s, n, _ in _pieces(text, ah, start, count, off, set()))
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["is_core", "key", "string"])


def _mark(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(batch.column("key").to_numpy(), bits)
            mark = (np.uint64(1) << (slot & np.uint64(63))).view("i8")
            yield pa.RecordBatch.from_arrays([batch.column("is_core"), pa.array((slot >> np.uint64(6)).astype("i4")), pa.array(mark)], names=["is_core", "word", "mark"])

    return run


def _marked(keys: DataFrame) -> Hot:
    """(is_core, key) as marks. Words of marks are made up by Spark, so the driver gets 2**(MARK_BITS - 6) words of each kind at most."""
    bits = MARK_BITS
    words = keys.select("is_core", "key").mapInArrow(_mark(bits), "is_core boolean, word int, mark long").groupBy("is_core", "word").agg(F.bit_or("mark").alias("marks")).toArrow()
    word, marks, is_core = (words.column(k).to_numpy() for k in ("word", "marks", "is_core"))
    out = []
    for kind in (False, True):
        all_words = np.zeros(max(1, 1 << (bits - 6)), "<i8")
        all_words[word[is_core == kind]] = marks[is_core == kind]
        out.append(Marked(bits, all_words.tobytes()))
    return Hot(*out)


def _hot(work: DataFrame) -> Hot:
    """Each anchor and each core with HOT different strings is marked, however many there are, so no key that isn't cut holds more."""
    counted = work.where(F.exists("runs", lambda r: r["often"])).select("text", "runs").mapInArrow(_count_hot, "is_core boolean, key long, string long")
    return _marked(counted.distinct().groupBy("is_core", "key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT))


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [kernels.runs(t) for t in _texts(batch.column("text"))]
        row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        start, count, off, ah = (np.concatenate([f[k] for f in found]) for k in range(4))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(row), batch.column("th").take(row), pa.array(ah.view("i8")), pa.array(start), pa.array(count.astype("i4")), pa.array(off.astype("i4"))],
            names=["id", "th", "ah", "start", "count", "off"],
        )


def _send_strings(hot: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            rows: dict[tuple, list] = {}
            for _, ah, suffix, sub, _, off, digest, content in _contents(batch, hot.value):
                if digest in rows:
                    rows[digest][6] += 1
                else:
                    rows[digest] = [ah, suffix, sub, digest, off, None if digest in sent else content, 1]
            if len(sent) > SENT:
                sent.clear()
            sent.update(rows)
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows.values(), strict=True), kinds, strict=True)], names=["ah", "suffix", "sub", "digest", "off", "content", "n"])

    return run


def _intervals(marks: np.ndarray) -> list[dict[str, int]]:
    """Covered bytes of marked windows as [start, end) intervals, those that touch joined."""
    at = np.flatnonzero(marks)
    cut = np.flatnonzero(np.diff(at) > kernels.SPAN)
    return [{"s": int(at[a]), "e": int(at[b]) + kernels.SPAN} for a, b in zip(np.r_[0, cut + 1], np.r_[cut, len(at) - 1], strict=True)]


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are gathered up to BATCH_BYTES, merged, and let go."""

    def solve(strings: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        digests = list(strings)
        marks = kernels.repeated_windows([strings[d][0] for d in digests], np.array([strings[d][1] for d in digests], "i8"), np.array([strings[d][2] for d in digests], "f8"))
        found = [(d, _intervals(m)) for d, m in zip(digests, marks, strict=True) if m.any()]
        if found:
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([i for _, i in found], kind)], names=["digest", "ivs"])

    strings: dict[bytes, list] = {}
    size, last = 0, None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(7)]
        for ah, suffix, sub, digest, off, content, n in zip(*columns, strict=True):
            if (ah, suffix, sub) != last:
                last = (ah, suffix, sub)
                if size > BATCH_BYTES:
                    yield from solve(strings)
                    strings, size = {}, 0
            entry = strings.setdefault(digest, [None, off, 0])
            entry[2] += n
            if content is not None and entry[0] is None:
                entry[0] = content
                size += len(content)
    if strings:
        yield from solve(strings)


def _place(hot: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row, digest, start) for row, _, _, _, start, _, digest, _ in _contents(batch, hot.value)]
            if rows:
                row, digest, start = zip(*rows, strict=True)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("th").take(take), pa.array(digest, pa.binary()), pa.array(start, pa.int64())], names=["id", "th", "digest", "start"])

    return run


def _joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each row's intervals (starts of strings, and intervals in them), those that overlap or touch joined, in order."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for lists in batches:
        flat = lists.flatten()
        inner = flat.field(1)
        many = np.diff(inner.offsets.to_numpy())
        shift = np.repeat(flat.field(0).to_numpy(), many)
        s, e = (inner.flatten().field(k).to_numpy() + shift for k in (0, 1))
        edge = np.r_[0, np.cumsum(many)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = []
        for a, b in pairwise(edge.tolist()):
            order = np.argsort(s[a:b], kind="stable")
            start, end = s[a:b][order], np.maximum.accumulate(e[a:b][order])
            new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
            out.append([{"s": x, "e": y} for x, y in zip(start[new].tolist(), end[np.r_[new[1:] - 1, b - a - 1]].tolist(), strict=True)])
        yield pa.array(out, kind)


_joined.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes of each text that a string of 200 bytes covers which starts anywhere else too: (id, th, spans).

    th is xxhash64 of the text; spans are disjoint, not touching, [start, end), in order; rows without any are left out.

    1. Each window of 200 bytes has an anchor, found from its bytes alone; runs
       of windows with one anchor are strings of 290 bytes on average. Anchors are counted, and
       only runs whose anchor occurs twice or more go on.
    2. Equal runs count as one string with a weight. Strings are dealt by anchor,
       so equal windows meet in one task, which transforms shards of strings,
       merges the transforms and marks windows of classes of weight two or more (suffix_kernels).
       Strings of hot anchors are cut finer and dealt by the bytes that their windows share, those of hot
       bytes by whole windows, so no task gets all contexts of a common passage.
    3. Marks go back to all places of their string.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    every = materialize(base.mapInArrow(_find_runs, f"id {kind}, th long, ah long, start long, count int, off int"), "runs")
    anchors = materialize(every.groupBy("ah").agg(F.count("*").alias("n")).where("n > 1").select("ah", (F.col("n") >= HOT).alias("often")), "anchors")
    runs = every.join(anchors.hint("merge"), "ah")
    runs = runs.groupBy(F.col("id").alias("rid"), F.col("th").alias("rth")).agg(F.collect_set(F.struct("start", "count", "off", "ah", "often")).alias("runs"))
    runs = materialize(runs, "repeated-runs")
    discard(every)
    free_shuffles(spark)
    same = lambda a, b: a["id"].eqNullSafe(b["rid"]) & (a["th"] == b["rth"])
    work = materialize(base.join(runs.hint("merge"), same(base, runs)).drop("rid", "rth"), "candidates")
    discard(runs)
    free_shuffles(spark)

    hot = spark.sparkContext.broadcast(_hot(work))
    strings = work.select("text", "runs").mapInArrow(_send_strings(hot), "ah long, suffix int, sub long, digest binary, off int, content binary, n long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = strings.repartition(parts, "ah", "suffix", "sub").sortWithinPartitions("ah", "suffix", "sub")
    marks = materialize(dealt.mapInArrow(_merge_shards, "digest binary, ivs array<struct<s:int,e:int>>"), "marks")
    free_shuffles(spark)

    placed = work.select("id", "th", "text", "runs").mapInArrow(_place(hot), f"id {kind}, th long, digest binary, start long")
    found = placed.join(marks.hint("merge"), "digest").groupBy("id", "th").agg(F.collect_set(F.struct("start", "ivs")).alias("all"))
    joined = F.arrow_udf(_joined, "array<struct<s:bigint,e:bigint>>")(F.col("all"))
    return materialize(found.select("id", "th", joined.alias("spans")), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `spans` (see repeated_spans; empty if none) and `kept`, the text's other bytes in order (binary).

    Repeated rows repeat each other's text, so what is long enough goes from all of
    them. A null text is empty. Columns named spans or kept are replaced; kept
    may break a character, as strings are judged by bytes.
    """
    id_, th, spans_ = fresh(docs, "id", "th", "spans")
    spans = repeated_spans(docs, id_col, text_col).select(F.col("id").alias(id_), F.col("th").alias(th), F.col("spans").alias(spans_))
    free_shuffles(docs.sparkSession)

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for text, cuts in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
                edges = [0, *(x for c in cuts for x in (c["s"], c["e"])), len(text)]
                out.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.array(out, pa.binary())

    cut.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    joined = docs.join(spans.hint("merge"), docs[id_col].eqNullSafe(spans[id_]) & (F.xxhash64(docs[text_col]) == spans[th]), "left")
    joined = joined.withColumn("spans", F.coalesce(spans_, F.array().cast("array<struct<s:bigint,e:bigint>>"))).drop(id_, th, spans_)
    return joined.withColumn("kept", F.arrow_udf(cut, "binary")(raw, F.col("spans")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
