"""Removal of lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import barrier, fresh, prepare, table
from noveltide.session import materialize

SPACE = " \t\n\v\f\r"


def line_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, line number and 128-bit key (as 16 bytes) of all lines; lines with empty keys are left out."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = pc.ascii_lower(pc.ascii_trim(lines.flatten(), SPACE))
    counts = np.diff(lines.offsets.to_numpy())
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    digest = xxhash.xxh3_128_digest
    keys = np.frombuffer(b"".join(digest(x) for x in flat.filter(pa.array(full)).cast(pa.binary()).to_pylist()), "V16")
    return row[full], pos[full], keys


def drop_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key occurs in `min_docs` rows or more.

    A key is the line without the white space `[\\x20\\x09-\\x0D]` at both ends and
    with A-Z in lower case; empty keys never count. Keys travel as 128-bit
    hashes. A batch first counts its own rows per key, Spark sums these counts,
    so a line of a third of all rows is one summed row per task.

    Returns the columns of `docs` with the text replaced, then `n_lines` and
    `n_dropped` (columns of those names in `docs` are replaced). Each row is a
    document of its own, also when rows or ids repeat; a null text is one empty
    line and stays null. Documents that lose all lines stay, with an empty text.
    """
    spark = docs.sparkSession
    prepare(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, keys = line_keys(batch.column(0))
            if not len(keys):
                continue
            pairs = np.frombuffer(keys.tobytes(), "<i8").reshape(-1, 2)
            seen = np.unique(np.column_stack([pairs, row]), axis=0) if len(row) else pairs
            first = np.flatnonzero(np.r_[True, (seen[1:, :2] != seen[:-1, :2]).any(axis=1)])
            n = np.diff(np.r_[first, len(seen)])
            yield pa.RecordBatch.from_arrays([pa.array(seen[first, 0]), pa.array(seen[first, 1]), pa.array(n.astype("i8"))], names=["h1", "h2", "n"])

    narrow = docs.select(docs[text_col].alias("text"))
    counted = narrow.mapInArrow(count, "h1 long, h2 long, n long")
    common = materialize(counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"), "common-lines")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, keys = line_keys(batch.column(1))
            if not len(keys):
                continue
            pairs = np.frombuffer(keys.tobytes(), "<i8").reshape(-1, 2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(pos.astype("i4")), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                names=["id", "th", "pos", "h1", "h2"],
            )

    kind = dict(docs.dtypes)[id_col]
    keyed = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("th"))
    placed = keyed.mapInArrow(place, f"id {kind}, th long, pos int, h1 long, h2 long")
    hits = placed.join(common, ["h1", "h2"], "left_semi")
    id_, th, drop_, lines_ = fresh(docs, "id", "th", "drop", "lines")
    dropped = hits.groupBy(F.col("id").alias(id_), F.col("th").alias(th)).agg(F.collect_set("pos").alias(drop_))
    dropped = materialize(dropped, "dropped-lines")

    text, drop, lines = F.col(text_col), F.col(drop_), F.col(lines_)
    joined = docs.join(dropped.hint("merge"), docs[id_col].eqNullSafe(dropped[id_]) & (F.xxhash64(docs[text_col]) == dropped[th]), "left")
    joined = barrier(joined, **{lines_: F.when(drop.isNotNull(), F.split(text, "\n", -1))})
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    kept = F.when(drop.isNull(), text).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    out = joined.withColumns({"n_lines": n_lines, "n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("long"), text_col: kept})
    return out.drop(id_, th, drop_, lines_)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_common_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLES = {
    "op6_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, i, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE key IN (SELECT key FROM common))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""
}
