"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from noveltide.llm import chunks
from noveltide.llm.common import by_bytes, prepare, table


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = True) -> DataFrame:
    """Count every text's tokens as the library for `tokenizer` (a path) gives them.

    Only lengths leave the Python worker. Arrow batches are cut again by bytes,
    and a text is split at white space, where no token of these vocabularies
    crosses; `drops_space` says that the vocabulary ignores white space itself.

    Returns id, n_bytes, n_tokens, over_limit: one row per input row, repeated
    rows and null ids included. A null text counts as empty (0 bytes, 0 tokens).
    Other columns of `docs` are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = chunks.lengths_of(tokenizer, drops_space)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes = pc.binary_length(pc.fill_null(batch.column(1), "").cast(pa.binary())).to_pylist()
            lengths: list[int] = []
            for i, j in by_bytes(sizes):
                lengths += count(texts[i:j])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array([n > limit for n in lengths], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = narrow.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
