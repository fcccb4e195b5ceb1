"""Packing of token sequences by estimated attention cost."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm import chunks
from noveltide.llm.common import by_bytes, prepare, table
from noveltide.session import materialize

SEQUENCE = 2048
#: A document's last, incomplete piece is cut again at these lengths, which leaves little padding.
CUTS = (1024, 512)
#: Pieces that are packed together; groups are dealt by a hash, so they hold no one document's or source's pieces.
GROUP_PIECES = 2000
#: Groups that a task packs one after the other, and how many times GROUP_PIECES it holds at once at most.
TASK_GROUPS, MOST_TIMES = 256, 4
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, a layer's matrix products and its attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def cut_points(n: int, sequence: int = SEQUENCE, cuts: tuple[int, ...] = CUTS) -> list[int]:
    """Where the pieces of n ids start, and n: whole sequences, then at most one piece of each length in `cuts`, then the rest."""
    points = list(range(0, n - n % sequence + 1, sequence))
    for c in cuts:
        if n - points[-1] >= c:
            points.append(points[-1] + c)
    return points if points[-1] == n else [*points, n]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ids with `end_id` after them, cut at `cut_points`: id, start, length, ids_crc32, doc_tokens.

    Ids are those of the library for the byte-level vocabulary at the path
    `tokenizer`. A null text counts as empty and has the end id alone. Repeated rows have pieces of their own.
    Null ids stay null. Other columns of `docs` are ignored, whatever their names.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunks.ids_of(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            row, start, length, crc, total = [], [], [], [], []
            sizes = pc.binary_length(pc.fill_null(batch.column(1), "").cast(pa.binary())).to_pylist()
            for i, j in by_bytes(sizes):
                for k, ids in enumerate(encode(texts[i:j]), i):
                    ids = np.concatenate([ids, end])
                    points = cut_points(len(ids), sequence)
                    for s, e in pairwise(points):
                        piece = ids[s:e]
                        row.append(k)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def assign(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """A sequence number and an offset for each piece; `lengths` must descend.

    As many sequences are open as the tokens fill at least. Each piece goes to the
    sequence of the lowest cost among those with room for it, the lower number
    on a tie, and opens a new one if there is none. A sequence that is too full waits
    until lengths have come down to what it has left.
    """
    room = [sequence] * max(1, -(-int(lengths.sum()) // sequence))
    cost = [(0.0, k) for k in range(len(room))]
    waiting: list[list[tuple[float, int]]] = [[] for _ in range(sequence + 1)]
    level = sequence
    where, offset = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    for i, n in enumerate(lengths.tolist()):
        while level > n:
            level -= 1
            for entry in waiting[level]:
                heapq.heappush(cost, entry)
            waiting[level] = []
        while cost and room[cost[0][1]] < n:
            entry = heapq.heappop(cost)
            waiting[room[entry[1]]].append(entry)
        if cost:
            c, k = heapq.heappop(cost)
        else:
            c, k = 0.0, len(room)
            room.append(sequence)
        where[i], offset[i] = k, sequence - room[k]
        room[k] -= n
        heapq.heappush(cost, (c + LINEAR * n + QUADRATIC * n * n, k))
    return where, offset


def pack(pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces (id, start, length, ids_crc32, doc_tokens; other columns go).

    Pieces are dealt to groups of about `group_pieces` by a hash of id, start and
    digest, and each group packs its own in descending length (ties by id, start, digest). Spark sorts
    them, so a task holds one group at a time, and of one that pieces alike in all three have made
    larger, `MOST_TIMES` as many pieces. Sequence numbers are unique over groups.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    parallel = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(groups, parallel), -(-groups // TASK_GROUPS))
    kinds = dict(pieces.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current, used = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used
            if held:
                rows = pa.Table.from_batches(held)
                where, offset = assign(rows["length"].to_numpy(), sequence)
                rows = rows.drop_columns(["grp"]).append_column("sequence_id", pa.array((current << 32) + used + where)).append_column("offset", pa.array(offset))
                used += int(where.max()) + 1
                held.clear()
                yield from rows.combine_chunks().to_batches()

        for batch in batches:
            group = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(0, "i8")
            for a, b in pairwise(cuts.tolist()):
                if group[a] != current:
                    yield from flush()
                    current, used = int(group[a]), 0
                for k in range(a, b, group_pieces):
                    held.append(batch.slice(k, min(group_pieces, b - k)))
                    if sum(x.num_rows for x in held) >= MOST_TIMES * group_pieces:
                        yield from flush()
        yield from flush()

    dealt = pieces.select(F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(groups)).alias("grp"), "id", "start", "length", "ids_crc32", "doc_tokens")
    dealt = dealt.repartition(tasks, "grp").sortWithinPartitions("grp", F.desc("length"), "id", "start", "ids_crc32")
    return dealt.mapInArrow(run, f"id {kinds['id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All of `docs` as packed pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; see `token_pieces` and `pack`. An empty table has none."""
    pieces = materialize(token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces).withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
