"""Exact Jaccard self-join of documents' word shingles, and its components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import by_bytes, fresh, prepare, table
from noveltide.llm.components import connected_components
from noveltide.llm.shingle_sets import shingles
from noveltide.session import free_shuffles, materialize

#: Counts of shingles by the low bits of their hash put rare ones first; a table of fixed size, whatever the input.
COUNTERS = 1 << 18
SLICE = 1 << 12
#: Cells of a set's sketch: how many of its shingles fall on each, modulo 256. Cells differ by no more than sets do.
CELLS = 32
#: Shingles a cell of the finer sketch by which sets of a group are compared before they are sent, and its most cells.
FINE, MOST_CELLS = 16, 4096
#: Larger groups aren't compared by sketches.
COMPARED = 4096
#: Texts to be sent are marked in 2**MARK_BITS bits, whatever their number.
MARK_BITS = 26
#: Bytes of an entry of an index list: shingle, set, size, position, sketch.
ENTRY = 8 + 16 + 4 + 4 + CELLS
#: Entries of the buckets that index lists are dealt to, about, and entries that a task gathers before it sends them.
BUCKET, GATHERED = 250_000, 250_000
#: Longer index lists aren't filtered in one task; all their sets go on.
LONG_LIST = 20_000
#: Sets of a group that one task compares with each other; larger groups are cut into blocks of half as many.
GROUP = 512
#: Bytes of sets that are sent at once.
SENT_BYTES = 1 << 24


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted shingle hashes) of each text."""
    texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    for i, j in by_bytes([len(t) for t in texts], 1 << 21):
        row, found = shingles(texts[i:j], n)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            yield i + k, found[bounds[k] : bounds[k + 1]]


def prefix_length(size: int, percent: int) -> int:
    """Two sets that link share one of their first so many shingles, in any common order of shingles."""
    return size - -(-percent * size // 100) + 1


def _least_overlap(x: np.ndarray | int, y: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of linked sets of x and y shingles."""
    return -(-percent * (x + y) // (100 + percent))


def _counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many (text, shingle) pairs fall on each of COUNTERS counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, "i8")
        for batch in batches:
            for _, s in _sets(batch.column(0), n):
                np.add.at(total, (s & np.uint64(COUNTERS - 1)).astype("i8"), 1)
        parts = np.minimum(total, 2**31 - 1).astype("<i4").reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype="i4")), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, "<i4").astype("i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype("<i4").tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    counted = docs.select("text").mapInArrow(count, "part int, counts binary").repartition(16, "part").mapInArrow(add, "part int, counts binary")
    table = np.zeros((COUNTERS // SLICE, SLICE), "i4")
    for r in counted.collect():  # COUNTERS numbers, whatever the input
        table[r.part] = np.frombuffer(r.counts, "<i4")
    return table.ravel()


def _pairs(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with first[i] <= j < end[i]."""
    n = np.maximum(end - first, 0)
    i = np.repeat(np.arange(len(first)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def linkable(lists: np.ndarray, size: np.ndarray, pos: np.ndarray, sketch: np.ndarray, percent: int, tally: dict[str, int] | None = None) -> np.ndarray:
    """Of the entries of index lists, those that some other entry of their list may link with.

    Entries of a list that have one size and one position are a block. Two blocks
    whose sizes differ too much, or whose positions leave too few
    shingles to come, are skipped with all their entries; in the blocks that are left, pairs whose sketches differ by more
    than linked sets can are skipped. `tally` counts pairs of entries, pairs left by the blocks, and pairs left by the sketches.
    """
    able = np.zeros(len(lists), bool)
    if not len(lists):
        return able
    order = np.lexsort((pos, size, lists))
    l, s, p = lists[order], size[order].astype("i8"), pos[order].astype("i8")
    new = np.flatnonzero(np.r_[True, (l[1:] != l[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1])])
    edge = np.r_[new, len(l)]
    bl, bs, bp, many = l[new], s[new], p[new], np.diff(edge)
    # Blocks ascend by list and size, so a block's partners follow it up to the largest size that can link.
    rank = np.unique(bl, return_inverse=True)[1].astype("i8")
    top = int(bs.max()) * 100 // percent + 2
    reach = np.searchsorted(rank * top + bs, rank * top + np.minimum(bs * 100 // percent, top - 1), side="right")
    pairs_before = np.cumsum(reach - np.arange(len(bs)))
    a = 0
    while a < len(bs):
        # As many blocks as have a million partners together, one at least.
        z = max(a + 1, int(np.searchsorted(pairs_before, (pairs_before[a - 1] if a else 0) + 1_000_000, side="right")))
        i, j = _pairs(np.arange(a, min(z, len(bs))), reach[a:z])
        i, a = i + a, z
        most = 1 + np.minimum(bs[i] - bp[i] - 1, bs[j] - bp[j] - 1)
        near = (most >= _least_overlap(bs[i], bs[j], percent)) & ((i != j) | (many[i] > 1))
        i, j = i[near], j[near]
        # Entries of the first block, a bounded number of pairs at a time.
        x, own = _pairs(edge[i], edge[i + 1])
        step = max(1, 400_000 // max(1, int(many[j].max(initial=1))))
        for c in range(0, len(x), step):
            at, left = x[c : c + step], own[c : c + step]
            k, right = _pairs(edge[j[at]], edge[j[at] + 1])
            left = left[k]
            once = left < right
            left, right = left[once], right[once]
            least = _least_overlap(s[left], s[right], percent)
            # Cells count modulo 256, so their distance is the shorter way round.
            apart = (sketch[order[left]].astype("u1") - sketch[order[right]].astype("u1")).view("i1").astype("i4")
            ok = np.abs(apart).sum(1) <= s[left] + s[right] - 2 * least
            able[order[left[ok]]] = True
            able[order[right[ok]]] = True
            if tally is not None:
                tally["blocks_left"] = tally.get("blocks_left", 0) + len(left)
                tally["sketches_left"] = tally.get("sketches_left", 0) + int(ok.sum())
    if tally is not None:
        n = np.unique(lists, return_counts=True)[1]
        tally["pairs"] = tally.get("pairs", 0) + int((n * (n - 1) // 2).sum())
    return able


def _pack(token: np.ndarray, sid: np.ndarray, size: np.ndarray, pos: np.ndarray, sketch: np.ndarray) -> bytes:
    """Entries of index lists, column by column, sizes and positions by their bytes, compressed."""
    planes = [np.ascontiguousarray(c, "<u4").view("u1").reshape(-1, 4).T.tobytes() for c in (size, pos)]
    return len(token).to_bytes(4, "little") + pa.Codec("zstd").compress(b"".join([token.astype("<u8").tobytes(), sid.tobytes(), *planes, sketch.tobytes()]), asbytes=True)


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(raw[:4], "little")
    flat = np.frombuffer(pa.Codec("zstd").decompress(raw[4:], n * ENTRY, asbytes=True), "u1")
    token, sid, size, pos, sketch = np.split(flat, np.cumsum([8, 16, 4, 4]) * n)
    size, pos = (np.ascontiguousarray(c.reshape(4, n).T).view("<u4").ravel().astype("i8") for c in (size, pos))
    return token.view("<u8"), sid.view(">u8").reshape(n, 2), size, pos, sketch.reshape(n, CELLS)


def _filter_lists(percent: int, most_held: int = 1_000_000):
    """Rows (bucket, entries) come sorted by bucket: of each list the entries that may link, under the smallest of them.

    A bucket's lists are filtered together. Where a bucket holds over `most_held` entries, its lists of over `LONG_LIST` are sent on whole as they come.
    """

    def distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
        """One entry for each set of a list, in the order of lists and sets; tasks may have sent a set more than once."""
        token, sid = columns[:2]
        order = np.lexsort((sid[:, 1], sid[:, 0], token))
        t, d = token[order], sid[order]
        order = order[np.r_[True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]).any(1)]]
        return [c[order] for c in columns]

    def rows(leader: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.column_stack([leader, sid]), axis=0).astype(">u8")
        flat = pairs.tobytes()
        both = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), 2 * len(pairs), [None, pa.py_buffer(flat)]).cast(pa.binary()).take(pa.array(np.arange(k, 2 * len(pairs), 2))) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(both, names=["leader", "sid"])

    def led(token: np.ndarray, sid: np.ndarray, leaders: dict[int, np.ndarray]) -> pa.RecordBatch:
        """Entries in the order of their lists and sets: each list under its known leader, or else under its first set."""
        new = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        first = np.array([leaders.get(t, sid[k]) for t, k in zip(token[new].tolist(), new.tolist(), strict=True)])
        return rows(np.repeat(first, np.diff(np.r_[new, len(token)]), axis=0), sid)

    def send_long(columns: list[np.ndarray], leaders: dict[int, np.ndarray]) -> tuple[list[np.ndarray], list[pa.RecordBatch]]:
        """Entries that stay, and those of long lists, whose leaders are noted."""
        columns = distinct(columns)
        token, sid = columns[:2]
        new = np.r_[True, token[1:] != token[:-1]]
        many = np.diff(np.r_[np.flatnonzero(new), len(token)])
        for k in np.flatnonzero(new)[many > LONG_LIST].tolist():
            leaders.setdefault(int(token[k]), sid[k])
        long = np.isin(token, np.array(list(leaders), "u8"))
        return [c[~long] for c in columns], [led(token[long], sid[long], leaders)] if long.any() else []

    def solve(parts: list[tuple[np.ndarray, ...]], leaders: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns, out = send_long([np.concatenate(c) for c in zip(*parts, strict=True)], leaders)
        yield from out
        token, sid, size, pos, sketch = columns
        kept = linkable(token, size, pos, sketch, percent)
        # Entries are in the order of their sets' names within a list, so a list's first is its leader.
        if kept.any():
            yield led(token[kept], sid[kept], {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, most, leaders = None, [], 0, most_held, {}
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    if held:
                        yield from solve(held, leaders)
                    now, held, size, most, leaders = bucket, [], 0, most_held, {}
                held.append(_unpack(raw.as_py()))
                size += len(held[-1][0])
                if size > most:
                    left, out = send_long([np.concatenate(c) for c in zip(*held, strict=True)], leaders)
                    yield from out
                    held, size = [tuple(left)], len(left[0])
                    most = most_held + 2 * size
        if held:
            yield from solve(held, leaders)

    return run


def fine_sketch(s: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall on each of its cells, modulo 256: at least one cell for `FINE` shingles, a power of two.

    With a fixed number of cells, sets of thousands of shingles that have nothing in common would look alike.
    """
    bits = min(MOST_CELLS, max(CELLS, -(-len(s) // FINE)))
    bits = (bits - 1).bit_length()
    return np.bincount((s >> np.uint64(64 - bits)).astype("i8"), minlength=1 << bits).astype("u1")


def sketch_components(size: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of the first set of its component, where sets are joined whose sizes and finer sketches leave it open that they link."""
    label = np.arange(len(size))
    order = np.argsort(size, kind="stable")
    s = size[order].astype("i8")
    width = np.array([len(sketches[k]) for k in order.tolist()])
    # Larger sets have no fewer cells; of these, adjacent ones are added up to the smaller set's.
    for cells in np.unique(width).tolist():
        at = np.flatnonzero(width == cells)
        first, end = int(at[0]), int(np.searchsorted(s, s[at[-1]] * 100 // percent, side="right"))
        folded = np.stack([sketches[k].reshape(cells, -1).sum(1, dtype="u1") for k in order[first:end].tolist()])
        for i in at.tolist():
            z = int(np.searchsorted(s, s[i] * 100 // percent, side="right"))
            apart = np.abs((folded[i + 1 - first : z - first] - folded[i - first]).view("i1").astype("i2")).sum(1, dtype="i8")
            near = order[i + 1 : z][apart <= s[i] + s[i + 1 : z] - 2 * _least_overlap(s[i], s[i + 1 : z], percent)]
            joined = np.unique(label[np.r_[order[i], near]])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return label


def _filter_groups(percent: int):
    """Rows (leader, sid, n_shingles, sketch) come sorted by leader: of each group the sets that their finer sketches let link, each component of these under its smallest.

    Groups of over `COMPARED` sets are sent on whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, whole = None, [], False
        out: tuple[list, list] = ([], [])

        def solve() -> None:
            if whole:
                out[0].extend([now] * len(held))
                out[1].extend(h[0] for h in held)
            elif len(held) > 1:
                held.sort(key=lambda h: h[0])
                label = sketch_components(np.array([h[1] for h in held]), [np.frombuffer(h[2], "u1") for h in held], percent)
                several = np.bincount(label, minlength=len(held))[label] > 1
                out[0].extend(held[k][0] for k in label[several].tolist())
                out[1].extend(held[k][0] for k in np.flatnonzero(several).tolist())
            held.clear()

        def send() -> Iterator[pa.RecordBatch]:
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], names=["leader", "sid"])
                for c in out:
                    c.clear()

        for batch in batches:
            for leader, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if leader != now:
                    solve()
                    now, whole = leader, False
                held.append(row)
                if len(held) > COMPARED:
                    whole = True
                    solve()
            yield from send()
        solve()
        yield from send()

    return run


def link_components(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None, tally: dict[str, int] | None = None) -> np.ndarray:
    """For each set the number of the first set in its component of links; `sides` restricts links to sets of unequal sides.

    A set's answers are its overlaps with all others. The first set's come from the
    index lists of its shingles. Any later set takes the answers of the most similar set that has some: an overlap differs from that
    set's by no more than the shingles that only one of the two holds. Where this
    decides every link that could join two components, the set needs no lists at
    all; else its answers are that set's, less the lists of the shingles it lacks, plus the
    lists of those it has besides. `tally` counts sets answered from lists, derived, and decided by bounds.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], "i8")
    if n == 2:
        mine = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if 100 * mine >= percent * (sizes.sum() - mine) and (sides is None or sides[0] != sides[1]) else 1])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.r_[0, np.cumsum(sizes)]
    holder = np.repeat(np.arange(n, dtype="i4"), sizes)[np.argsort(column, kind="stable")]
    lists = np.r_[0, np.cumsum(np.bincount(column))]
    held = np.zeros(len(lists) - 1, bool)

    def count(shingles: np.ndarray) -> np.ndarray:
        _, at = _pairs(lists[shingles], lists[shingles + 1])
        return np.bincount(holder[at], minlength=n).astype("i4")

    def others(i: int) -> np.ndarray:
        return np.ones(n, bool) if sides is None else sides != sides[i]

    answers: dict[int, np.ndarray] = {}
    answered = np.zeros(n, bool)
    label = np.arange(n)
    nearest, similar = np.full(n, -1), np.zeros(n)
    done = {"listed": 0, "derived": 0, "bounded": 0}
    for i in range(n):
        own = column[edge[i] : edge[i + 1]]
        r = int(nearest[i])
        if r >= 0:
            known = answers[r]
            lacks, besides = int(sizes[r] - known[i]), int(sizes[i] - known[i])
            most = np.minimum(known + besides, np.minimum(sizes, sizes[i]))
            undecided = (100 * most >= percent * (sizes + sizes[i] - most)) & (label != label[i]) & ~answered & others(i)
            if not undecided.any():
                done["bounded"] += 1
                continue
        if r >= 0 and lacks + besides < sizes[i]:
            base = column[edge[r] : edge[r + 1]]
            held[own] = True
            lost = base[~held[base]]
            held[own] = False
            held[base] = True
            gained = own[~held[own]]
            held[base] = False
            mine = known - count(lost) + count(gained)
            done["derived"] += 1
        else:
            mine = count(own)
            done["listed"] += 1
        answered[i] = True
        union = sizes + sizes[i] - mine
        linked = (100 * mine >= percent * union) & others(i)
        linked[i] = True
        if len(joined := np.unique(label[linked])) > 1:
            label[np.isin(label, joined)] = joined[0]
        share = mine / union
        closer = share > np.maximum(similar, 0.5)
        closer[: i + 1] = False
        if closer.any():
            answers[i] = mine
            nearest[closer], similar[closer] = i, share[closer]
        if len(answers) > 256:
            answers = {k: v for k, v in answers.items() if k in set(nearest[i + 1 :].tolist())}
    if tally is not None:
        for k, v in done.items():
            tally[k] = tally.get(k, 0) + v
    return label


def _join_blocks(percent: int, across: bool):
    """Links within blocks: rows (leader, block, side, sid, hashes) come sorted by leader and block.

    Yields a block's spanning links (a, b). With `across`, only sets of unequal sides are compared; without it,
    the sets of a cut group (side 1) that aren't in its leader's component are given too, as (leader, block, free).
    """
    names = ["a", "b", "leader", "block", "free"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members = None, {}
        out: list[list] = [[] for _ in names]

        def flush() -> None:
            if len(members) > 1:
                ids = sorted(members)
                sides = np.array([members[s][0] for s in ids])
                label = link_components([members[s][1] for s in ids], percent, sides if across else None)
                home = label[ids.index(last[0])] if not across and sides.any() else -1
                for k, first in enumerate(label.tolist()):
                    if first != k:
                        for c, v in zip(out, (ids[first], ids[k], None, None, None), strict=True):
                            c.append(v)
                    if home >= 0 and first != home:
                        for c, v in zip(out, (None, None, *last, ids[k]), strict=True):
                            c.append(v)
            members.clear()

        def send() -> Iterator[pa.RecordBatch]:
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                for c in out:
                    c.clear()

        for batch in batches:
            for leader, block, side, sid, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (leader, block) != last:
                    flush()
                    last = (leader, block)
                members[sid] = (side, np.frombuffer(raw, "<u8"))
            yield from send()
        flush()
        yield from send()

    return run


def _placed(*columns: list) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["leader", "block", "side", "sid", "hashes"])


def similar_documents(docs: DataFrame, percent: int = 90, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of `percent` / 100 or more: id, th, n_shingles, component_id.

    1. Texts with equal sets are one set from here on, named by a 128-bit digest.
    2. Every set's rarest shingles, as many as two linked sets must share one of,
       make index lists, which go once, packed, to the tasks of their buckets, in blocks of one size and position; blocks that can't link are skipped whole (`linkable`).
    3. All sets left of a list form a group under its smallest set, so any two sets
       that can link meet in a group. Sketches that grow with the sets part each group into those that may link (`sketch_components`). A task gets a group's sets, each once, and derives a set's
       answers from those of the most similar one (`link_components`). It returns each component's spanning links.
       Groups of over `GROUP` sets are cut into blocks that each get the leader too. Sets of different blocks that are
       in the leader's component need no comparison; only the other ones are sent to all blocks.
    4. Labels spread over the links of all groups.

    th is xxhash64 of the text. component_id is the smallest id reachable; a text without words has no
    shingles and its own id. Each input row has a row; rows with null ids link
    like others, but component_id counts ids that aren't null only. Other columns of `docs` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    found = _counts(base, n)
    total = int(found.astype("i8").sum())
    counts = spark.sparkContext.broadcast(found)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), xxhash.xxh3_128_digest(s) if len(s) else None, fine_sketch(s).tobytes() if len(s) else None) for _, s in _sets(batch.column("text"), n)]
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), *(pa.array([f[k] for f in found], kinds[k]) for k in range(3))], names=["id", "th", "n_shingles", "sid", "sketch"])

    buckets = max(1, int(total * (100 - percent) // 100 // BUCKET))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        freq = counts.value
        held: list[tuple] = []
        size = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            times = np.array([len(h[0]) for h in held])
            columns = [np.concatenate([h[0] for h in held]), np.repeat(np.frombuffer(b"".join(h[1] for h in held), "u1").reshape(-1, 16), times, axis=0), np.repeat([h[2] for h in held], times), np.concatenate([np.arange(k) for k in times]), np.repeat(np.array([h[3] for h in held]), times, axis=0)]
            # The low bits of rare shingles are those of rare counters, so buckets go by higher ones.
            bucket = ((columns[0] >> np.uint64(20)) % np.uint64(buckets)).astype("i4")
            order = np.argsort(bucket, kind="stable")
            new = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[new]]), pa.array([_pack(*(c[at] for c in columns)) for at in np.split(order, new[1:])], pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for _, s in _sets(batch.column(0), n):
                if not len(s) or (sid := xxhash.xxh3_128_digest(s)) in sent:
                    continue
                if len(sent) > 500_000:
                    sent.clear()
                sent.add(sid)
                first = s[np.argsort(freq[(s & np.uint64(COUNTERS - 1)).astype("i8")], kind="stable")[: prefix_length(len(s), percent)]]
                held.append((first, sid, len(s), np.bincount((s >> np.uint64(59)).astype("i8"), minlength=CELLS).astype("u1")))
                size += len(first)
                if size > GATHERED:
                    yield from dealt()
                    held, size = [], 0
        if held:
            yield from dealt()

    rows = materialize(base.mapInArrow(digests, f"id {kind}, th long, n_shingles long, sid binary, sketch binary"), "shingle-sets")
    free_shuffles(spark)
    dealt = base.select("text").mapInArrow(entries, "bucket int, entries binary").repartition("bucket").sortWithinPartitions("bucket")
    members = materialize(dealt.mapInArrow(_filter_lists(percent), "leader binary, sid binary").distinct(), "members")
    free_shuffles(spark)
    named = rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct("id", "th")).alias("k"), F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    named = materialize(named, "named-sets")
    # Large sets share some rare shingle with many others that are nothing like them; these pairs grow faster than the input and go no further.
    sketched = members.join(named.select("sid", "n_shingles", "sketch"), "sid").select("leader", "sid", "n_shingles", "sketch").repartition("leader").sortWithinPartitions("leader")
    members = materialize(sketched.mapInArrow(_filter_groups(percent), "leader binary, sid binary").distinct(), "members")
    # A group whose leader is in a group of a smaller leader joins that one, so that a set is placed less often.
    over = materialize(members.groupBy("sid").agg(F.min("leader").alias("over")).where("over < sid").withColumnRenamed("sid", "under"), "leaders")
    merged = members.join(over, members["leader"] == over["under"], "left")
    merged = merged.select(F.coalesce("over", "leader").alias("leader"), "sid")
    # A leader that has itself gone to a smaller one stays in the group that keeps its name: blocks are cut around it.
    members = materialize(merged.unionByName(merged.select("leader", F.col("leader").alias("sid"))).distinct(), "members")
    free_shuffles(spark)

    def send_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(1).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            size = 0
            for k, s in _sets(batch.column(0), n):
                sid, raw = xxhash.xxh3_128_digest(s), s.tobytes()
                for p in places[k]:
                    for c, v in zip(rows, (p["leader"], p["block"], p["side"], sid, raw), strict=True):
                        c.append(v)
                    size += len(raw)
                    if size > SENT_BYTES:
                        yield _placed(*rows)
                        rows, size = [[], [], [], [], []], 0
            if rows[0]:
                yield _placed(*rows)

    def joined(places: DataFrame, across: bool) -> DataFrame:
        """The output of `_join_blocks` for sets placed as (sid, leader, block, side)."""
        packed = places.groupBy("sid").agg(F.collect_list(F.struct("leader", "block", "side")).alias("places"))
        packed = packed.join(named.select("sid", F.col("k.id").alias("cid"), F.col("k.th").alias("cth")).hint("merge"), "sid").select("cid", "cth", "places")
        packed = materialize(packed, "places").hint("merge")
        # Texts that have no place aren't shuffled, but for some that share another's mark.
        slot = lambda th: F.pmod(th, F.lit(1 << MARK_BITS))
        words = packed.groupBy(F.shiftright(slot(F.col("cth")), 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cth & 63 as int))")).alias("marks"))
        words = F.broadcast(materialize(words, "marks"))
        marked = base.join(words, (F.shiftright(slot(base["th"]), 6) == F.col("word")) & F.expr("shiftright(marks, cast(th & 63 as int)) & 1 = 1"), "left_semi")
        texts = marked.join(packed, marked["id"].eqNullSafe(packed["cid"]) & (marked["th"] == packed["cth"])).select("text", "places")
        sent = texts.mapInArrow(send_sets, "leader binary, block int, side int, sid binary, hashes binary")
        sent = sent.repartition("leader", "block").sortWithinPartitions("leader", "block")
        out = materialize(sent.mapInArrow(_join_blocks(percent, across), "a binary, b binary, leader binary, block int, free binary"), "links")
        free_shuffles(spark)
        return out

    groups = materialize(members.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    blocks = F.when(F.col("n") > GROUP, F.ceil(F.col("n") / (GROUP // 2))).otherwise(1).cast("int")
    placed = materialize(members.join(groups.withColumn("blocks", blocks), "leader").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")), "placed")
    everywhere = F.when(F.col("sid") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    found = joined(placed.select("sid", "leader", F.explode(everywhere).alias("block"), (F.col("blocks") > 1).cast("int").alias("side")), False)
    links = found.where("a is not null").select("a", "b")
    free = found.where("free is not null").select(F.col("leader").alias("fl"), F.col("block").alias("fb"), "free")
    if free.limit(1).count():
        cut = placed.where("blocks > 1")
        sizes = cut.select("leader", "blocks").distinct()
        wanted = free.join(sizes, F.col("fl") == F.col("leader")).select(F.col("free").alias("sid"), "leader", F.explode(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("fb"))).alias("block"), F.lit(0).alias("side"))
        met = cut.join(wanted.select(F.col("leader").alias("wl"), F.col("block").alias("wb")).distinct(), (F.col("leader") == F.col("wl")) & (F.col("own") == F.col("wb")))
        met = met.select("sid", "leader", F.col("own").alias("block"), F.lit(1).alias("side"))
        links = links.unionByName(joined(wanted.unionByName(met), True).where("a is not null").select("a", "b"))
    labels = connected_components(links)

    # Sets of one row and no link answer for themselves; all others get their component's least id.
    several = named.join(labels, named["sid"] == labels["node"], "left").where("copies > 1 or node is not null").select("sid", F.coalesce("label", "sid").alias("label"), "least")
    several = materialize(several, "linked-sets")
    least = materialize(several.groupBy(F.col("label").alias("l")).agg(F.min("least").alias("component")), "components")
    found = materialize(several.join(least, F.col("label") == F.col("l")).select(F.col("sid").alias("lsid"), "component"), "components-of-sets")
    out = rows.join(found, rows["sid"] == found["lsid"], "left")
    return out.select(F.col("id").alias(id_col), "th", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """`docs` without the rows whose component has a smaller id; rows without words or id stay, and so do rows that repeat the smallest id."""
    found = similar_documents(docs, percent, n, id_col=id_col, text_col=text_col)
    id_, th = fresh(docs, "id", "th")
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(id_), F.col("th").alias(th)).distinct()
    gone = materialize(gone, "near-copies").hint("merge")
    free_shuffles(docs.sparkSession)
    return docs.join(gone, (docs[id_col] == gone[id_]) & (F.xxhash64(docs[text_col]) == gone[th]), "left_anti")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")
