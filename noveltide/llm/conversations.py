"""Repair of conversation structure: the cheapest edits that make roles alternate, by A* on the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import prepare, table
from noveltide.session import materialize

#: Costs of the edits, and what a truncated row costs if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows that one search covers; longer conversations are searched in chunks that are then chained.
CHUNK = 256
#: The most range partitions of the conversations.
MOST_PARTS = 10_000

#: Faults of a row.
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: What the roles so far end in: nothing yet, system, user, assistant. Only nothing and assistant may end a conversation.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
_NEXT: dict[int, dict[str, int]] = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_ENDS = (START, ASSISTANT)
_LEGAL = ("su", "ua", "au")
_NAMES = {USER: "user", ASSISTANT: "assistant"}

Way = tuple[int, str]
Row = tuple[int, str]  # fault, role's initial


def search(rows: list[Row], entry: int, last: bool) -> dict[int, Way]:
    """The cheapest edits of `rows` from state `entry` to each state: {state: (cost, audit)}, of equal costs the ASCII-least audit.

    A* on the lattice of (rows consumed, state). The heuristic is the suffix sum of what no way avoids: 2 for a row that must
    be deleted, and for a truncated row the lesser of its charge and a deletion. It is consistent, and the heap's
    keys (cost plus heuristic, audit) never fall along a way, so the first visit of a node is its best. With `last` the search
    stops at the first end that a conversation may have; else all states after the last row are visited, and inserts
    after that row are left to the next chunk.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][0]
        rest[i] = rest[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else min(DELETE, TRUNCATED) if fault == CUT else 0)
    heap: list[tuple[int, str, int, int]] = [(rest[0], "", 0, entry)]
    seen: set[tuple[int, int]] = set()
    found: dict[int, Way] = {}
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        cost = f - rest[i]
        if i == n:
            if not last:
                found[state] = (cost, audit)
                continue
            if state in _ENDS:
                return {state: (cost, audit)}
        else:
            fault, initial = rows[i]
            after = cost + rest[i + 1]
            heapq.heappush(heap, (after + DELETE, audit + "D", i + 1, state))
            if fault in (NONE, CUT):
                after += TRUNCATED if fault == CUT else 0
                ways = _NEXT[state]
                if initial in ways:
                    heapq.heappush(heap, (after, audit + "K", i + 1, ways[initial]))
                for role in ("u", "a"):
                    if role in ways:
                        heapq.heappush(heap, (after + REROLE, audit + "R", i + 1, ways[role]))
        for role in ("u", "a"):
            if role in _NEXT[state]:
                heapq.heappush(heap, (f + INSERT, audit + "I", i, _NEXT[state][role]))
    return found


def pick(ways: dict[int, Way], ahead: dict[int, int]) -> tuple[int, Way]:
    """The state after a chunk, and the way there, that the cheapest and then ASCII-least edits of the whole take.

    Ways through one chunk end with its last row, so none of equal cost is another's prefix, and the least one is least whatever follows.
    """
    return min(((s, w) for s, w in ways.items() if s in ahead), key=lambda x: (x[1][0] + ahead[x[0]], x[1][1]))


class Piece:
    """What a run of rows of one conversation gives: counts, turns, and its rows with faults."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.texts: list[tuple[str, str]] = []
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.first = self.last = None  # the roles' initials at both ends
        self.turns: list[int | None] = [None, None]
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        if not copies:
            return
        initial = role[:1]
        for k in range(copies):
            own = DUPLICATE if k and fault != BLANK else fault
            self.faults[own] += 1
            self.rows.append((own, initial))
            self.texts.append((role, text if own in (NONE, CUT) else ""))
            if self.last is None:
                self.first = initial
            else:
                self.illegal += self.last + initial not in _LEGAL
            self.last = initial
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
            self.distinct += 1

    def chunks(self) -> list[list[Row]]:
        return [self.rows[k : k + CHUNK] for k in range(0, len(self.rows), CHUNK)]

    def ways(self) -> list[list[dict[int, Way]]]:
        return [[search(c, s, False) for s in range(4)] for c in self.chunks()]

    def matrix(self) -> list[int]:
        """Least costs from each of the 4 states to each, -1 where there is no way."""
        total: list[dict[int, int]] = [{s: 0} for s in range(4)]
        for ways in self.ways():
            total = [{t: min(c + ways[m][t][0] for m, c in row.items() if t in ways[m]) for t in range(4) if any(t in ways[m] for m in row)} for row in total]
        return [row.get(t, -1) for row in total for t in range(4)]

    def repair(self, entry: int, ahead: dict[int, int] | None) -> tuple[int, str, int]:
        """(cost, audit, state) of this piece in the whole's cheapest edits; `ahead` has the costs after it, None: it is the conversation's last."""
        chunks = self.chunks()
        if ahead is None and len(chunks) < 2:
            ((state, (cost, audit)),) = search(self.rows, entry, True).items()
            return cost, audit, state
        inner = chunks if ahead is not None else chunks[:-1]
        ways = [[search(c, s, False) for s in range(4)] for c in inner]
        if ahead is None:
            final = [search(chunks[-1], s, True) for s in range(4)]
            ahead = {s: c for s, w in enumerate(final) for c, _ in w.values()}
        later = [ahead]
        for w in reversed(ways):
            later.insert(0, {s: min(costs) for s in range(4) if (costs := [x[0] + later[0][t] for t, x in w[s].items() if t in later[0]])})
        cost, audit, state = 0, [], entry
        for w, after in zip(ways, later[1:], strict=True):
            state, (own, letters) = pick(w[state], after)
            cost += own
            audit.append(letters)
        if len(inner) < len(chunks):
            ((state, (own, letters)),) = final[state].items()
            cost += own
            audit.append(letters)
        return cost, "".join(audit), state

    def repaired(self, entry: int, audit: str) -> list[tuple[str, str]]:
        """Roles and texts after the edits; the states tell which role an edit gives."""
        out, state, i = [], entry, 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else self.texts[i]
            i += edit != "I"
            if edit == "D":
                continue
            state = _NEXT[state][role[0]] if edit == "K" else ASSISTANT if state == USER else USER
            out.append((role if edit == "K" else _NAMES[state], text))
        return out


def faulty_rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, copies, fault): equal rows of a conversation counted, each with the fault of its first copy.

    Later copies are duplicates. `copies` says how often a row counts; conversations of which no row counts keep one row of 0 copies.
    Nulls of role and text are one space.
    """
    n = F.lit(1) if copies is None else copies
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), n.cast("long").alias("copies"))
    gone = F.col("copies") == 0
    rows = rows.select("conv", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(F.col("text")).alias("text"), "copies")
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("key", F.sha2("text", 256))
    rows = materialize(rows.withColumn("blank", ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))), "turns")
    # The least turn (nulls first) that has a conversation's role and text; only what occurs at several turns is joined.
    said = rows.where("copies > 0 and not blank").groupBy("conv", "role", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    said = materialize(said.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), F.col("first.turn").alias("first"), F.lit(True).alias("again")), "repeated")
    rows = rows.join(said, rows.conv.eqNullSafe(said.c) & (rows.role == said.r) & (rows.key == said.k), "left")
    ends = F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("again") & ~F.col("turn").eqNullSafe(F.col("first")), DUPLICATE).when(ends, NONE).otherwise(CUT)
    return rows.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Any, Piece]]:
    """(part, conversation, piece) of rows sorted by part and conversation."""
    key, piece = None, Piece()
    for b in batches:
        for part, conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (part, conv):
                if key is not None:
                    yield *key, piece
                key, piece = (part, conv), Piece()
            piece.add(turn, role, text, copies, fault)
    if key is not None:
        yield *key, piece


def _ahead(segments: list[list[int]]) -> list[dict[int, int] | None]:
    """Of a conversation's ranges in order: the least costs, from each state after the range, to the conversation's end; None after the last one."""
    least = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
    out: list[dict[int, int] | None] = [None]
    for m in reversed(segments[1:]):
        least = {s: min(c) for s in range(4) if (c := [m[4 * s + t] + least[t] for t in range(4) if m[4 * s + t] >= 0 and t in least])}
        out.insert(0, least)
    return out


def _plans(split: DataFrame) -> dict[tuple[int, Any], tuple[int, dict[int, int] | None]]:
    """{(part, conversation): (state before, costs after)} of the conversations that span ranges.

    Two passes over their rows without texts: the ranges' costs from state to state, and then, as the costs after each range
    are known, the state that each range's cheapest edits lead to. The driver gets 16 and then 4 numbers a range and conversation.
    """
    spark = split.sparkSession
    kind = split.schema["conv"].dataType.simpleString()

    def of(name: str, f: Any) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is None:
                return
            schema = pa.schema([("part", pa.int32()), ("conv", first.schema.field("conv").type), (name, pa.list_(pa.int32()))])
            for part, conv, piece in _pieces(b for bs in ([first], batches) for b in bs):
                yield pa.RecordBatch.from_pylist([{"part": part, "conv": conv, name: f(part, conv, piece)}], schema)

        return sorted(split.mapInArrow(run, f"part int, conv {kind}, {name} array<int>").collect(), key=lambda r: r.part)

    by_conv: dict[Any, list] = {}
    for r in of("costs", lambda part, conv, piece: piece.matrix()):
        by_conv.setdefault(r.conv, []).append(r)
    later = {(r.part, conv): a for conv, rs in by_conv.items() for r, a in zip(rs, _ahead([r.costs for r in rs]), strict=True)}
    sent = spark.sparkContext.broadcast(later)
    states: dict[Any, int] = {}
    plans = {}
    for r in of("after", lambda part, conv, piece: [piece.repair(s, a)[2] for s in range(4)] if (a := sent.value[part, conv]) is not None else [0] * 4):
        before = states.get(r.conv, START)
        plans[r.part, r.conv] = (before, later[r.part, r.conv])
        states[r.conv] = r.after[before]
    return plans


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_NUMBERS = ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal", "cost")


def _text(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "surrogatepass")


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None, keep_turns: bool = True) -> DataFrame:
    """Repaired conversations, in pieces: one by conversation, or several, by `part`, for one that spans ranges (`whole` is false).

    (conv, part, whole, first, last, low, high, distinct, blank, duplicate, truncated, illegal, cost, audit, turns, sha256): roles' initials at
    both ends, the least and greatest turn and their number, faults, the cost and letters of the edits, and the repaired turns. `sha256` is that of
    a whole conversation's lines `role:text`. Without `keep_turns` only pieces of several keep their turns.

    Rows are dealt to ranges of (conversation, turn, role, text), so a conversation of a third of all rows is spread over a third
    of the tasks, and equal rows count as one with `copies`. Each conversation inside a range is searched at once; `_plans`
    chains those that span ranges. Nulls: turns come first, a role or text is one space, a null conversation is one. Rows of one turn are in the order of
    role and text. Repeated rows are duplicates. An empty table stays empty; other columns are left out, whatever their names.
    """
    spark = df.sparkSession
    prepare(spark)
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text"]
    rows = faulty_rows(df, conv_col, turn_col, role_col, text_col, copies)
    parts = min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    rows = rows.select("part", "conv", "turn", "role", "text", "copies", "fault")
    # A range shares at most two conversations with others, so this table has fewer rows than there are ranges.
    spans = rows.select("conv", "part").distinct().groupBy(F.col("conv").alias("c")).agg(F.count("*").alias("n")).where("n > 1")
    dealt = lambda x: x.repartition(parts, "part").sortWithinPartitions("part", *order)  # noqa: E731
    split = rows.join(F.broadcast(materialize(spans, "spans")), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    sent = spark.sparkContext.broadcast(_plans(dealt(split).withColumn("text", F.lit(""))))
    names = ["conv", "part", "whole", "first", "last", *_NUMBERS, "audit", "turns", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = sent.value
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field("conv").type, pa.int32(), pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * len(_NUMBERS), pa.string(), _TURNS, pa.string()]
        out: list[tuple] = []
        size = 0
        for part, conv, p in _pieces(b for bs in ([first], batches) for b in bs):
            whole = (part, conv) not in plans
            entry, ahead = plans.get((part, conv), (START, None))
            cost, audit, _ = p.repair(entry, ahead)
            turns = p.repaired(entry, audit)
            sha = hashlib.sha256(_text(turns)).hexdigest() if whole else None
            kept = [{"role": r, "text": t} for r, t in turns] if keep_turns or not whole else None
            out.append((conv, part, whole, p.first, p.last, *p.turns, p.distinct, *p.faults[1:], p.illegal, cost, audit, kept, sha))
            size += len(audit) + (sum(len(t) for _, t in turns) if kept else 0)
            if len(out) >= 1000 or size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kind = rows.schema["conv"].dataType.simpleString()
    numbers = ", ".join(f"{n} long" for n in _NUMBERS)
    return dealt(rows).mapInArrow(run, f"conv {kind}, part int, whole boolean, first string, last string, {numbers}, audit string, turns array<struct<role: string, text: string>>, sha256 string")


def summaries(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row per conversation of `repair`: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Pieces of a conversation that spans ranges stream through one task in order, as one digest needs all its bytes; the task holds a piece at a time.
    """
    pieces = materialize(pieces, "pieces")
    keys = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("distinct")).cast("long")
    whole = pieces.where("whole").select(F.col("conv").alias(conv_col), gaps.alias("gaps"), *keys, "audit", F.col("sha256").alias("repaired_sha256"))
    names = [conv_col, "gaps", *keys, "audit", "repaired_sha256"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, schema = None, {}, None

        def done() -> pa.RecordBatch:
            low, high = total["low"], total["high"]
            values = [total["conv"], 0 if low is None else high - low + 1 - total["distinct"], *(total[k] for k in keys), "".join(total["audit"]), total["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [schema, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names)

        for b in batches:
            schema = b.schema.field("conv").type
            for r in b.to_pylist():
                if key != (r["conv"],):
                    if key is not None:
                        yield done()
                    key = (r["conv"],)
                    total = {"conv": r["conv"], "low": None, "high": None, "distinct": 0, "last": None, "audit": [], "sha": hashlib.sha256(), "any": False} | dict.fromkeys(keys, 0)
                for k in keys:
                    total[k] += r[k]
                if r["first"] is not None:
                    if total["last"] is not None:
                        total["illegal"] += total["last"] + r["first"] not in _LEGAL
                    total["last"] = r["last"]
                if r["low"] is not None:
                    total["distinct"] += r["distinct"] - (r["low"] == total["high"])
                    total["low"], total["high"] = r["low"] if total["low"] is None else total["low"], r["high"]
                total["audit"].append(r["audit"])
                if r["turns"]:
                    total["sha"].update((b"\n" if total["any"] else b"") + _text([(t["role"], t["text"]) for t in r["turns"]]))
                    total["any"] = True
        if key is not None:
            yield done()

    several = pieces.where("not whole").select("conv", "part", "first", "last", *_NUMBERS, "audit", "turns").repartition("conv").sortWithinPartitions("conv", "part")
    kind = pieces.schema["conv"].dataType.simpleString()
    return whole.unionByName(several.mapInArrow(join, f"`{conv_col}` {kind}, gaps long, {', '.join(f'{k} long' for k in keys)}, audit string, repaired_sha256 string"))


def damage(df: DataFrame) -> tuple[DataFrame, Column]:
    """`conversations` damaged by crc32 of `conv_id:turn`, mod 20, and how often each row counts after it: 0 (dropped), 2 (repeated) or 1."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), way.alias("way"))
    out = out.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "way")
    return out, F.when(F.col("way") == 0, 0).when(F.col("way") == 3, 2).otherwise(1)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and the edits that repair its structure."""
    damaged, copies = damage(table(spark, sf_dir, "conversations"))
    return summaries(repair(damaged, copies=copies, keep_turns=False))


#: The same edits by a recursive query: it keeps, for each conversation and state, the cheapest and then least way over the rows so far.
_SQL = r"""
WITH RECURSIVE
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS (SELECT *, flatten(list_transform(string_split(k, ''), lambda c: [(ord(c) >> b) & 1 FOR b IN range(8)])) AS b FROM raw),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda c, x: xor(c >> 1, CASE WHEN (xor(c, x) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS way FROM bits),
damaged AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE way <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faults AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' ELSE 'none' END AS fault,
 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'blank')::INT) AS blank, sum((fault = 'duplicate')::INT) AS duplicate, sum((fault = 'truncated')::INT) AS truncated,
 sum((before IS NOT NULL AND (before || c) NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM faults GROUP BY conv_id),
-- states: 0 nothing, 1 system, 2 user, 3 assistant; at most two inserts are useful in a row
inserts(s, t, cost, letters, added) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
steps(s, c, t, name) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
ways AS (
 SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS kept FROM counts
 UNION ALL
 SELECT conv_id, i, s, cost, audit, kept FROM (
  SELECT w.conv_id, f.i, e.t AS s, w.cost + n.cost + e.cost AS cost, w.audit || n.letters || e.letter AS audit, list_concat(list_concat(w.kept, n.added), e.line) AS kept
  FROM ways w JOIN inserts n ON n.s = w.s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1,
  LATERAL (SELECT n.t AS t, 2 AS cost, 'D' AS letter, []::VARCHAR[] AS line
   UNION ALL SELECT p.t, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM steps p WHERE p.s = n.t AND p.c = f.c AND f.fault IN ('none', 'truncated')
   UNION ALL SELECT p.t, CASE f.fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [p.name || ':' || f.text] FROM steps p WHERE p.s = n.t AND p.name <> '' AND f.fault IN ('none', 'truncated')) e
  QUALIFY row_number() OVER (PARTITION BY w.conv_id, f.i, e.t ORDER BY w.cost + n.cost + e.cost, w.audit || n.letters || e.letter) = 1)),
best AS (SELECT w.conv_id, w.cost + n.cost AS cost, w.audit || n.letters AS audit, list_concat(w.kept, n.added) AS kept FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts n ON n.s = w.s AND n.t IN (0, 3)
 QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + n.cost, w.audit || n.letters) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
ORACLES = {"op12_conversations": _SQL}
