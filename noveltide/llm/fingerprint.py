"""Exact document fingerprints over canonical text, with built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noveltide.llm.common import barrier, table
from noveltide.session import materialize

#: Bytes of text per range that `with_next` aims at, and the most ranges; beyond both, ranges get larger and their sort spills.
RANGE_BYTES = 32 << 20
MOST_RANGES = 1_000_000
#: Quantiles that one aggregation finds; more come from a second one within these.
MARKS = 1000
_ICU = "com.ibm.icu"
#: Spaces that Java's test of white space leaves out.
_OTHER_SPACES = "\x85\xa0\u2007\u202f"


def canonical(text: Column) -> Column:
    """Unicode composition (NFC), full case folding, composition again, and white-space runs as one space, none at the ends.

    Composition and folding come from the ICU library inside Spark, runs of white space
    from its string library, between two marks that keep control characters at the ends. A null text counts as empty.
    """
    compose = lambda t: F.reflect(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), t, F.lit(False))
    folded = F.reflect(F.lit(f"{_ICU}.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    plain = compose(folded)
    for space in _OTHER_SPACES:
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    marked = F.reflect(F.lit("org.apache.commons.lang3.StringUtils"), F.lit("normalizeSpace"), F.concat(F.lit("|"), plain, F.lit("|")))
    return F.trim(F.substring(marked, F.lit(2), F.char_length(marked) - 2))


def wide_hash(text: Column) -> Column:
    """128 bits as 32 hex digits: xxhash64 under two seeds."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second seed"), text)), 16, "0")))


def _cuts(ids: DataFrame, parts: int) -> list[int]:
    """Up to `parts` - 1 ascending ids that cut a table (one column, id, no nulls) into ranges of about as many rows; the largest id isn't one."""
    many = min(parts, MARKS)
    marks = lambda n: F.array(*(F.lit(i / n) for i in range(1, n)))
    if many < 2:
        return []
    found = set(ids.agg(F.percentile_approx("id", marks(many), F.lit(20 * many))).first()[0] or [])
    if parts > MARKS:
        each, coarse = min(MARKS, -(-parts // MARKS)), sorted(found)
        if each > 1:
            at = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda c: c < F.col("id")))
            rows = ids.groupBy(at.alias("k")).agg(F.percentile_approx("id", marks(each), F.lit(20 * each)).alias("q")).collect()  # MOST_RANGES numbers at most
            found |= {c for r in rows for c in r.q}
    top = ids.agg(F.max("id")).first()[0]
    return sorted(c for c in found if c < top) if top is not None else []


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame] = lambda df: df, carry: tuple[str, ...] = ()) -> DataFrame:
    """Add `__next` to rows (id, text): the text (null: empty) and the `carry` columns of the next row in descending order of the integer id.

    `add` adds columns of a row's own; it sees each row once, before rows are sorted. The
    last row's next is the first row. Equal ids follow by their texts' hash
    and then bytes; null ids come last, in that order too. Ids are cut into ranges of about `RANGE_BYTES` at quantiles (null ids by
    their texts' hash), each range also gets a copy of the following range's first row, and a window works
    inside the range. The driver sees the quantiles (`MOST_RANGES` at most) and nothing else. Rows of one id share a range.
    """
    spark = docs.sparkSession
    own = F.col("id")
    size = docs.agg(F.count("*").alias("n"), F.count("id").alias("known"), F.sum(F.octet_length("text")).alias("bytes")).first()
    least = min(size.n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(MOST_RANGES, max(1, least, (size.bytes or 0) // RANGE_BYTES))
    cuts = _cuts(docs.select("id").where("id is not null"), parts)
    block = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[k : k + block] for k in range(0, len(cuts), block)]
    # One row, of MOST_RANGES numbers at most, is sent to all executors.
    lookup = F.broadcast(spark.createDataFrame([(blocks, [b[-1] for b in blocks])], "__blocks array<array<bigint>>, __lasts array<bigint>"))
    over = F.size(F.filter("__lasts", lambda c: c < own))
    within = F.when(over < len(blocks), F.size(F.filter(F.get("__blocks", over), lambda c: c < own))).otherwise(len(cuts) - block * over)
    # Ranges ascend as ids descend.
    nulls = max(1, parts * (size.n - size.known) // max(1, size.n))
    tie = F.xxhash64("text")
    null_range = len(cuts) + 1 + F.floor((tie.cast("double") / 2.0**64 + 0.5) * nulls)
    place = F.when(own.isNull(), F.least(null_range, F.lit(len(cuts) + nulls))).otherwise(len(cuts) - (over * block + within)).cast("int")
    texts = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = texts.crossJoin(lookup).select("id", "text", place.alias("__range"))

    some_null = size.known < size.n
    lead_of = [F.max("id").alias("__first")] + ([F.min(F.when(own.isNull(), tie)).alias("__th")] if some_null else [])
    firsts = (ranged if some_null else docs.select("id", F.lit("").alias("text")).crossJoin(lookup).select("id", "text", place.alias("__range"))).groupBy("__range").agg(*lead_of)
    firsts = materialize(firsts, "range-heads")
    order = Window.orderBy("__range")
    lowest = firsts.agg(F.max("__range").alias("__lowest"))
    firsts = firsts.withColumn("__before", F.lag("__range").over(order)).crossJoin(F.broadcast(lowest))
    firsts = F.broadcast(firsts.select(F.col("__range").alias("__at"), "__first", *(["__th"] if some_null else []), F.coalesce("__before", "__lowest").alias("__to")))
    is_first = (F.col("__range") == F.col("__at")) & own.eqNullSafe(F.col("__first"))
    if some_null:
        is_first &= own.isNotNull() | (tie == F.col("__th"))
    heads = ranged.join(firsts, is_first).groupBy("__at", "__to").agg(F.min_by(F.struct("id", "text"), F.struct(tie, "text")).alias("__row"))
    heads = heads.select("__row.*", F.col("__to").alias("__range"), F.lit(1).alias("__extra"))
    rows = add(ranged.withColumn("__extra", F.lit(0)).unionByName(heads))
    w = Window.partitionBy("__range").orderBy(F.col("__extra"), own.desc_nulls_last(), tie, F.col("text"))
    following = F.lead(F.struct("text", *carry)).over(w)
    return rows.withColumn("__next", following).where("__extra = 0").drop("__range", "__extra")


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """Fingerprints of texts and of their edited forms, equal exactly where canonical texts are equal.

    The edited text has its last third (rounded down, in code points) replaced
    by as many, or all, of the next text's first code points. The wide hash
    groups canonical texts; in every group of two or more, the bytes of the
    smallest and the largest canonical text are compared, and where they
    differ each fingerprint of the group gets the text's SHA-256 appended.
    Least and greatest are taken per task before the shuffle, and only texts of
    such groups move.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, and
    near_edited and near_next: 1.0 if that fingerprint is equal, else 0.0, as an exact
    digest knows no degrees. One row per input row, repeated ids too; a null text is empty. Other columns of `docs` are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def printed(rows: DataFrame) -> DataFrame:
        return barrier(barrier(rows, c=canonical(F.col("text"))), h=hash_of(F.col("c")), s=F.unhex(F.sha2(F.col("c").cast("binary"), 256)))

    rows = with_next(docs, lambda df: printed(df).drop("c"), ("h", "s"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.when(cut > 0, F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("__next.text"), F.lit(1), cut))).otherwise(F.col("text"))
    rows = rows.select("id", "h", "s", F.col("__next.h").alias("hn"), F.col("__next.s").alias("sn"), n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = barrier(rows, ce=canonical(F.col("edited")), edited_sha256=F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    rows = barrier(rows, he=hash_of(F.col("ce")), se=F.unhex(F.sha2(F.col("ce").cast("binary"), 256)))
    rows = materialize(rows, "fingerprints")

    hashes = rows.select(F.explode(F.array("h", "he")).alias("h"))
    shared = materialize(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared-buckets")
    texts = printed(docs).select("h", "c").unionByName(rows.select(F.col("he").alias("h"), F.col("ce").alias("c"))).join(shared, "h", "left_semi")
    mixed = texts.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("h")
    mixed = materialize(mixed, "mixed-buckets")
    out = rows.drop("ce")
    for h, s in (("h", "s"), ("he", "se"), ("hn", "sn")):
        out = out.join(mixed.select(F.col("h").alias("m")), F.col(h) == F.col("m"), "left")
        out = out.withColumn(h, F.when(F.col("m").isNull(), F.col(h)).otherwise(F.concat(h, F.lit("-"), F.lower(F.hex(s))))).drop("m")
    same = lambda other: (F.col("h") == F.col(other)).cast("double")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("h").alias("fingerprint"), F.col("he").alias("edited_fingerprint"), same("he").alias("near_edited"), same("hn").alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
