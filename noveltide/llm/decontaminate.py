"""Removal of benchmark passages from training documents, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import barrier, fresh, table
from noveltide.llm.words import is_one_of, shingle_hashes, with_words
from noveltide.session import materialize

#: Words in a window.
WINDOW = 13
#: The most (window, item) pairs that are sent to all executors; with more, a shuffle join finds the windows.
BROADCAST_PAIRS = 50_000
#: The most hashes of windows that are sent to all executors then, to tell before any shuffle which document windows may be hits.
BROADCAST_HASHES = 2_000_000


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, n, gram): an item's windows of `window` words, or all its words if it has fewer but any."""
    items = benchmark.select(benchmark[id_col].alias("item"), benchmark[text_col].alias("text"))
    w = F.col("w")
    n = F.least(F.size(w), F.lit(window))
    items = with_words(items, F.col("text"), "w").where(F.size(w) > 0).select("item", "w", n.alias("n"))
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - F.col("n") + 1), lambda i: F.array_join(F.slice(w, i, F.col("n")), " "))
    return items.select("item", "n", F.explode(F.array_distinct(grams)).alias("gram")).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """Contamination per row of `docs`: id, th (xxhash64 of the text), n_words, covered (the hit words' positions from 1), items (as strings, sorted).

    Up to `broadcast_pairs` windows the scan looks every document window's hash
    up in a set that all executors hold and compares the words of hits, all
    within the row; with more windows, up to `broadcast_hashes` hashes are sent to all executors and pick the document windows that
    are joined with the items' words, and with more hashes still, both sides of that join are dealt by hash.
    Texts are read once; what is found is written without them and then given its items.
    A null text has no words; items without words have no windows. Repeated rows have a row each.
    """
    spark = docs.sparkSession
    grams = benchmark_windows(benchmark, window, item_col, item_text_col)
    few = grams.take(broadcast_pairs + 1)
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    base = with_words(base, F.col("text"), "w").select("id", F.xxhash64("text").alias("th"), "w")
    w = F.col("w")
    if len(few) <= broadcast_pairs:
        sizes = sorted({r.n for r in few})
        texts = {n: sorted({r.gram for r in few if r.n == n}) for n in sizes}
        keys: dict[int, list[int]] = {n: [] for n in sizes}
        if few:
            local = spark.createDataFrame([(n, g) for n in sizes for g in texts[n]], "n int, gram string")
            for r in local.select("n", F.xxhash64(F.split("gram", " ")).alias("h")).collect():
                keys[r.n].append(r.h)
        found = F.array().cast("array<struct<i:int,n:int>>")
        for n in sizes:
            base = barrier(base, **{f"h{n}": shingle_hashes(w, n)})
            found = F.concat(found, _occurrences(w, F.col(f"h{n}"), n, keys[n], texts[n]))
        base = barrier(base, found=found)
        named = spark.createDataFrame([(r.gram, r.item) for r in few], f"gram string, item {dict(benchmark.dtypes)[item_col]}")
        base = base.withColumn("grams", F.array_distinct(F.transform("found", lambda s: F.array_join(F.slice(w, s["i"], s["n"]), " "))))
    else:
        sizes = [r.n for r in grams.select("n").distinct().collect()]
        keyed = grams.select("n", "gram", F.xxhash64(F.split("gram", " ")).alias("h")).distinct()
        keyed = materialize(keyed, "windows")
        hashes = keyed.select("n", "h").distinct()
        hashes = F.broadcast(hashes) if hashes.count() <= broadcast_hashes else hashes
        # One scan for all lengths. Windows whose hash no item has go where they're read, unless there are too many hashes to send.
        placed = F.array().cast("array<struct<n:int,i:int,h:bigint>>")
        for n in sizes:
            base = barrier(base, **{f"h{n}": shingle_hashes(w, n)})
            placed = F.concat(placed, _at(F.col(f"h{n}"), n))
        hits = base.select("id", "th", F.inline(placed)).join(hashes, ["n", "h"], "left_semi").join(keyed, ["n", "h"]).select("id", "th", "i", "n", "gram")
        hits = hits.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("i", "n", "gram"))).alias("at"))
        hits = hits.select(F.col("id").alias("hid"), F.col("th").alias("hth"), "at").hint("merge")
        base = base.join(hits, base["id"].eqNullSafe(hits["hid"]) & (base["th"] == hits["hth"]), "left")
        true = F.filter("at", lambda s: F.array_join(F.slice(w, s["i"], s["n"]), " ") == s["gram"])
        base = barrier(base, true=F.coalesce(true, F.array().cast("array<struct<i:int,n:int,gram:string>>")))
        base = base.withColumns({"found": F.transform("true", lambda s: F.struct(s["i"], s["n"])), "grams": F.array_distinct(F.transform("true", lambda s: s["gram"]))})
        named = grams.select("gram", "item").distinct()
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1)))))
    slim = materialize(base.select("id", "th", F.size("w").cast("long").alias("n_words"), covered.alias("covered"), "grams"), "hits")
    dirty = slim.where(F.size("grams") > 0).select("id", "th", F.explode("grams").alias("gram")).distinct()
    items = dirty.join(named, "gram").groupBy("id", "th").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    items = items.select(F.col("id").alias("iid"), F.col("th").alias("ith"), "items")
    out = slim.join(items, slim["id"].eqNullSafe(items["iid"]) & (slim["th"] == items["ith"]), "left")
    return out.select("id", "th", "n_words", "covered", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _at(h: Column, n: int) -> Column:
    """(n, position, hash) of all windows of n words."""
    return F.transform(h, lambda x, i: F.struct(F.lit(n).alias("n"), (i + 1).alias("i"), x.alias("h")))


def _occurrences(w: Column, h: Column, n: int, keys: list[int], texts: list[str]) -> Column:
    """(position, n) of the windows whose hash and then words are among the given ones."""
    at = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: is_one_of(F.get(h, i - 1), keys) & is_one_of(F.array_join(F.slice(w, i, n), " "), texts))
    at = F.when(F.size(h) > 0, at).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(n).alias("n")))


def is_contaminated() -> Column:
    """Of a row of `find_hits`: a twentieth or more of the words, and at least one, lie in benchmark windows."""
    n = F.size("covered")
    return (n > 0) & (20 * n >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """`docs` without contaminated rows; clean rows stay as they are, null and empty texts among them. Rows that repeat are each judged alike."""
    found = find_hits(docs, benchmark, id_col=id_col, text_col=text_col, **columns).where(is_contaminated())
    id_, th = fresh(docs, "id", "th")
    found = materialize(found.select(F.col("id").alias(id_), F.col("th").alias(th)).distinct(), "contaminated").hint("merge")
    return docs.join(found, docs[id_col].eqNullSafe(found[id_]) & (F.xxhash64(docs[text_col]) == found[th]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """`docs` with hit words, and the gaps before them, cut from the texts; null texts stay null, other columns as they are."""
    found = find_hits(docs, benchmark, id_col=id_col, text_col=text_col, **columns).where(F.size("covered") > 0)
    id_, th, covered = fresh(docs, "id", "th", "covered")
    found = found.select(F.col("id").alias(id_), F.col("th").alias(th), F.col("covered").alias(covered)).distinct().hint("merge")
    joined = docs.join(found, docs[id_col].eqNullSafe(found[id_]) & (F.xxhash64(docs[text_col]) == found[th]), "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"({gap}*{word}|{gap}+$)"), F.lit(1))
    kept = F.filter(parts, lambda _, i: ~F.array_contains(covered, i + 1))
    text = F.when(F.col(covered).isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    return joined.withColumn(text_col, text).drop(id_, th, covered)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_hits(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("covered").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
