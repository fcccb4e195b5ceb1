"""License notices in documents: MinHash bands over overlapping windows retrieve templates, exact containment of words verifies; built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import barrier, table
from noveltide.llm.licenses import TEMPLATES
from noveltide.llm.words import is_one_of, shingle_hashes, with_words
from noveltide.session import materialize

#: Words in a shingle, and the share of a template's shingles that a window must hold.
SHINGLE = 5
SIMILARITY = 0.8
#: Bands of one MinHash row each: the smallest shingle hash of each of 2 ** BAND_BITS parts of the hash space (one permutation).
BAND_BITS = 7
#: The most band values of templates that the scan holds as literals; with more, positions are joined with them.
MOST_KEYS = 50_000
#: Tables made from the templates of at most so many rows are sent to all executors in these joins, so that no text moves; larger ones are left to Spark.
MOST_SENT = 500_000
#: Lengths of templates are rounded up to classes that grow by this factor, so any set of templates has a few dozens.
GROWTH = 1.25


def length_class(n: int) -> int:
    """n words rounded up to a class."""
    c = SHINGLE
    while c < n:
        c = max(c + 1, int(c * GROWTH))
    return c


def window_shape(n: int) -> tuple[int, int]:
    """(stride, words) of the windows for templates of n words: any n consecutive words lie wholly in one window."""
    c = length_class(n)
    stride = max(1, c // 4)
    return stride, c + stride


def least_similarity(n: int, similarity: float = SIMILARITY) -> float:
    """The smallest Jaccard similarity of a template of n words (all shingles different) and a window that holds `similarity` of its shingles."""
    m = n - SHINGLE + 1
    held = math.ceil(similarity * m - 1e-9)
    return held / (window_shape(n)[1] - SHINGLE + 1 + m - held)


def _band(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BAND_BITS)


def _sent(table: DataFrame, rows: int) -> DataFrame:
    """The template side of a join, sent to all executors where its rows are few enough."""
    return F.broadcast(table) if rows <= MOST_SENT else table


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", most_keys: int = MOST_KEYS) -> DataFrame:
    """The license templates in each row's text.

    For templates of n words, texts have windows of n and a quarter words (n rounded up to a class)
    every quarter, so each occurrence lies wholly in a window. A MinHash band of
    a window is the smallest hash of its five-word shingles in one part of the hash space, and one band in common retrieves a template.
    A window's band can only equal a template's where it holds that very shingle, so bands are worked out where one
    occurs: it must be the smallest of its part in all of the window. A
    window that holds 0.8 of a long template's shingles has a similarity of 0.45 or more, so it agrees in no
    band of over 100 with a probability below 1e-20; for a template of one shingle it's below 1e-4.
    The texts retrieved are then compared with the template word by word: a window matches if it holds `similarity` of the shingles.

    Returns id, license, containment (the best window's), first_word (that
    window's first matching word, from 0; the earliest of ties) and n_windows (matching ones): one row per
    distinct (id, text) and license. Null and short texts match nothing, and
    templates of fewer than five words are rejected. Repeated rows count once. Other columns of `docs` are ignored.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame(sorted(templates.items()), "license string, template string")
    given = with_words(given, F.col("template"), "w")
    given = given.select("license", F.size("w").alias("n"), "w", shingle_hashes(F.col("w"), SHINGLE).alias("h")).collect()  # as many rows as the caller gave
    if short := [r.license for r in given if r.n < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    shapes = {r.license: window_shape(r.n) for r in given}
    bands, grams = set(), []
    for r in given:
        smallest: dict[int, int] = {}
        for x in r.h:
            part = (x & (2**64 - 1)) >> (64 - BAND_BITS)
            smallest[part] = min(x, smallest.get(part, x))
        bands |= {(shapes[r.license][0], shapes[r.license][1], v, r.license) for v in smallest.values()}
        own = sorted({" ".join(r.w[k : k + SHINGLE]) for k in range(r.n - SHINGLE + 1)})
        grams += [(r.license, g, k, len(own), *shapes[r.license]) for k, g in enumerate(own)]
    keys = sorted({v for _, _, v, _ in bands})

    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    base = with_words(base, F.col("text"), "w").select("id", F.xxhash64("text").alias("th"), "w")
    base = barrier(base, h=shingle_hashes(F.col("w"), SHINGLE))
    if len(keys) <= most_keys:
        at = F.when(F.size("h") > 0, F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: is_one_of(F.get("h", i), keys)))
        base = barrier(base, at=at).where(F.size("at") > 0)
    else:
        known = _sent(spark.createDataFrame([(v,) for v in keys], "v long"), len(keys))
        at = base.select("id", "th", F.posexplode("h").alias("i", "v")).join(known, "v").groupBy(F.col("id").alias("aid"), F.col("th").alias("ath")).agg(F.collect_set("i").alias("at"))
        base = base.join(at.hint("merge"), base["id"].eqNullSafe(at["aid"]) & (base["th"] == at["ath"])).drop("aid", "ath")

    def in_band(stride: int, words: int, i: Column) -> Column:
        """Whether the shingle at i is the smallest of its band in a window that holds it."""
        v = F.get("h", i)
        first = F.greatest(F.lit(0), F.ceil((i + SHINGLE - words) / stride).cast("int"))
        holding = F.sequence(first, F.floor(i / stride).cast("int"))
        return F.exists(holding, lambda k: ~F.exists(F.slice("h", k * stride + 1, words - SHINGLE + 1), lambda x: (x < v) & (_band(x) == _band(v))))

    def retrieved(stride: int, words: int) -> Column:
        own = sorted({v for s, n, v, _ in bands if (s, n) == (stride, words)})
        here = F.filter("at", lambda i: is_one_of(F.get("h", i), own))
        return F.transform(F.filter(here, lambda i: in_band(stride, words, i)), lambda i: F.struct(F.lit(stride).alias("s"), F.lit(words).alias("n"), F.get("h", i).alias("v")))

    hits = F.array_distinct(F.concat(*(retrieved(s, n) for s, n in sorted(set(shapes.values())))))
    base = barrier(base, hits=hits).where(F.size("hits") > 0)
    base = materialize(base.select("id", "th", "w", "hits"), "licensed-texts")

    band_rows = spark.createDataFrame(sorted(bands), "s int, n int, v long, license string")
    named = base.select("id", "th", F.inline("hits")).join(_sent(band_rows, len(bands)), ["s", "n", "v"]).select(F.col("id").alias("cid"), F.col("th").alias("cth"), F.col("license").alias("clicense")).distinct()
    gram_rows = spark.createDataFrame(grams, "license string, gram string, g int, m int, s int, n int")
    # Only shingles whose hash a template has become rows, and these meet the templates' words where they are.
    gram_keys = sorted({x for r in given for x in r.h})
    places = F.sequence(F.lit(0), F.size("h") - 1)
    here = F.filter(places, lambda i: is_one_of(F.get("h", i), gram_keys)) if len(gram_keys) <= most_keys else places
    each = F.transform(here, lambda i: F.struct(i.alias("i"), F.array_join(F.slice("w", i + 1, SHINGLE), " ").alias("gram")))
    found = barrier(base.select("id", "th", "w"), h=shingle_hashes(F.col("w"), SHINGLE)).select("id", "th", F.inline(each))
    found = found.join(_sent(gram_rows, len(grams)), "gram").select("id", "th", "license", "i", "g", "m", "s", "n")
    found = found.join(named, found["id"].eqNullSafe(named["cid"]) & (found["th"] == named["cth"]) & (found["license"] == named["clicense"]), "left_semi")
    first = F.greatest(F.lit(0), F.ceil((F.col("i") + SHINGLE - F.col("n")) / F.col("s")).cast("int"))
    windows = found.select("id", "th", "license", "i", "g", "m", F.explode(F.sequence(first, F.floor(F.col("i") / F.col("s")).cast("int"))).alias("window"))
    windows = windows.groupBy("id", "th", "license", "m", "window").agg(F.size(F.collect_set("g")).alias("held"), F.min("i").alias("first"))
    windows = windows.withColumn("containment", F.col("held") / F.col("m")).where(F.col("containment") >= similarity)
    best = F.min(F.struct((-F.col("containment")).alias("k"), "first")).alias("best")
    out = windows.groupBy("id", "th", "license").agg(best, F.count("*").alias("n_windows"))
    return out.select(F.col("id").alias(id_col), "license", (-F.col("best.k")).alias("containment"), F.col("best.first").cast("long").alias("first_word"), "n_windows")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
ORACLES = {
    "op2_license_scan": f"""
WITH RECURSIVE classes(c) AS (SELECT {SHINGLE} UNION ALL SELECT greatest(c + 1, floor(c * {GROWTH})::INT) FROM classes WHERE c < 5000),
given(license, template) AS (VALUES {_VALUES}),
tw AS (SELECT license, {_WORDS.format("template")} AS w FROM given),
tc AS (SELECT license, w, (SELECT min(c) FROM classes WHERE c >= len(w)) AS c FROM tw),
ts AS (SELECT DISTINCT license, c, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT license, c, w, unnest(range(1, len(w) - 3)) AS i FROM tc)),
tn AS (SELECT license, count(*) AS m, any_value(greatest(1, c // 4)) AS stride, any_value(c + greatest(1, c // 4)) AS words FROM ts GROUP BY license),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
f AS (SELECT doc_id, i, s, license, m, stride, words FROM ds JOIN ts USING (s) JOIN tn USING (license)),
k AS (SELECT *, unnest(range(0, i // stride + 1)) AS win FROM f),
v AS (SELECT doc_id, license, win, count(DISTINCT s) / m::DOUBLE AS containment, min(i) AS first_word FROM k WHERE i + 5 <= win * stride + words
      GROUP BY doc_id, license, win, m HAVING count(DISTINCT s) / m::DOUBLE >= 0.8)
SELECT doc_id, license, max(containment) AS containment, arg_min(first_word, (-containment, first_word))::BIGINT AS first_word, count(*)::BIGINT AS n_windows
FROM v GROUP BY doc_id, license
"""
}
