import zlib

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from noveltide.llm import toxicity
from noveltide.llm.common import table
from tests.llm import test_decontaminate, test_jaccard_join, test_line_dedup


def test_run_against_brute_force(spark, sf):
    con = duckdb.connect()
    docs = dict(con.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall())
    bench = con.execute(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    scorer = toxicity.Scorer(toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"), ~toxicity.held_out()))
    docs = {i: t for i, t in docs.items() if scorer(t or "") < 0.5}
    docs = {i: kept for (i, _), (_, _, kept) in zip(docs.items(), test_line_dedup.brute(list(docs.values()), 10), strict=True)}
    label = test_jaccard_join.components(test_jaccard_join.sets_of(docs.values(), 5), 80)
    docs = {i: t for k, (i, t) in enumerate(docs.items()) if label[k] == k}
    found = test_decontaminate.brute(list(docs.values()), bench)
    docs = {i: t for (i, t), (n, c, _) in zip(docs.items(), found, strict=True) if not (c and 20 * len(c) >= n)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert set(rows) == set(docs)
    for i, t in docs.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(rows[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_stages_keep_the_columns_and_the_clean_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    odd = spark.createDataFrame([(10**6, None, "en", "s", None), (10**6 + 1, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.where(F.col("doc_id") >= 10**6).count() == 2


def test_stages_of_repeated_rows_clashing_columns_and_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").limit(30)
    clash = docs.unionByName(docs.limit(3)).withColumns({c: F.lit("x") for c in ("id", "th", "h", "w", "__id", "__th", "__drop", "__score", "__predicted", "score", "predicted", "n_lines", "component_id", "length", "grp", "sid", "leader")})
    for empty in (False, True):
        now = clash.limit(0) if empty else clash
        want = 0 if empty else 33
        for name, stage in corpus_pipeline.STAGES[:2]:
            now = stage(spark, now, sf).persist()
            assert set(now.columns) == set(clash.columns), name
        assert now.count() <= want
        for name, stage in corpus_pipeline.STAGES[2:4]:
            now = stage(spark, now, sf).persist()
            assert now.columns == clash.columns, name
        pieces = corpus_pipeline.STAGES[4][1](spark, now, sf)
        assert (pieces.count() > 0) != empty
