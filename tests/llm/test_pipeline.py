"""The pipeline's stages, and the contract of the registered queries."""

import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_on_a_small_corpus(spark, docs, tmp_path):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice(["the", "on", "er", "ti", "re", "an", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item, twin = prose(30), prose(80)
    pairs = [(1, prose(90)), (2, twin), (3, twin + " more"), (4, prose(40) + " " + item + " " + prose(40)), (5, prose(60) + " jo@x.org " + prose(20)), (6, "too short"), (7, "same line again and again here\n" * 60), (8, None), (None, None)]
    folder = str(tmp_path)
    docs(pairs).drop("kept", "spans").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        kept[name] = {r.doc_id for r in now.collect()}
        if name == "pii":
            texts = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
            assert "<EMAIL>" in texts[5][0] and "@" not in texts[5][0] and texts[5][1] == len(texts[5][0])
        if name != "packing":
            assert now.columns == columns
    assert kept == {"quality_rules": {1, 2, 3, 4, 5}, "near_dedup": {1, 2, 4, 5}, "decontamination": {1, 2, 5}, "pii": {1, 2, 5}, "packing": {1, 2, 5}}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {1, 2, 5}


def test_odd_documents(spark, docs, tmp_path):
    rng = random.Random(22)
    prose = lambda n: " ".join("".join(rng.choice(["the", "on", "er", "ti", "re", "an", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    a, b, c, d = (prose(90) for _ in range(4))
    # Repeated ids and rows, null ids with texts of their own and with a copy, empty texts.
    pairs = [(1, a), (1, b), (1, b), (None, c), (None, d), (None, d + " more"), (7, ""), (8, None), (9, a + " too")]
    folder = str(tmp_path)
    docs(pairs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, "no such item in any of the texts at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        whole.setdefault((r.doc_id, r.doc_tokens), []).extend(r.ids)
        assert len(r.ids) == r.length <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    # One row of each group: a or its near copy, b once, c, and d or its near copy.
    assert sorted((k[0] for k in whole), key=str) == [1, 1, None, None]
    assert all(len(v) == k[1] for k, v in whole.items())


def test_an_empty_table(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, "an item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_registered_queries_have_their_columns(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    contract = {
        1: "doc_id held_out score predicted",
        2: "doc_id n_shingles component_id kept",
        3: "conv_id turn reply_to text",
        4: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        5: "doc_id start n_tokens ids_crc32",
        6: "doc_id item_id edits",
        7: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        8: "page_id url text n_chars",
        9: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        10: "doc_id n_tokens",
    }
    for n, columns in contract.items():
        (name,) = (q for q in queries if q.startswith(f"op{n}_"))
        assert set(columns.split()) <= set(queries[name](spark, SF).columns), name
    assert "pipeline" in queries
