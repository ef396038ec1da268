"""Nulls, empty tables, very long texts, ties, repeated rows and clashing names."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from nearwell.llm import (decontaminate, minhash, packing, passages, quality, repeats, tools,
                          toxicity, urls, warc)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_quality(odd_documents, no_documents):
    rows = {(r["doc_id"], r["n_words"]) for r in quality.ledger(odd_documents).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 60_000), (None, 120)} <= rows
    kept = quality.keep(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 4, 5, 6, 7]
    assert quality.keep(no_documents).count() == 0
    assert {r["failing"] for r in quality.ablations(quality.ledger(no_documents)).collect()} == {0}


def test_minhash(odd_documents, no_documents):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(odd_documents).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 11}
    kept = minhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 8, 10, 11]
    assert minhash.keep_one(no_documents).count() == 0


def test_passages(odd_documents, no_documents):
    found = passages.find_passages(odd_documents).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in found} == {(5, 4), (7, 6)}
    kept = passages.drop_passages(odd_documents)
    assert kept.columns == odd_documents.columns
    rows = [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()]
    assert sorted(r[0] or 0 for r in rows) == [0, 1, 2, 3, 4, 4, 6, 7, 8, 9, 10, 11]
    assert (7, "tail", 4) in rows
    assert passages.drop_passages(no_documents).count() == 0


def test_repeats(odd_documents, no_documents):
    rows = {r["doc_id"]: r for r in repeats.remove_repeats(odd_documents).collect()}
    assert rows[5]["n_removed"] == rows[5]["n_bytes"] > 400_000 and rows[5]["n_spans"] == 1
    assert rows[4]["n_removed"] == 0 and rows[None]["n_removed"] == 0
    assert rows[1]["n_bytes"] == 0 and bytes(rows[1]["kept"]) == b""
    assert repeats.remove_repeats(no_documents).count() == 0


def test_decontamination(spark, odd_documents, no_documents):
    items = odd_documents.where("doc_id IN (1, 2, 6, 8)").withColumnRenamed("doc_id", "item_id")
    found = decontaminate.find_items(odd_documents, items.union(items)).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert pairs == {(6, 6), (7, 6), (8, 8), (9, 8)} and len(found) == 4
    kept = decontaminate.keep_clean(odd_documents, items)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 10, 11]
    assert decontaminate.keep_clean(odd_documents, items.where("false")).count() == 13
    assert decontaminate.find_items(no_documents, items).count() == 0


def test_packing(odd_documents, no_documents):
    rows = packing.pack_documents(odd_documents, TOKENIZER).collect()
    lengths = {r["doc_id"]: r["length"] for r in rows if r["doc_id"] in (1, 2)}
    assert lengths == {1: 1, 2: 1} and {r["doc_id"] for r in rows} == {None, *range(1, 12)}
    assert packing.pack_documents(no_documents, TOKENIZER).count() == 0


def test_toxicity(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(None, 1), (3, None)],
                                   "doc_id long, toxic int")
    model = toxicity.train(odd_documents, labels)
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.train(no_documents, labels.where("false")) is None
    assert toxicity.score(no_documents, None).count() == 0


def test_warc_and_urls(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (2, "x://h/p", "y" * 120, None),
                                   (2, "x://h/p", "y" * 120, None), (3, "x://h/p", "y" * 120, None),
                                   (None, "x://h", "z", None)],
                                  "page_id long, url string, html string, file string")
    back = warc.round_trip(spark, pages).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in back) == [
        (1, "response"), (2, "response"), (2, "response"), (3, "revisit")]
    assert warc.round_trip(spark, pages.where("false")).count() == 0
    rules = urls.rules_table(spark, [("block", "h/p"), ("block", None)])
    assert urls.match(pages, rules).count() == 5
    assert urls.match(pages, rules.where("false")).where("verdict = 'allow'").count() == 5
    assert urls.match(pages.where("false"), rules).count() == 0


def test_tools(spark):
    calls = spark.createDataFrame([], "conv_id long, call_id string, turn long, name string, "
                                      "arguments string, uses array<string>, value string")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    schemas = spark.createDataFrame([], "name string, param string, type string, required boolean")
    assert tools.link(calls, results, schemas).count() == 0


def test_pipeline_stages(spark, odd_documents, no_documents):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_documents, "/root/testdata/sf0.001")
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert out.where(F.col("doc_id") == 4).count() == 2, name
        assert stage(spark, no_documents, "/root/testdata/sf0.001").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, no_documents, "/root/testdata/sf0.001").count() == 0
