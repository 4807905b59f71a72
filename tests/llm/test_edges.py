"""Nulls, empty tables, repeated rows and columns with clashing names: the fits, and every stage of the pipeline."""

from __future__ import annotations

import pytest

import corpus_pipeline
from elutra.llm import langid, near_copies, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "score double, x string, key long, component_id string, node int, rows int, _quality_statistics string, leaking_key long, fp long, token_ids string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with every odd case, and the tables beside them."""
    sf, small = tmp_path_factory.mktemp("edges"), "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    odd = [(None, "no id " * 40), (None, None), (90_001, None), (90_002, ""), (90_003, "word " * 60_000), (90_004, "Ünïcode 日本 🙂 " * 9), (90_005, None), (90_004, "Ünïcode 日本 🙂 " * 9)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], SCHEMA)
    docs.unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")).write.parquet(f"{sf}/documents.parquet")
    return str(sf)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, tables, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = run(spark, docs, tables)
    last = stage == corpus_pipeline.STAGES[-1][0]
    assert last or got.columns == docs.columns
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert 0 < len(ids) <= docs.count()
    if stage == "near_dedup":
        assert ids.count(90_004) == 1 and ids.count(None) == 2 and 90_001 in ids and 90_002 not in ids and 90_005 not in ids
    if stage in ("decontamination", "bpe"):
        assert ids.count(90_004) == 2 and ids.count(None) == 2 and {90_001, 90_002, 90_003, 90_005} <= set(ids)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_no_rows(spark, tables, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, spark.createDataFrame([], SCHEMA), tables).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_of_any_name(spark, tables, stage):
    docs = spark.createDataFrame([(k, f"some plain text number {k} " * 9, 0.5, "x", 7, "c", 1, 2, "q", 3, 4, "t") for k in range(6)], f"doc_id long, text string, {CLASHING}")
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, tables)
    assert got.columns == docs.columns
    assert [tuple(r)[2:] for r in got.collect()] == [(0.5, "x", 7, "c", 1, 2, "q", 3, 4, "t")] * got.count()


def test_fits_take_one_text_of_a_document(spark):
    """A doc_id of many rows counts once: the models are those of the table without repeats."""
    texts = [(k, ("vile words " if k % 3 == 0 else "kind words ") * (k % 7 + 2) + f"{'!!!! ' * (k % 3)}") for k in range(120)]
    once = spark.createDataFrame(texts, "doc_id long, text string")
    many = once.unionByName(spark.createDataFrame([texts[3]] * 400, "doc_id long, text string"))
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 != 0)) for k in range(120)], "doc_id long, toxic int, quality int")
    assert toxicity.fit(once, labels) == toxicity.fit(many, labels)
    assert quality.fit(once, labels) == quality.fit(many, labels)
    lang = lambda df: langid.fit(df.selectExpr("*", "if(doc_id % 3 = 0, 'a', 'b') AS lang"))
    assert (lang(once).prototypes == lang(many).prototypes).all()


def test_near_copies_of_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (2, "A B c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in near_copies.keep_one(df).collect()) == [(False, 2), (True, None), (True, None)]
