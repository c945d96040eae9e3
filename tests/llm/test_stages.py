"""Each stage of the pipeline on awkward rows, and the whole on an empty table."""

import os

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, f"some words of document {i} " * 6, "en", "ab"[i % 2], 10) for i in range(40)]
    rows += [(100, None, None, None, None), (100, None, None, None, None), (101, "", "en", "a", 0), (None, "no id here", "en", "b", 10), (102, "mail joe@x.org " * 3, "en", "a", 45), (103, "word " * 60_000, "en", "c", 300_000), (0, rows[0][1], "en", "a", 10)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(40)] + [(None, None, 1), (3, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_a_stage_takes_any_rows(spark, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = stage(spark, docs, tables)
    rows = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
    empty = stage(spark, docs.limit(0), tables)
    assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
    ids = [r.doc_id for r in rows]
    if name == "near_copies":
        assert ids.count(0) == 1 and ids.count(100) == 1 and ids.count(None) == 1 and {101, 102, 103} <= set(ids)
    if name == "personal_data":
        assert len(rows) == docs.count() and {r.text for r in rows if r.doc_id == 102} == {"mail [EMAIL] " * 3}
    if name == "packing":
        assert set(ids) == {r.doc_id for r in docs.collect()} and max(r.length for r in rows) == 2048


def test_stages_keep_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").selectExpr("*", "'x' AS key", "'y' AS taken", "'z' AS mark", "1 AS score", "2 AS n", "3 AS size", "4 AS length")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        assert {(r.key, r.taken, r.mark, r.score, r["n"], r["size"], r.length) for r in out.collect()} == {("x", "y", "z", 1, 2, 3, 4)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() > 0


def test_the_whole_run(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 0
    nothing = str(tmp_path / "none")
    os.makedirs(nothing)
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{nothing}/{t}.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0
