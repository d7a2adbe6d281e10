"""Registered queries of the llm package against DuckDB, and the pipeline against its stages."""

import pytest

import corpus_pipeline
import oracle
from doclake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    got = oracle.spark_rows(QUERIES[name](spark, SF))
    assert got[1], "no rows"
    assert oracle.difference(got, oracle.duck_rows(oracle.connect(SF), ORACLES[name])) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == before
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_near_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "en", "a", 1), (1, text + " more", "en", "a", 1), (2, "w1 w2", "de", "b", 1), (1, text + " more", "en", "a", 1), (None, text, "en", "a", 1), (7, None, "en", "a", 1), (8, "", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()), key=str)
    assert got == [1, 2, 7, 8, None]
