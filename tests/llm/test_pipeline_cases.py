"""Pipeline stages on nulls, empty and long texts, repeated rows and ids, clashing extra columns and empty tables."""

import pytest

import corpus_pipeline as cp
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n_lines int, removed string, score double, kept boolean"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", 0.5, False) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def clean(spark):
    """Texts that the given labels' classifier keeps, so that cases can be told from rejects."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = cp.without_benchmark(spark, cp.quality_filter(spark, docs, SF_SMALL), SF_SMALL)
    return [r.text for r in kept.orderBy("doc_id").limit(6).collect()]


def test_cases_go_through_every_stage(spark, clean):
    texts = [(1, clean[0]), (2, clean[1]), (2, clean[1]), (3, clean[2]), (3, clean[3]), (4, None), (5, ""), (None, clean[4]), (None, None), (6, clean[5] + "\n" + "word " * 50000)]
    docs = rows(spark, texts)
    for name, stage in cp.STAGES[1:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == cp.COLUMNS, name
        got = out.collect()
        assert {r.doc_id for r in got} >= {1, 3, 4, 5, None} and sum(r.doc_id is None for r in got) == 2, name
    judged = cp.quality_filter(spark, docs, SF_SMALL)
    assert judged.columns == cp.COLUMNS and sum(r.doc_id is None for r in judged.collect()) == 2
    packed = cp.packed(spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5, 6, None}


def test_rows_of_one_id_stay_or_go_together(spark, clean):
    near = clean[0].replace(" ", "  ", 3)
    got = cp.one_of_each(spark, rows(spark, [(1, clean[0]), (7, near), (7, clean[2])]), SF_SMALL).collect()
    assert [r.doc_id for r in got] == [1]  # both rows of 7 go with the copy


def test_empty_tables(spark):
    for name, stage in cp.STAGES:
        out = stage(spark, rows(spark, []), SF_SMALL)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == cp.COLUMNS
