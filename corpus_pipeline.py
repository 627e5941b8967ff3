"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. Rows with a null doc_id pass every filter; null texts are
scored, deduplicated and packed as empty ones; rows of one doc_id stay or go together, also where their
texts differ; repeated rows stay repeated; other columns are not kept; an empty table stays empty
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import decontaminate, line_dedup, near_dedup, packing, quality
from riskspark.llm.common import keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: near-duplicates from this similarity of five-word shingles, in per cent
NEAR_PERCENT = 80


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    return _without(docs, quality.query(docs, table(spark, sf_dir, "labels")).filter("predicted = 0"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows leave the texts; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.size("_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return _without(docs, near_dedup.near_duplicates(docs, percent=NEAR_PERCENT).filter("not kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return _without(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", lines_once),
    ("near dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: the classifier's scores and the token ids have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage but the last is written once to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
