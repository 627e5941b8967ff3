"""Shared Spark-side building blocks of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import np_round
from ..operators.clean import clean_fit, dedup_first
from ..operators.features import add_features
from ..sources import fixtures


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.students(spark, sf_dir)


def first_students(spark: SparkSession, sf_dir: str, cols) -> DataFrame:
    """First row per student (B3) over only ``cols``: narrowing before the de-duplication lets
    the scans prune the line-item columns no one reads (``min_by`` over a struct of every
    column would keep them all)."""
    return dedup_first(students(spark, sf_dir).select("student_id", "row_ordinal", *cols))


def predictions(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    return fixtures.predictions(spark, sf_dir, full=full)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = clean_fit(students(spark, sf_dir))
    return df


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_features(cleaned(spark, sf_dir))


def r2(c) -> F.Column:
    return np_round(c, 2)


def r4(c) -> F.Column:
    return np_round(c, 4)


def r6(c) -> F.Column:
    return np_round(c, 6)
