"""Registered streaming queries (2.K): the student table arrives as files and is scored by a
Structured Streaming query; the result is read back from the stream's sink."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from .. import config as cfg
from ..operators import tables
from ..operators.clean import normalised_label
from ..operators.models import batch_score
from ..session import scratch_path
from ..streaming import run_stream, run_stream_to_tables, scoring_transform
from . import common
from .sqlparts import STUDENTS_SQL, cap, clipx, features_of, r, strip, with_views

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _arrivals(spark, sf_dir, rows_per_file: int = 50_000):
    """Land the student rows as several parquet files (the stream's input)."""
    src = common.students(spark, sf_dir)
    path = scratch_path(spark, "stream_in")
    src.write.option("maxRecordsPerFile", rows_per_file).parquet(path)   # as many files as the rows need
    return path, src.schema


_NUM = cfg.NUMERIC_FEATURES
_SINGLE_SQL = ("single AS (SELECT row_ordinal, student_id, name, "
               + ", ".join(f"{clipx(f'COALESCE(CAST({c} AS DOUBLE), 0.0)', *cfg.NUMERIC_RANGES[c])} AS {c}"
                           for c in _NUM) + " FROM students)")


@register("k1_stream_features", with_views(
    "SELECT row_ordinal, student_id, " + ", ".join(cfg.ENGINEERED_FEATURES) + " FROM ("
    + features_of("single") + ") t", STUDENTS_SQL, _SINGLE_SQL))
def k1_stream_features(spark, sf_dir):
    """Record-mode cleaning + features computed by a streaming query (no model)."""
    src, schema = _arrivals(spark, sf_dir)
    sink = run_stream(spark, src, schema).sink
    return spark.read.parquet(sink).select("row_ordinal", "student_id", *cfg.ENGINEERED_FEATURES)


@register("k1_stream_scoring")
def k1_stream_scoring(spark, sf_dir):
    """Full continuous scoring with the selected model: risk columns + recommendations."""
    from .ml_queries import trained
    res = trained(spark, sf_dir)
    src, schema = _arrivals(spark, sf_dir)
    sink = run_stream(spark, src, schema, model=res.models[res.best_name]).sink
    return spark.read.parquet(sink).select(
        "student_id", "predicted_result", "pass_probability", "fail_probability", "risk_score", "risk_level",
        "confidence", F.size("recommendations").alias("n_recommendations"))


class AttendanceRule:
    """Stands where a fitted model does: passes with the probability attendance / 100. Its scores have SQL."""

    def transform(self, df):
        p = F.col("attendance_percentage") / 100
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))


_RULE_SQL = f"""
ruled AS (SELECT student_id, {clipx("COALESCE(CAST(attendance_percentage AS DOUBLE), 0.0)", 0, 100)} / 100 AS p FROM students)"""


def _rule_scored_sql(source):
    """The scoring columns that follow from the pass probability ``p`` of ``source``."""
    return f"""
SELECT * EXCLUDE (p), CASE WHEN p > 1.0 - p THEN 'Pass' ELSE 'Fail' END AS predicted_result,
  {r("p", 4)} AS pass_probability, {r("1.0 - p", 4)} AS fail_probability, {r("(1.0 - p) * 100", 2)} AS risk_score,
  CASE WHEN 1.0 - p >= {cfg.RISK_HIGH} THEN '{cfg.RISK_LABEL_HIGH}' WHEN 1.0 - p >= {cfg.RISK_MEDIUM} THEN '{cfg.RISK_LABEL_MEDIUM}'
       ELSE '{cfg.RISK_LABEL_LOW}' END AS risk_level, {r("GREATEST(p, 1.0 - p) * 100", 2)} AS confidence
FROM {source}"""


@register("f1_rule_batch_scoring", with_views(_rule_scored_sql("ruled_batch"), STUDENTS_SQL, """
ruled_batch AS (SELECT *, COALESCE(CAST(attendance_percentage AS DOUBLE), 0.0) / 100 AS p FROM students)"""))
def f1_rule_batch_scoring(spark, sf_dir):
    """Batch mode (F1): raw columns as they came, six scoring columns that follow from the probability."""
    return batch_score(AttendanceRule(), common.students(spark, sf_dir))


@register("f5_record_scoring", with_views(_rule_scored_sql("ruled_record"), STUDENTS_SQL, f"""
ruled_record AS (SELECT 'UNKNOWN' AS student_id, 'Unknown' AS name, row_ordinal,
  {clipx("COALESCE(CAST(attendance_percentage AS DOUBLE), 0.0)", 0, 100)} AS attendance_percentage,
  {clipx("COALESCE(CAST(attendance_percentage AS DOUBLE), 0.0)", 0, 100)} / 100 AS p FROM students)"""))
def f5_record_scoring(spark, sf_dir):
    """Record mode (F5) on records without id and name: constants for gaps, capping, the same six columns."""
    out = scoring_transform(common.students(spark, sf_dir).drop("student_id", "name"), AttendanceRule())
    return out.select("student_id", "name", "row_ordinal", "attendance_percentage", "predicted_result", "pass_probability",
                      "fail_probability", "risk_score", "risk_level", "confidence")


@register("k1_stream_table", with_views(f"""
SELECT student_id, CASE WHEN p > 1.0 - p THEN 'Pass' ELSE 'Fail' END AS predicted_result,
  CASE WHEN 1.0 - p >= {cfg.RISK_HIGH} THEN '{cfg.RISK_LABEL_HIGH}' WHEN 1.0 - p >= {cfg.RISK_MEDIUM} THEN '{cfg.RISK_LABEL_MEDIUM}'
       ELSE '{cfg.RISK_LABEL_LOW}' END AS risk_level,
  {r("(1.0 - p) * 100", 2)} AS risk_score, {r("p", 4)} AS pass_probability, {r("1.0 - p", 4)} AS fail_probability,
  {r("GREATEST(p, 1.0 - p) * 100", 2)} AS confidence
FROM ruled WHERE student_id IN (SELECT student_id FROM students WHERE {cap(strip("result"))} IN ('Pass', 'Fail'))""", STUDENTS_SQL, _RULE_SQL))
def k1_stream_table(spark, sf_dir):
    """Arriving records scored into a kept log: contract and foreign key per batch, each batch once.
    The stream is started again over the same files under a new checkpoint, which runs its batches again: they add nothing."""
    src, schema = _arrivals(spark, sf_dir)
    path = scratch_path(spark, "stream_log")
    parent = common.students(spark, sf_dir).filter(normalised_label("result").isin("Pass", "Fail"))
    for _ in range(2):
        run_stream_to_tables(spark, src, schema, path, AttendanceRule(), parent)
    out = tables.read(spark, path).drop("id", "predicted_at")
    return out.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in out.dtypes])
