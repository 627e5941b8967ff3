"""Registered relational/dashboard queries (2.I) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as I
from . import common
from .sqlparts import DEDUP_SQL, LATEST_ONE_SQL, PREDICTIONS_SQL, STUDENTS_SQL, r, strip, cap, with_views

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


SCORED_SQL = """
scored AS (
  SELECT d.student_id, d.name, d.department, d.attendance_percentage, d.midterm_marks,
         l.risk_level, l.risk_score, l.predicted_result, l.confidence, l.fail_probability, l.pass_probability
  FROM dedup d JOIN latest_one l ON l.student_id = d.student_id)"""

_SCORED_VIEWS = (STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, LATEST_ONE_SQL, SCORED_SQL)


SCORED_STUDENT_COLS = ("name", "department", "attendance_percentage", "midterm_marks")


def scored(spark, sf_dir, student_cols=SCORED_STUDENT_COLS):
    """Each student (first copy) with the latest prediction: the dashboards' scored table.

    ``student_cols`` narrows the student side to what a query reads; without
    ``midterm_marks`` the line-item tables are not scanned at all.
    """
    d = common.first_students(spark, sf_dir, list(student_cols))
    keep = ["student_id", "predicted_at", "id", "risk_level", "risk_score", "predicted_result", "confidence",
            "fail_probability", "pass_probability"]
    latest = I.latest_one(common.predictions(spark, sf_dir).select(*keep))
    return d.select("student_id", *student_cols).join(
        latest.select("student_id", "risk_level", "risk_score", "predicted_result", "confidence",
                      "fail_probability", "pass_probability"), "student_id")


@register("i1_student_predictions", with_views("""
SELECT s.student_id, s.name, s.department, s.attendance_percentage, s.midterm_marks, s.result AS actual_result,
       p.predicted_result, p.risk_level, p.risk_score, p.confidence, p.predicted_at
FROM students s
LEFT JOIN (
    SELECT * FROM (SELECT *, RANK() OVER (PARTITION BY student_id ORDER BY predicted_at DESC) AS age FROM predictions) WHERE age = 1
) p ON s.student_id = p.student_id""", STUDENTS_SQL, PREDICTIONS_SQL))
def i1_student_predictions(spark, sf_dir):
    return I.student_predictions(common.students(spark, sf_dir), common.predictions(spark, sf_dir))


@register("i2_risk_summary", with_views(f"""
SELECT risk_level, CAST(COUNT(*) AS BIGINT) AS student_count, {r('AVG(risk_score)', 2)} AS avg_risk_score
FROM latest_one GROUP BY risk_level""", STUDENTS_SQL, PREDICTIONS_SQL, LATEST_ONE_SQL))
def i2_risk_summary(spark, sf_dir):
    return I.risk_summary(common.predictions(spark, sf_dir))


@register("i3_dashboard_stats", with_views(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_students,
       COALESCE({r('AVG(attendance_percentage)', 2)}, 0.0) AS avg_attendance,
       CAST(SUM(CASE WHEN {cap(strip('result'))} = 'Pass' THEN 1 ELSE 0 END) AS BIGINT) AS pass_count,
       CAST(SUM(CASE WHEN {cap(strip('result'))} = 'Fail' THEN 1 ELSE 0 END) AS BIGINT) AS fail_count
FROM dedup""", STUDENTS_SQL, DEDUP_SQL))
def i3_dashboard_stats(spark, sf_dir):
    return I.dashboard_stats(common.first_students(spark, sf_dir, ["attendance_percentage", "result"]))


@register("i4_high_risk_ever", with_views("""
SELECT CAST(COUNT(DISTINCT student_id) AS BIGINT) AS high_risk_count FROM predictions WHERE risk_level = 'High Risk'""",
    PREDICTIONS_SQL))
def i4_high_risk_ever(spark, sf_dir):
    return I.high_risk_ever(common.predictions(spark, sf_dir))


@register("i5_prediction_history", with_views("""
SELECT *, ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY predicted_at DESC, id DESC) AS history_position
FROM predictions""", PREDICTIONS_SQL))
def i5_prediction_history(spark, sf_dir):
    return I.prediction_history(common.predictions(spark, sf_dir))


@register("i6_recent_predictions", with_views("""
SELECT * FROM predictions ORDER BY predicted_at DESC, id DESC LIMIT 500""", PREDICTIONS_SQL))
def i6_recent_predictions(spark, sf_dir):
    return I.recent_predictions(common.predictions(spark, sf_dir))


@register("i7_kpi_row", with_views(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_students,
       CAST(COALESCE(SUM(CASE WHEN risk_level = 'High Risk' THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_risk_count,
       {r("AVG(CASE WHEN risk_level = 'High Risk' THEN 1 ELSE 0 END) * 100", 2)} AS high_risk_pct,
       {r('AVG(attendance_percentage)', 2)} AS avg_attendance,
       {r("AVG(CASE WHEN predicted_result = 'Pass' THEN 1 ELSE 0 END) * 100", 2)} AS pass_rate_pct
FROM scored""", *_SCORED_VIEWS))
def i7_kpi_row(spark, sf_dir):
    return I.kpi_row(scored(spark, sf_dir, ["attendance_percentage"]))


@register("i8_attendance_histogram", with_views("""
WITH counts AS (
  SELECT CAST(LEAST(GREATEST(FLOOR(attendance_percentage / 5.0), 0), 19) AS INTEGER) AS bin, COUNT(*) AS n
  FROM scored WHERE attendance_percentage IS NOT NULL GROUP BY 1),
grid AS (SELECT CAST(i AS INTEGER) AS bin FROM range(20) t(i))
SELECT g.bin, 0.0E0 + g.bin * 5.0E0 AS bin_start, 0.0E0 + (g.bin + 1) * 5.0E0 AS bin_end,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN counts c ON c.bin = g.bin""", *_SCORED_VIEWS))
def i8_attendance_histogram(spark, sf_dir):
    return I.attendance_histogram(scored(spark, sf_dir, ["attendance_percentage"]))


@register("i8_below_threshold", with_views("""
SELECT CAST(COUNT(*) FILTER (WHERE attendance_percentage < 75) AS BIGINT) AS below_threshold,
       CAST(COUNT(*) FILTER (WHERE attendance_percentage IS NOT NULL) AS BIGINT) AS with_attendance
FROM scored""", *_SCORED_VIEWS))
def i8_below_threshold(spark, sf_dir):
    return I.below_threshold(scored(spark, sf_dir, ["attendance_percentage"]))


@register("i9_risk_distribution", with_views(
    "SELECT risk_level, CAST(COUNT(*) AS BIGINT) AS count FROM scored GROUP BY risk_level", *_SCORED_VIEWS))
def i9_risk_distribution(spark, sf_dir):
    return I.risk_distribution(scored(spark, sf_dir, []))


@register("i10_attendance_midterm_points", with_views(
    "SELECT student_id, attendance_percentage, midterm_marks, risk_level FROM scored", *_SCORED_VIEWS))
def i10_attendance_midterm_points(spark, sf_dir):
    return I.attendance_midterm_points(scored(spark, sf_dir))


@register("i10_attendance_midterm_grid", with_views("""
SELECT CAST(FLOOR(attendance_percentage / 5.0) AS INTEGER) AS attendance_cell,
       CAST(FLOOR(midterm_marks / 5.0) AS INTEGER) AS midterm_cell, risk_level, CAST(COUNT(*) AS BIGINT) AS count
FROM scored WHERE attendance_percentage IS NOT NULL AND midterm_marks IS NOT NULL GROUP BY 1, 2, 3""",
    *_SCORED_VIEWS))
def i10_attendance_midterm_grid(spark, sf_dir):
    return I.attendance_midterm_grid(scored(spark, sf_dir))


@register("i11_department_pass_rate", with_views(f"""
SELECT department, {r("AVG(CASE WHEN predicted_result = 'Pass' THEN 1 ELSE 0 END) * 100", 2)} AS pass_rate_pct,
       array_to_string(list_slice(regexp_split_to_array({strip('department')}, '\\s+'), 1, 2), ' ') AS short_name
FROM scored GROUP BY department""", *_SCORED_VIEWS))
def i11_department_pass_rate(spark, sf_dir):
    return I.department_pass_rate(scored(spark, sf_dir, ["department"]))


@register("i12_high_risk_table", with_views("""
SELECT student_id, name, department, attendance_percentage, midterm_marks, risk_score, predicted_result
FROM scored WHERE risk_level = 'High Risk' ORDER BY risk_score DESC, student_id""", *_SCORED_VIEWS))
def i12_high_risk_table(spark, sf_dir):
    return I.high_risk_table(scored(spark, sf_dir))
