"""SQL fragments for the DuckDB oracle: independent set-based formulations of the
operators, written as CTEs over the ``students`` / ``predictions`` views."""

from __future__ import annotations

from .. import config as cfg
from ..sources.fixtures import PREDICTIONS_SQL, STUDENTS_SQL, with_views

__all__ = ["PREDICTIONS_SQL", "STUDENTS_SQL", "with_views", "r", "strip", "cap", "clipx",
           "DEDUP_SQL", "CLEAN_SQL", "FEATURES_SQL", "LATEST_ONE_SQL", "features_of"]


def r(expr: str, n: int) -> str:
    """NumPy rounding (half to even after scaling)."""
    s = f"{10 ** n}.0"
    return f"(round_even(({expr}) * {s}, 0) / {s})"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def cap(expr: str) -> str:
    return f"(upper(substr({expr}, 1, 1)) || lower(substr({expr}, 2)))"


def clipx(expr: str, lo, hi) -> str:
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE LEAST(GREATEST(({expr}), {lo}), {hi}) END)"


DEDUP_SQL = """
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY row_ordinal) AS rn FROM students) t
  WHERE rn = 1)"""


def _mode_cte(col: str) -> str:
    return f"""
mode_{col} AS (
  SELECT value FROM (
    SELECT value, ROW_NUMBER() OVER (ORDER BY n DESC, value) AS k
    FROM (SELECT CAST({col} AS VARCHAR) AS value, COUNT(*) AS n FROM dedup WHERE {col} IS NOT NULL GROUP BY 1) c) m
  WHERE k = 1)"""


def _dict_cte(col: str) -> str:
    return f"""
dict_{col} AS (
  SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS value FROM imputed) d)"""


_NUM = cfg.NUMERIC_FEATURES
_med = ",\n    ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in _NUM)
_imp_num = ",\n    ".join(f"COALESCE(CAST(d.{c} AS DOUBLE), f.{c}) AS {c}" for c in _NUM)
_clip_num = ",\n    ".join(
    f"{clipx(c, *cfg.NUMERIC_RANGES[c])} AS {c}" for c in _NUM)

CLEAN_SQL = DEDUP_SQL + ",\n" + f"""
fills AS (
  SELECT {_med}
  FROM dedup),""" + ",".join(_mode_cte(c) for c in cfg.CATEGORICAL_FEATURES) + f""",
imputed AS (
  SELECT d.row_ordinal, d.student_id, d.name,
    COALESCE(d.gender, (SELECT value FROM mode_gender)) AS gender,
    COALESCE(d.department, (SELECT value FROM mode_department)) AS department,
    {_imp_num},
    d.result
  FROM dedup d, fills f),""" + ",".join(_dict_cte(c) for c in cfg.CATEGORICAL_FEATURES) + f""",
clean AS (
  SELECT i.row_ordinal, i.student_id, i.name,
    COALESCE(g.code, -1) AS gender,
    COALESCE(dp.code, -1) AS department,
    {_clip_num},
    CASE WHEN i.result IS NULL THEN 0 WHEN {cap(strip('i.result'))} = 'Pass' THEN 1 ELSE 0 END AS result
  FROM imputed i
  LEFT JOIN dict_gender g ON g.value = CAST(i.gender AS VARCHAR)
  LEFT JOIN dict_department dp ON dp.value = CAST(i.department AS VARCHAR))"""


def features_of(src: str) -> str:
    """Engineered feature expressions over a relation with the raw columns."""
    vid = clipx("videos_watched", 0, cfg.VIDEOS_CAP)
    disc = clipx("discussion_participation", 0, cfg.DISCUSSION_CAP)
    lms = clipx("lms_activity", 0, 100)
    overall = " + ".join(["0.0E0"] + [f"{c} * {w}E0" for c, w in cfg.SCORE_WEIGHTS.items()])
    return f"""
  SELECT *,
    CASE WHEN attendance_percentage >= {cfg.ATTENDANCE_HIGH} THEN 2
         WHEN attendance_percentage >= {cfg.ATTENDANCE_MEDIUM} THEN 1 ELSE 0 END AS attendance_risk,
    {r(clipx('assignment_score', 0, 100) + ' / 100', 4)} AS assignment_completion_ratio,
    {r(f'0.4E0 * {lms} + 0.3E0 * ({vid} / {cfg.VIDEOS_CAP} * 100) + 0.3E0 * ({disc} / {cfg.DISCUSSION_CAP} * 100)', 2)} AS engagement_score,
    {r('midterm_marks - (assignment_score + quiz_score) / 2', 2)} AS performance_trend,
    {r(clipx(overall, 0, 100), 2)} AS overall_academic_score
  FROM {src}"""


FEATURES_SQL = f"""
features AS ({features_of('clean')})"""

# Latest prediction per student, ties broken by the larger id (keeps exactly one).
LATEST_ONE_SQL = """
latest_one AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY predicted_at DESC, id DESC) AS rn
    FROM predictions) t WHERE rn = 1)"""
