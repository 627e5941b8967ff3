"""Alerts and report datasets (survey 2.J): the data behind e-mails and PDFs.

Transport (SMTP) and layout (PDF) are not rebuilt; the worklist, the alert log
and the nested per-student report rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from .recommend import recommendation_array

DEFAULT_RECIPIENT = "admin@college.edu"


def alert_subject(name="name", student_id="student_id") -> F.Column:
    """``🚨 HIGH RISK ALERT — {name} ({id})``; missing name 'Student', missing id 'N/A'."""
    return F.concat(F.lit(cfg.ALERT_SUBJECT_PREFIX), F.coalesce(F.col(name), F.lit("Student")), F.lit(" ("),
                    F.coalesce(F.col(student_id), F.lit("N/A")), F.lit(")"))


def alert_worklist(scored: DataFrame, recipient: str = DEFAULT_RECIPIENT) -> DataFrame:
    """High Risk students -> alert rows (status pending) with the e-mail's payload fields."""
    hi = scored.filter(F.col("risk_level") == cfg.RISK_LABEL_HIGH)
    return hi.select(
        "student_id",
        F.lit(cfg.ALERT_TYPE).alias("alert_type"),
        F.lit(recipient).alias("sent_to"),
        F.lit("pending").alias("status"),
        alert_subject().alias("subject"),
        F.coalesce(F.col("name"), F.lit("N/A")).alias("name"),
        F.coalesce(F.col("department").cast("string"), F.lit("N/A")).alias("department"),
        "attendance_percentage", "midterm_marks", "risk_level", "risk_score", "predicted_result", "confidence",
    )


def alert_outcomes(log: DataFrame) -> DataFrame:
    """Count per status (sent / failed / pending: zero when absent; other values keep their rows)."""
    counts = log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    grid = log.sparkSession.createDataFrame([(s,) for s in cfg.ALERT_STATUSES], "status string")
    return grid.withColumnRenamed("status", "known").join(counts, F.col("known").eqNullSafe(F.col("status")), "full").select(
        F.coalesce("status", "known").alias("status"), F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def report_rows(scored: DataFrame, risk_col: str = "risk_level") -> DataFrame:
    """One nested row per student: details, prediction and ordered recommendations."""
    details = F.struct(*[F.col(c) for c in ["student_id", "name", "gender", "age", "department",
                                            "attendance_percentage", "midterm_marks", "assignment_score",
                                            "quiz_score", "lab_score", "lms_activity"] if c in scored.columns])
    prediction = F.struct(*[F.col(c) for c in ["predicted_result", "risk_level", "risk_score", "confidence",
                                               "pass_probability", "fail_probability"] if c in scored.columns])
    return scored.select("student_id", F.col(risk_col).alias("report_risk_level"), details.alias("details"),
                         prediction.alias("prediction"),
                         recommendation_array(scored, risk_col).alias("recommendations"))


def write_reports(reports: DataFrame, path: str) -> None:
    """J3 sink: JSON per student, partitioned by risk level."""
    reports.write.mode("overwrite").partitionBy("report_risk_level").json(path)
