"""Relational and dashboard queries (survey 2.I).

Latest-row selection is written as aggregates, not as a window per student:
a window partitioned by student would put a student holding a third of all
predictions into one task, while ``max``/``max_by`` aggregate partially on the
map side. The "keep ties" form joins back on (student, max timestamp), which
spreads a hot student's rows across the join by timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import first_words, np_round
from .clean import normalised_label
from .ordered import first_rows


def latest_with_ties(preds: DataFrame, key: str = cfg.ID_COLUMN, ts: str = "predicted_at") -> DataFrame:
    """Rows at their key's newest timestamp; equal newest timestamps all kept."""
    newest = preds.groupBy(key).agg(F.max(ts).alias("_newest"))
    return preds.join(newest, (preds[key] == newest[key]) & (preds[ts] == newest["_newest"]), "left_semi")


def latest_one(preds: DataFrame, key: str = cfg.ID_COLUMN, ts: str = "predicted_at",
               tiebreak: str = "id") -> DataFrame:
    """Exactly one newest row per key; ties on the timestamp go to the larger ``tiebreak``."""
    return first_rows(preds, key, ts, last=True, tiebreak=tiebreak).select(key, *[c for c in preds.columns if c != key])


def student_predictions(students: DataFrame, preds: DataFrame) -> DataFrame:
    """I1 (``v_student_predictions``): every student with its latest prediction(s), LEFT JOIN."""
    s = students.select("student_id", "name", "department", "attendance_percentage", "midterm_marks",
                        F.col("result").alias("actual_result"))
    p = latest_with_ties(preds).select("student_id", "predicted_result", "risk_level", "risk_score",
                                       "confidence", "predicted_at")
    return s.join(p, "student_id", "left")


def risk_summary(preds: DataFrame) -> DataFrame:
    """I2 (``v_risk_summary``): count and average risk score per level of each student's latest row."""
    narrow = preds.select("student_id", "predicted_at", "id", "risk_level", "risk_score")
    return latest_one(narrow).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("student_count"), np_round(F.avg("risk_score"), 2).alias("avg_risk_score"))


def dashboard_stats(students: DataFrame) -> DataFrame:
    """Total, average attendance (2 dp, NULL -> 0), pass and fail counts (SQL NULL on no rows)."""
    lbl = normalised_label("result")
    return students.agg(
        F.count(F.lit(1)).alias("total_students"),
        F.coalesce(np_round(F.avg("attendance_percentage"), 2), F.lit(0.0)).alias("avg_attendance"),
        F.sum((lbl == "Pass").cast("int")).cast("bigint").alias("pass_count"),
        F.sum((lbl == "Fail").cast("int")).cast("bigint").alias("fail_count"),
    )


def high_risk_ever(preds: DataFrame) -> DataFrame:
    """I4: distinct students with any High Risk prediction (whole history)."""
    return preds.filter(F.col("risk_level") == cfg.RISK_LABEL_HIGH).agg(
        F.count_distinct("student_id").alias("high_risk_count"))


def prediction_history(preds: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """I5 for every student at once: history newest first with its position.

    Time is cut into buckets. The counts per (student, bucket), aggregated before the shuffle, say how many
    predictions lie in later buckets; inside a bucket a rank over (student, bucket) does the rest. Only those counts and one shuffle of
    the predictions are needed, and a hot student spreads over its buckets."""
    b = F.floor(F.unix_micros(F.to_timestamp(F.col("predicted_at"))) / F.lit(bucket_seconds * 1_000_000)).cast("long")
    p = preds.withColumn("_bucket", b)
    later = Window.partitionBy("student_id").orderBy(F.col("_bucket").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = p.groupBy("student_id", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(F.col("student_id").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    met = p.join(offsets, F.col("student_id").eqNullSafe(F.col("_s")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy(F.col("predicted_at").desc(), F.col("id").desc()))
    return met.select(*preds.columns, (F.col("_later") + rank).alias("history_position"))


def recent_predictions(preds: DataFrame, n: int = cfg.RECENT_PREDICTIONS) -> DataFrame:
    """Newest ``n`` predictions (top-k: TakeOrderedAndProject, ties broken by id)."""
    return preds.orderBy(F.col("predicted_at").desc(), F.col("id").desc()).limit(n)


def kpi_row(scored: DataFrame) -> DataFrame:
    """Total, high-risk count and share (%), average attendance, predicted pass rate (%)."""
    hi = (F.col("risk_level") == cfg.RISK_LABEL_HIGH).cast("int")
    ps = (F.col("predicted_result") == "Pass").cast("int")
    return scored.agg(
        F.count(F.lit(1)).alias("total_students"),
        F.coalesce(F.sum(hi), F.lit(0)).cast("bigint").alias("high_risk_count"),
        np_round(F.avg(hi) * 100, 2).alias("high_risk_pct"),
        np_round(F.avg("attendance_percentage"), 2).alias("avg_attendance"),
        np_round(F.avg(ps) * 100, 2).alias("pass_rate_pct"),
    )


def attendance_histogram(scored: DataFrame, bins: int = cfg.HISTOGRAM_BINS, lo: float = 0.0,
                         hi: float = 100.0) -> DataFrame:
    """I8: equal-width bins over [lo, hi], out-of-range values in the edge bins, empty bins as 0."""
    width = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col("attendance_percentage") - lo) / width), F.lit(0)), F.lit(bins - 1))
    counts = scored.where(F.col("attendance_percentage").isNotNull()).groupBy(b.cast("int").alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))
    grid = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count"))


def below_threshold(scored: DataFrame, threshold: float = cfg.HISTOGRAM_THRESHOLD) -> DataFrame:
    """I8 companion: students under the attendance threshold line."""
    return scored.agg(F.count_if(F.col("attendance_percentage") < threshold).alias("below_threshold"),
                      F.count_if(F.col("attendance_percentage").isNotNull()).alias("with_attendance"))


def risk_distribution(scored: DataFrame) -> DataFrame:
    """I9."""
    return scored.groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))


def attendance_midterm_points(scored: DataFrame) -> DataFrame:
    """The scatter point set."""
    return scored.select("student_id", "attendance_percentage", "midterm_marks", "risk_level")


def attendance_midterm_grid(scored: DataFrame, cell: float = 5.0) -> DataFrame:
    """I10 at scale: counts on a cell x cell grid per risk level instead of raw points."""
    return scored.where(F.col("attendance_percentage").isNotNull() & F.col("midterm_marks").isNotNull()) \
        .groupBy(F.floor(F.col("attendance_percentage") / cell).cast("int").alias("attendance_cell"),
                 F.floor(F.col("midterm_marks") / cell).cast("int").alias("midterm_cell"), "risk_level") \
        .agg(F.count(F.lit(1)).alias("count"))


def department_pass_rate(scored: DataFrame) -> DataFrame:
    """Predicted pass rate (%) per department plus the first two words as a short name."""
    ps = (F.col("predicted_result") == "Pass").cast("int")
    return scored.groupBy("department").agg(np_round(F.avg(ps) * 100, 2).alias("pass_rate_pct")) \
        .withColumn("short_name", first_words(F.col("department").cast("string"), 2))


def high_risk_table(scored: DataFrame) -> DataFrame:
    """High Risk students, seven columns, highest risk first (ties by id)."""
    cols = ["student_id", "name", "department", "attendance_percentage", "midterm_marks", "risk_score",
            "predicted_result"]
    return scored.filter(F.col("risk_level") == cfg.RISK_LABEL_HIGH).select(*cols) \
        .orderBy(F.col("risk_score").desc(), F.col("student_id"))
