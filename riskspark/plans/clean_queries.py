"""Registered queries for cleaning (2.B) and features (2.C), with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as cfg
from ..operators import clean as B
from ..operators import features as C
from ..operators import models as D
from . import common
from .common import r2, r6
from .sqlparts import CLEAN_SQL, DEDUP_SQL, FEATURES_SQL, PREDICTIONS_SQL, STUDENTS_SQL, cap, clipx, features_of, r, strip, with_views

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# -- minimum slice: clean -> features -> summary per attendance band -------------

@register("c_attendance_band_summary", with_views("""
SELECT attendance_risk, CAST(COUNT(*) AS BIGINT) AS n_students,
       """ + r("AVG(overall_academic_score)", 2) + """ AS avg_overall_score
FROM features GROUP BY attendance_risk""", STUDENTS_SQL, CLEAN_SQL, FEATURES_SQL))
def c_attendance_band_summary(spark, sf_dir):
    f = common.featured(spark, sf_dir)
    return f.groupBy("attendance_risk").agg(
        F.count(F.lit(1)).alias("n_students"), r2(F.avg("overall_academic_score")).alias("avg_overall_score"))


_NUM = cfg.NUMERIC_FEATURES
_RAW_COLS = ["row_ordinal", "student_id", "name", "gender", "age", "department", "attendance_percentage",
             "assignment_score", "quiz_score", "lab_score", "midterm_marks", "lms_activity",
             "videos_watched", "discussion_participation", "result"]


@register("b1_standardise_columns", with_views("SELECT * FROM students", STUDENTS_SQL))
def b1_standardise_columns(spark, sf_dir):
    """Messy headers (upper case, spaces, padding) -> contract names."""
    s = common.students(spark, sf_dir)
    messy = s.toDF(*[f"  {c.replace('_', ' ').upper()} " for c in s.columns])
    return B.standardise_columns(messy)


@register("b2_missing_columns", with_views("""
SELECT position, missing_column, COUNT(*) AS n_rows
FROM (VALUES (0, 'age'), (1, 'lab_score')) t(position, missing_column), students GROUP BY position, missing_column""", STUDENTS_SQL))
def b2_missing_columns(spark, sf_dir):
    """The required columns that a table lacks, in contract order, and how many rows that holds up."""
    df = common.students(spark, sf_dir).drop("lab_score", "age")
    _, missing = B.check_required(df)
    at = F.posexplode(F.array(*[F.lit(c) for c in missing])).alias("position", "missing_column")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(at, "n_rows")


@register("b12_drop_target", with_views("SELECT * EXCLUDE (result) FROM students", STUDENTS_SQL))
def b12_drop_target(spark, sf_dir):
    return B.drop_target(common.students(spark, sf_dir))


@register("b3_dedup_first", with_views("SELECT * FROM dedup", STUDENTS_SQL, DEDUP_SQL))
def b3_dedup_first(spark, sf_dir):
    return B.dedup_first(common.students(spark, sf_dir))


@register("b4_median_values", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, median(CAST({c} AS DOUBLE)) AS median_value FROM dedup" for c in _NUM),
    STUDENTS_SQL, DEDUP_SQL))
def b4_median_values(spark, sf_dir):
    from ..operators.ordered import exact_quantile_frame
    d = B.dedup_first(common.students(spark, sf_dir))
    return exact_quantile_frame(d, _NUM, [0.5]).select(
        F.col("column").alias("column_name"), F.col("quantile").alias("median_value"))


@register("b4_median_impute", with_views(
    "SELECT row_ordinal, student_id, " + ", ".join(_NUM) + " FROM imputed", STUDENTS_SQL,
    CLEAN_SQL.split(",\ndict_gender")[0].rstrip(",")))
def b4_median_impute(spark, sf_dir):
    d = B.dedup_first(common.students(spark, sf_dir))
    state = B.fit_imputer(d)
    return B.impute(d, state).select("row_ordinal", "student_id", *_NUM)


@register("b5_mode_values", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (SELECT value FROM mode_{c}) AS mode_value" for c in cfg.CATEGORICAL_FEATURES),
    STUDENTS_SQL, CLEAN_SQL))
def b5_mode_values(spark, sf_dir):
    d = B.dedup_first(common.students(spark, sf_dir))
    modes = B.column_modes(d, cfg.CATEGORICAL_FEATURES)
    # modes were fitted distributed; present them as a frame over the fitted columns
    long = d.select(F.explode(F.array(*[F.lit(c) for c in cfg.CATEGORICAL_FEATURES])).alias("column_name")) \
        .distinct()
    m = F.create_map(*[x for c in cfg.CATEGORICAL_FEATURES for x in (F.lit(c), F.lit(modes.get(c)))])
    return long.select("column_name", m[F.col("column_name")].alias("mode_value"))


@register("b6_single_impute", with_views(
    "SELECT row_ordinal, student_id, COALESCE(gender, 'Unknown') AS gender, "
    "COALESCE(department, 'Unknown') AS department, "
    + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _NUM) + " FROM students",
    STUDENTS_SQL))
def b6_single_impute(spark, sf_dir):
    s = B.impute_single(common.students(spark, sf_dir))
    return s.select("row_ordinal", "student_id", "gender", "department", *_NUM)


@register("b7_clip", with_views(
    "SELECT row_ordinal, " + ", ".join(f"{clipx(c, *cfg.NUMERIC_RANGES[c])} AS {c}" for c in _NUM)
    + " FROM students", STUDENTS_SQL))
def b7_clip(spark, sf_dir):
    return B.cap_outliers(common.students(spark, sf_dir)).select("row_ordinal", *_NUM)


@register("b7_out_of_range_report", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({lo} AS DOUBLE) AS lower, CAST({hi} AS DOUBLE) AS upper, "
    f"CAST(COUNT(*) FILTER (WHERE {c} < {lo}) AS BIGINT) AS n_below, "
    f"CAST(COUNT(*) FILTER (WHERE {c} > {hi}) AS BIGINT) AS n_above FROM students"
    for c, (lo, hi) in cfg.NUMERIC_RANGES.items()), STUDENTS_SQL))
def b7_out_of_range_report(spark, sf_dir):
    return B.out_of_range_report(common.students(spark, sf_dir))


@register("b8_label_dictionary", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, value, code FROM dict_{c}" for c in cfg.CATEGORICAL_FEATURES),
    STUDENTS_SQL, CLEAN_SQL))
def b8_label_dictionary(spark, sf_dir):
    d = B.dedup_first(common.students(spark, sf_dir))
    imp = B.impute(d, B.fit_imputer(d))
    out = None
    for c in cfg.CATEGORICAL_FEATURES:
        part = B.fit_label_dictionary(imp, c).select(F.lit(c).alias("column_name"), "value", "code")
        out = part if out is None else out.unionByName(part)
    return out


@register("b9_label_apply_unseen", with_views("""WITH
fit AS (SELECT DISTINCT COALESCE(CAST(department AS VARCHAR), 'nan') AS value FROM students s
        WHERE EXISTS (SELECT 1 FROM predictions p WHERE p.student_id = s.student_id)),
dict AS (SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM fit)
SELECT s.row_ordinal, COALESCE(d.code, -1) AS department
FROM students s LEFT JOIN dict d ON d.value = COALESCE(CAST(s.department AS VARCHAR), 'nan')""",
    STUDENTS_SQL, PREDICTIONS_SQL))
def b9_label_apply_unseen(spark, sf_dir):
    """Dictionary fitted on students with a prediction, applied to every row; unseen -> -1."""
    s = common.students(spark, sf_dir)
    fit_rows = s.join(common.predictions(spark, sf_dir).select("student_id"), "student_id", "left_semi")
    dictionary = B.fit_label_dictionary(fit_rows, "department")
    return B.apply_label_dictionary(s, "department", dictionary).select("row_ordinal", "department")


@register("b10_target_encode", with_views(
    f"SELECT row_ordinal, CASE WHEN result IS NULL THEN 0 WHEN {cap(strip('result'))} = 'Pass' THEN 1 ELSE 0 END"
    " AS result FROM students", STUDENTS_SQL))
def b10_target_encode(spark, sf_dir):
    return B.encode_target(common.students(spark, sf_dir)).select("row_ordinal", "result")


_BATCH_NUM = [c for c in cfg.MODEL_FEATURES if c in _RAW_COLS]


@register("b11_batch_coerce", with_views("""WITH
dg AS (SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT COALESCE(gender, 'nan') AS value FROM students) t),
dd AS (SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT COALESCE(department, 'nan') AS value FROM students) t)
SELECT s.row_ordinal, dg.code AS gender, dd.code AS department, """
    + ", ".join(f"COALESCE(CAST(s.{c} AS DOUBLE), 0.0) AS {c}" for c in _BATCH_NUM) + """
FROM students s JOIN dg ON dg.value = COALESCE(s.gender, 'nan') JOIN dd ON dd.value = COALESCE(s.department, 'nan')""",
    STUDENTS_SQL))
def b11_batch_coerce(spark, sf_dir):
    b = B.clean_batch(common.students(spark, sf_dir))
    return b.select("row_ordinal", "gender", "department", *_BATCH_NUM)


@register("b13_feature_matrix", with_views(
    "SELECT student_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cfg.MODEL_FEATURES) + " FROM features",
    STUDENTS_SQL, CLEAN_SQL, FEATURES_SQL))
def b13_feature_matrix(spark, sf_dir):
    return B.select_features(common.featured(spark, sf_dir), keep=["student_id"])


# -- D2: standalone standardiser (population sd), fitted on the feature matrix --------

_MF = cfg.MODEL_FEATURES
_FM_SQL = ("fm AS (SELECT student_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MF)
           + " FROM features)")
_ST_SQL = ("st AS (SELECT " + ", ".join(
    f"AVG({c}) AS m_{c}, CASE WHEN STDDEV_POP({c}) IS NULL OR STDDEV_POP({c}) = 0 THEN 1.0E0 "
    f"ELSE STDDEV_POP({c}) END AS s_{c}" for c in _MF) + " FROM fm)")
_D2_VIEWS = (STUDENTS_SQL, CLEAN_SQL, FEATURES_SQL, _FM_SQL, _ST_SQL)


def _standardiser(spark, sf_dir):
    fm = B.select_features(common.featured(spark, sf_dir), keep=["student_id"])
    return fm, D.fit_standardiser(fm, _MF)


@register("d2_scaler_params", with_views(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, {r(f'm_{c}', 6)} AS mean, {r(f's_{c}', 6)} AS scale FROM st"
    for i, c in enumerate(_MF)), *_D2_VIEWS))
def d2_scaler_params(spark, sf_dir):
    """The fitted standalone scaler as (position, feature, mean, scale)."""
    _, st = _standardiser(spark, sf_dir)
    return st.frame(spark).select("position", "feature", r6("mean").alias("mean"), r6("scale").alias("scale"))


@register("d2_standardise", with_views(
    "SELECT fm.student_id, " + ", ".join(f"{r(f'(fm.{c} - st.m_{c}) / st.s_{c}', 6)} AS {c}" for c in _MF)
    + " FROM fm, st", *_D2_VIEWS))
def d2_standardise(spark, sf_dir):
    """Every student's feature vector centred and divided by the population sd."""
    fm, st = _standardiser(spark, sf_dir)
    z = D.standardise(fm, st)
    return z.select("student_id", *[r6(c).alias(c) for c in _MF])


@register("b13_feature_matrix_absent", with_views(
    "SELECT student_id, " + ", ".join(
        ("0.0E0" if c in ("age", "lab_score") else f"CAST({c} AS DOUBLE)") + f" AS {c}" for c in cfg.MODEL_FEATURES)
    + " FROM features", STUDENTS_SQL, CLEAN_SQL, FEATURES_SQL))
def b13_feature_matrix_absent(spark, sf_dir):
    """Absent optional columns (age, lab_score) read as 0.0."""
    f = common.featured(spark, sf_dir).drop("age", "lab_score")
    return B.select_features(f, keep=["student_id"])


@register("b14_drop_incomplete", with_views(
    "SELECT row_ordinal, student_id FROM students WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _BATCH_NUM + ["result"]), STUDENTS_SQL))
def b14_drop_incomplete(spark, sf_dir):
    s = common.students(spark, sf_dir)
    return B.drop_incomplete(s, _BATCH_NUM + ["result"]).select("row_ordinal", "student_id")


@register("b15_class_distribution", with_views(
    "SELECT result, CAST(COUNT(*) AS BIGINT) AS count FROM clean GROUP BY result", STUDENTS_SQL, CLEAN_SQL))
def b15_class_distribution(spark, sf_dir):
    return B.value_counts(common.cleaned(spark, sf_dir), "result")


@register("b_clean_fit_table", with_views("SELECT * FROM clean", STUDENTS_SQL, CLEAN_SQL))
def b_clean_fit_table(spark, sf_dir):
    """Whole training-mode cleaning."""
    return common.cleaned(spark, sf_dir)


@register("b_clean_single_table", with_views(
    "SELECT row_ordinal, student_id, name, -1 AS gender, -1 AS department, "
    + ", ".join(f"{clipx(f'COALESCE(CAST({c} AS DOUBLE), 0.0)', *cfg.NUMERIC_RANGES[c])} AS {c}" for c in _NUM)
    + ", result FROM students", STUDENTS_SQL))
def b_clean_single_table(spark, sf_dir):
    """Record-mode cleaning of every row (constants, clip, no encoder -> -1)."""
    return B.clean_single(common.students(spark, sf_dir))


# -- features ---------------------------------------------------------------

def _feature_query(name, col, expr_fn):
    @register(name, with_views(f"SELECT student_id, {col} FROM features", STUDENTS_SQL, CLEAN_SQL, FEATURES_SQL))
    def q(spark, sf_dir):
        c = common.cleaned(spark, sf_dir)
        return c.select("student_id", expr_fn(c).alias(col))
    q.__name__ = name
    return q


_feature_query("c1_attendance_risk", "attendance_risk", lambda c: C.attendance_risk())
_feature_query("c2_assignment_ratio", "assignment_completion_ratio", lambda c: C.assignment_completion_ratio())
_feature_query("c3_engagement_score", "engagement_score", lambda c: C.engagement_score())
_feature_query("c4_performance_trend", "performance_trend", lambda c: C.performance_trend())
_feature_query("c5_overall_score", "overall_academic_score", lambda c: C.overall_academic_score(c.columns))

_OVERALL_NO_LAB = " + ".join(["0.0E0"] + [f"{c} * {w}E0" for c, w in cfg.SCORE_WEIGHTS.items() if c != "lab_score"])


@register("c5_overall_score_absent_lab", with_views(
    f"SELECT student_id, {r(clipx(_OVERALL_NO_LAB, 0, 100), 2)} AS overall_academic_score FROM clean",
    STUDENTS_SQL, CLEAN_SQL))
def c5_overall_score_absent_lab(spark, sf_dir):
    """An absent weighted column is skipped; weights are not renormalised."""
    c = common.cleaned(spark, sf_dir).drop("lab_score")
    return c.select("student_id", C.overall_academic_score(c.columns).alias("overall_academic_score"))


@register("c_features_on_raw", with_views(
    "SELECT row_ordinal, " + ", ".join(cfg.ENGINEERED_FEATURES) + " FROM (" + features_of("students") + ") t", STUDENTS_SQL))
def c_features_on_raw(spark, sf_dir):
    """Features on uncleaned rows: NULL inputs give NULL (attendance band 0)."""
    return C.add_features(common.students(spark, sf_dir)).select("row_ordinal", *cfg.ENGINEERED_FEATURES)


_DESCRIBE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(COUNT({c}) AS BIGINT) AS count, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, "
    f"CAST(MIN({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM features"
    for c in cfg.ENGINEERED_FEATURES)


@register("c6_describe", with_views(
    "SELECT feature, count, " + ", ".join(f"{r(x, 4)} AS {x}" for x in ["mean", "std"])
    + ", min, " + ", ".join(f"{r(x, 4)} AS {x}" for x in ["p25", "p50", "p75"]) + ", max FROM ("
    + _DESCRIBE_SQL + ") d", STUDENTS_SQL, CLEAN_SQL, FEATURES_SQL))
def c6_describe(spark, sf_dir):
    d = C.describe_features(common.featured(spark, sf_dir))
    return d.select("feature", "count", *[common.r4(x).alias(x) for x in ["mean", "std"]], "min",
                    *[common.r4(x).alias(x) for x in ["p25", "p50", "p75"]], "max")


_AXES_SQL = " UNION ALL ".join(
    f"SELECT student_id, {i} AS axis_no, '{label}' AS axis, "
    + (f"LEAST(COALESCE(CAST({col} AS DOUBLE), 0.0) / 60 * 100, 100.0)" if col == "videos_watched"
       else f"COALESCE(CAST({col} AS DOUBLE), 0.0)")
    + f" AS value, CAST({cfg.PROFILE_TARGET} AS DOUBLE) AS target FROM students"
    for i, (label, col) in enumerate(cfg.PROFILE_AXES))


@register("c7_profile_axes", with_views(_AXES_SQL, STUDENTS_SQL))
def c7_profile_axes(spark, sf_dir):
    return C.profile_axes(common.students(spark, sf_dir))
