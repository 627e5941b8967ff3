"""Registered source/sink and table-maintenance queries (2.A) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as cfg
from ..operators import analytics as I
from ..operators import outreach as J
from ..operators import store as A
from ..operators import tables
from ..operators.clean import dedup_first, normalised_label
from ..session import scratch_path
from ..sources import files, synth
from . import common
from .report_queries import SCORED_SQL, scored
from .sqlparts import DEDUP_SQL, LATEST_ONE_SQL, PREDICTIONS_SQL, STUDENTS_SQL, cap, strip, with_views

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("a1_a2_csv_roundtrip", with_views("SELECT * FROM students", STUDENTS_SQL))
def a1_a2_csv_roundtrip(spark, sf_dir):
    """Write the student table as CSV (A2) to the shared folder, read it back with the declared schema (A1)."""
    path = scratch_path(spark, "csv")
    files.write_csv(common.students(spark, sf_dir), path)
    return files.read_csv(spark, path)


@register("a1_messy_csv", with_views("""
SELECT row_ordinal, student_id, name, age, attendance_percentage, videos_watched, result,
       'seen by' || chr(10) || student_id || ', "twice"' AS class_remark
FROM students""", STUDENTS_SQL))
def a1_messy_csv(spark, sf_dir):
    """A file as people upload it (A1): spaced headers in any case, integers written as ``21.0``,
    a column outside the schema, line breaks and quotes inside a field."""
    path = scratch_path(spark, "csv")
    whole = lambda c: F.concat(F.col(c).cast("string"), F.lit(".0"))
    remark = F.concat(F.lit("seen by\n"), "student_id", F.lit(', "twice"'))
    files.write_csv(common.students(spark, sf_dir).select(
        F.col("row_ordinal").alias("Row Ordinal"), F.col("student_id").alias(" Student ID "), F.col("name").alias("NAME"),
        whole("age").alias("Age"), F.col("attendance_percentage").alias("Attendance Percentage"),
        whole("videos_watched").alias("Videos Watched"), F.col("result").alias("Result"), remark.alias("Class Remark")), path)
    return files.read_csv(spark, path)


@register("a3_scan_ordered", with_views("SELECT * FROM students ORDER BY student_id, row_ordinal", STUDENTS_SQL))
def a3_scan_ordered(spark, sf_dir):
    return A.scan_ordered(common.students(spark, sf_dir))


@register("a4_param_select", with_views(
    "SELECT student_id, attendance_percentage FROM students WHERE attendance_percentage < 75.0", STUDENTS_SQL))
def a4_param_select(spark, sf_dir):
    return A.select_with_params(
        spark, "SELECT student_id, attendance_percentage FROM {s} WHERE attendance_percentage < :threshold",
        {"threshold": 75.0}, s=common.students(spark, sf_dir))


@register("a5_lookup_first", with_views(
    "SELECT * FROM dedup WHERE student_id IN (SELECT student_id FROM predictions)",
    STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL))
def a5_lookup_first(spark, sf_dir):
    """Point lookups for every id that has a prediction: first row per id."""
    return A.lookup_first(common.students(spark, sf_dir), common.predictions(spark, sf_dir))


_UPSERT_SQL = """
existing AS (SELECT * FROM dedup WHERE student_id IN (SELECT student_id FROM predictions)),
lasts AS (SELECT * EXCLUDE (rn) FROM (SELECT student_id, name, attendance_percentage,
            ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY row_ordinal DESC) AS rn FROM students) t WHERE rn = 1),
cnt AS (SELECT student_id, COUNT(*) AS n FROM students GROUP BY 1),
upserted AS (
  SELECT CASE WHEN e.student_id IS NOT NULL THEN e.row_ordinal ELSE f.row_ordinal END AS row_ordinal,
    k.student_id,
    CASE WHEN l.student_id IS NOT NULL THEN l.name ELSE e.name END AS name,
    """ + ",\n    ".join(
    f"CASE WHEN e.student_id IS NOT NULL THEN e.{c} ELSE f.{c} END AS {c}" for c in
    ["gender", "age", "department"]) + """,
    CASE WHEN l.student_id IS NOT NULL THEN l.attendance_percentage ELSE e.attendance_percentage END
      AS attendance_percentage,
    """ + ",\n    ".join(
    f"CASE WHEN e.student_id IS NOT NULL THEN e.{c} ELSE f.{c} END AS {c}" for c in
    ["assignment_score", "quiz_score", "lab_score", "midterm_marks", "lms_activity", "videos_watched",
     "discussion_participation", "result"]) + """,
    CASE WHEN e.student_id IS NULL THEN 'inserted' WHEN l.student_id IS NULL THEN 'unchanged' ELSE 'updated' END
      AS _action,
    CAST(COALESCE(c.n, 0) AS BIGINT) AS _batch_rows
  FROM (SELECT student_id FROM existing UNION SELECT student_id FROM students) k
  LEFT JOIN existing e ON e.student_id = k.student_id
  LEFT JOIN dedup f ON f.student_id = k.student_id
  LEFT JOIN lasts l ON l.student_id = k.student_id
  LEFT JOIN cnt c ON c.student_id = k.student_id)"""
_UPSERT_VIEWS = (STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, _UPSERT_SQL)


def _upserted(spark, sf_dir):
    s = common.students(spark, sf_dir)
    existing = dedup_first(s).join(common.predictions(spark, sf_dir).select("student_id"), "student_id", "left_semi")
    return A.upsert(existing, s)


@register("a6_upsert_snapshot", with_views("SELECT * FROM upserted", *_UPSERT_VIEWS))
def a6_upsert_snapshot(spark, sf_dir):
    """Existing table = students with a prediction; batch = every student row in input order."""
    return _upserted(spark, sf_dir)


@register("a7_bulk_upsert_counts", with_views("""
SELECT _action, CAST(COUNT(*) AS BIGINT) AS keys, CAST(SUM(_batch_rows) AS BIGINT) AS batch_rows_accepted
FROM upserted GROUP BY _action""", *_UPSERT_VIEWS))
def a7_bulk_upsert_counts(spark, sf_dir):
    return A.upsert_counts(_upserted(spark, sf_dir))


@register("a9_fk_rejected", with_views(
    "SELECT * FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM students s WHERE s.student_id = p.student_id)",
    STUDENTS_SQL, PREDICTIONS_SQL))
def a9_fk_rejected(spark, sf_dir):
    return A.fk_rejected(common.predictions(spark, sf_dir), common.students(spark, sf_dir))


@register("a9_fk_accepted", with_views(
    "SELECT * FROM predictions p WHERE EXISTS (SELECT 1 FROM students s WHERE s.student_id = p.student_id)",
    STUDENTS_SQL, PREDICTIONS_SQL))
def a9_fk_accepted(spark, sf_dir):
    return A.fk_accepted(common.predictions(spark, sf_dir), common.students(spark, sf_dir))


@register("a9_cascade_delete", with_views(f"""
SELECT * FROM predictions p WHERE EXISTS (
  SELECT 1 FROM students s WHERE s.student_id = p.student_id AND {cap(strip('s.result'))} IN ('Pass', 'Fail'))""",
    STUDENTS_SQL, PREDICTIONS_SQL))
def a9_cascade_delete(spark, sf_dir):
    """Delete students without a usable label; their predictions go with them."""
    s = common.students(spark, sf_dir)
    kept = s.filter(normalised_label("result").isin("Pass", "Fail"))
    return A.cascade_delete(common.predictions(spark, sf_dir), kept)


_KEY_MAP_SQL = """
key_map AS (
  SELECT student_id AS old_key, CONCAT(UPPER(SUBSTR(department, 1, 3)), '-', student_id) AS new_key
  FROM dedup WHERE department IS NOT NULL)"""


@register("a9_cascade_rename", with_views("""
SELECT p.* REPLACE (COALESCE(k.new_key, p.student_id) AS student_id)
FROM predictions p LEFT JOIN key_map k ON k.old_key = p.student_id""",
    STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, _KEY_MAP_SQL))
def a9_cascade_rename(spark, sf_dir):
    """Students with a known department are re-keyed to ``DEP-<id>``; the whole prediction
    history follows through the key map (one row per old key), other keys stay."""
    first = common.first_students(spark, sf_dir, ["department"]).where(F.col("department").isNotNull())
    key_map = first.select(F.col("student_id").alias("old_key"),
                           F.concat(F.upper(F.substring("department", 1, 3)), F.lit("-"),
                                    F.col("student_id")).alias("new_key"))
    return A.cascade_rename(common.predictions(spark, sf_dir), key_map)


def _dec_sql(c, r):
    # half-up rounding of the value's shortest decimal form; overflow -> NULL
    src = f"COALESCE(CAST({c} AS DOUBLE), {float(r.default)})" if r.default is not None and not r.nullable else f"CAST({c} AS DOUBLE)"
    v = f"ROUND(CAST(CAST({src} AS VARCHAR) AS DECIMAL(38, 10)), {r.scale})"
    return f"(CASE WHEN ABS({v}) < {10 ** (r.precision - r.scale)} THEN CAST({v} AS DOUBLE) END)", src


def _conform_sql(rules=tuple(A.STUDENTS_TABLE), table="students", order_col="row_ordinal", key="student_id", absent=()):
    sel, reasons = [], []
    for r in rules:
        c = r.name
        if c in absent:
            sel.append(f"'{r.default}' AS {c}")
        elif r.kind == "varchar":
            sel.append(f"CAST({c} AS VARCHAR) AS {c}")
            reasons.append(f"CASE WHEN length(CAST({c} AS VARCHAR)) > {r.length} THEN '{c} too long' END")
            if not r.nullable:
                reasons.append(f"CASE WHEN {c} IS NULL THEN '{c} is null' END")
        elif r.kind == "decimal":
            value, src = _dec_sql(c, r)
            sel.append(f"{value} AS {c}")
            reasons.append(f"CASE WHEN {src} IS NOT NULL AND {value} IS NULL THEN '{c} out of range' END")
            if not r.nullable:
                reasons.append(f"CASE WHEN {src} IS NULL THEN '{c} is null' END")
        elif r.kind in ("tinyint", "smallint"):
            lo, hi = (-128, 127) if r.kind == "tinyint" else (-32768, 32767)
            src = f"CAST({c} AS DOUBLE)" if r.default is None or r.nullable else f"COALESCE(CAST({c} AS DOUBLE), {float(r.default)})"
            sel.append(f"CASE WHEN {src} BETWEEN {lo} AND {hi} THEN CAST(ROUND({src}) AS INTEGER) END AS {c}")
            reasons.append(f"CASE WHEN {src} IS NOT NULL AND NOT ({src} BETWEEN {lo} AND {hi}) "
                           f"THEN '{c} out of range' END")
            if not r.nullable:
                reasons.append(f"CASE WHEN {src} IS NULL THEN '{c} is null' END")
        elif r.kind == "enum":
            low = f"lower(rtrim(CAST({c} AS VARCHAR), ' '))"
            case = "CASE " + " ".join(f"WHEN {low} = '{m.lower()}' THEN '{m}'" for m in r.domain) + " END"
            sel.append(f"{case} AS {c}")
            reasons.append(f"CASE WHEN {c} IS NOT NULL AND ({case}) IS NULL THEN '{c} not in domain' END")
            if not r.nullable:
                reasons.append(f"CASE WHEN {c} IS NULL THEN '{c} is null' END")
    if key:
        reasons.append(f"CASE WHEN {order_col} <> MIN({order_col}) OVER (PARTITION BY {key}) "
                       f"THEN 'duplicate {key}' END")
    return (f"SELECT {order_col}, " + ", ".join(sel) + ", concat_ws(';', " + ", ".join(reasons)
            + f") AS reject_reasons FROM {table}")


def _as_double(conformed, rules):
    dec = [r.name for r in rules if r.kind == "decimal"]
    return conformed.select(*[F.col(x).cast("double").alias(x) if x in dec else F.col(x) for x in conformed.columns])


@register("a10_conform_students", with_views(_conform_sql(), STUDENTS_SQL))
def a10_conform_students(spark, sf_dir):
    return _as_double(A.conform(common.students(spark, sf_dir)), A.STUDENTS_TABLE)


@register("a10_conform_predictions", with_views(_conform_sql(A.PREDICTIONS_TABLE, "untidy", "id", None), PREDICTIONS_SQL, """
untidy AS (SELECT * REPLACE (CONCAT(UPPER(predicted_result), ' ') AS predicted_result,
    CASE WHEN id % 11 = 0 THEN 'Severe' ELSE risk_level END AS risk_level,
    CASE WHEN id % 7 = 0 THEN risk_score * 1000 ELSE risk_score END AS risk_score,
    CASE WHEN id % 13 = 0 THEN NULL ELSE confidence END AS confidence) FROM predictions)"""))
def a10_conform_predictions(spark, sf_dir):
    """Predictions as another program might send them, against the table's contract."""
    untidy = common.predictions(spark, sf_dir).withColumns({
        "predicted_result": F.concat(F.upper("predicted_result"), F.lit(" ")),
        "risk_level": F.when(F.col("id") % 11 == 0, "Severe").otherwise(F.col("risk_level")),
        "risk_score": F.when(F.col("id") % 7 == 0, F.col("risk_score") * 1000).otherwise(F.col("risk_score")),
        "confidence": F.when(F.col("id") % 13 != 0, F.col("confidence"))})
    return _as_double(A.conform(untidy, A.PREDICTIONS_TABLE, None, "id"), A.PREDICTIONS_TABLE)


_ALERT_ROWS_SQL = f"""
alert_rows AS (SELECT id, student_id, CONCAT('advisor.', student_id, '@college.edu') AS sent_to,
    CASE id % 5 WHEN 0 THEN 'SENT' WHEN 1 THEN 'failed ' WHEN 2 THEN 'queued' WHEN 3 THEN 'pending' END AS status
  FROM predictions WHERE risk_level = '{cfg.RISK_LABEL_HIGH}')"""


def _alert_rows(spark, sf_dir):
    n = F.col("id") % 5
    return common.predictions(spark, sf_dir).filter(F.col("risk_level") == cfg.RISK_LABEL_HIGH).select(
        "id", "student_id", F.concat(F.lit("advisor."), "student_id", F.lit("@college.edu")).alias("sent_to"),
        F.when(n == 0, "SENT").when(n == 1, "failed ").when(n == 2, "queued").when(n == 3, "pending").alias("status"))


@register("a10_conform_alerts", with_views(_conform_sql(A.ALERTS_TABLE, "alert_rows", "id", None, ("alert_type",)), PREDICTIONS_SQL, _ALERT_ROWS_SQL))
def a10_conform_alerts(spark, sf_dir):
    """Alert rows of every High Risk prediction, one status in five outside the domain; the type is the default."""
    return A.conform(_alert_rows(spark, sf_dir), A.ALERTS_TABLE, None, "id")


@register("j2_alert_outcomes_mixed", with_views("""
SELECT s.status, CAST(COUNT(a.id) AS BIGINT) AS "count"
FROM (VALUES ('sent'), ('failed'), ('pending')) s(status)
LEFT JOIN alert_rows a ON LOWER(RTRIM(a.status)) = s.status GROUP BY s.status""", PREDICTIONS_SQL, _ALERT_ROWS_SQL))
def j2_alert_outcomes_mixed(spark, sf_dir):
    """Outcomes (J2) of an alert log that the contract let in, with sent, failed and pending rows."""
    log = A.accepted_rows(A.conform(_alert_rows(spark, sf_dir), A.ALERTS_TABLE, None, "id"))
    return J.alert_outcomes(log.filter(F.col("status").isNotNull()))


@register("a9_fk_rejected_unlabelled", with_views(f"""
SELECT * FROM predictions p WHERE NOT EXISTS (
  SELECT 1 FROM students s WHERE s.student_id = p.student_id AND {cap(strip('s.result'))} IN ('Pass', 'Fail'))""",
    STUDENTS_SQL, PREDICTIONS_SQL))
def a9_fk_rejected_unlabelled(spark, sf_dir):
    """Rows a foreign key to the students with a usable label rejects (a non-empty reject path)."""
    kept = common.students(spark, sf_dir).filter(normalised_label("result").isin("Pass", "Fail"))
    return A.fk_rejected(common.predictions(spark, sf_dir), kept)


@register("a16_batch_preview", with_views("""
SELECT student_id, predicted_result, risk_level, risk_score FROM scored ORDER BY student_id LIMIT 20""",
    STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, LATEST_ONE_SQL, SCORED_SQL))
def a16_batch_preview(spark, sf_dir):
    return scored(spark, sf_dir, []).select("student_id", "predicted_result", "risk_level", "risk_score") \
        .orderBy("student_id").limit(cfg.PREVIEW_ROWS)


# -- kept tables (manifest, buckets, numbered appends) -----------------------------

_TABLE_SQL = f"""
was AS (SELECT * EXCLUDE (reject_reasons) FROM ({_conform_sql(table="(SELECT * FROM dedup WHERE student_id IN (SELECT student_id FROM predictions)) x", key=None)}) t WHERE reject_reasons = ''),
tried AS ({_conform_sql(key=None)}),
came AS (SELECT * EXCLUDE (reject_reasons) FROM tried WHERE reject_reasons = ''),
came_first AS (SELECT * FROM came QUALIFY ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY row_ordinal) = 1),
came_last AS (SELECT * FROM came QUALIFY ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY row_ordinal DESC) = 1),
kept AS (SELECT w.* REPLACE (CASE WHEN l.student_id IS NULL THEN w.name ELSE l.name END AS name,
      CASE WHEN l.student_id IS NULL THEN w.attendance_percentage ELSE l.attendance_percentage END AS attendance_percentage)
    FROM was w LEFT JOIN came_last l ON l.student_id = w.student_id
  UNION ALL SELECT f.* REPLACE (l.name AS name, l.attendance_percentage AS attendance_percentage)
    FROM came_first f JOIN came_last l ON l.student_id = f.student_id WHERE f.student_id NOT IN (SELECT student_id FROM was))"""
_TABLE_VIEWS = (STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, _TABLE_SQL)
_BUCKETS = 16


def _upserted_table(spark, sf_dir):
    """A table of the students with a prediction, then an upsert of every student row as it came."""
    path = scratch_path(spark, "student_table")
    s = common.students(spark, sf_dir)
    tables.create(spark, path, tables.table_schema(A.STUDENTS_TABLE), buckets=_BUCKETS)
    tables.upsert(spark, path, dedup_first(s).join(common.predictions(spark, sf_dir).select("student_id"), "student_id", "left_semi"))
    return path, tables.upsert(spark, path, s)


@register("a6_table_upsert", with_views("SELECT * FROM kept", *_TABLE_VIEWS))
def a6_table_upsert(spark, sf_dir):
    """The bucketed table after an upsert whose rows had to meet the contract."""
    path, _ = _upserted_table(spark, sf_dir)
    return _as_double(tables.read(spark, path), A.STUDENTS_TABLE)


@register("a7_table_upsert_counts", with_views("""
SELECT CAST((SELECT COUNT(*) FROM came_first WHERE student_id NOT IN (SELECT student_id FROM was)) AS BIGINT) AS inserted,
       CAST((SELECT COUNT(*) FROM came_first WHERE student_id IN (SELECT student_id FROM was)) AS BIGINT) AS updated,
       CAST((SELECT COUNT(*) FROM came) AS BIGINT) AS accepted,
       CAST((SELECT COUNT(*) FROM tried WHERE reject_reasons <> '') AS BIGINT) AS rejected""", *_TABLE_VIEWS))
def a7_table_upsert_counts(spark, sf_dir):
    """What the upsert reports: keys inserted and updated, batch rows accepted and refused."""
    got = _upserted_table(spark, sf_dir)[1]
    names = ["inserted", "updated", "accepted", "rejected"]
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


_LOG_SQL = f"""
untidy AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 'Severe' ELSE risk_level END AS risk_level,
    CASE WHEN id % 7 = 0 THEN risk_score * 1000 ELSE risk_score END AS risk_score) FROM predictions),
parents AS (SELECT DISTINCT student_id FROM students WHERE {cap(strip("result"))} IN ('Pass', 'Fail')),
judged AS (SELECT c.* EXCLUDE (reject_reasons), concat_ws(';', NULLIF(reject_reasons, ''),
      CASE WHEN p.student_id IS NULL THEN 'unknown student_id' END) AS reject_reasons
    FROM ({_conform_sql(A.PREDICTIONS_TABLE, "untidy", "id", None)}) c LEFT JOIN parents p ON p.student_id = c.student_id)"""


def _appended_log(spark, sf_dir):
    """Predictions appended in two batches, the second one sent twice; some break the contract or have no parent."""
    path = scratch_path(spark, "prediction_log")
    tables.create(spark, path, tables.log_schema(A.PREDICTIONS_TABLE, "predicted_at"), buckets=0)
    untidy = common.predictions(spark, sf_dir).drop("predicted_at").withColumns({
        "risk_level": F.when(F.col("id") % 11 == 0, "Severe").otherwise(F.col("risk_level")),
        "risk_score": F.when(F.col("id") % 7 == 0, F.col("risk_score") * 1000).otherwise(F.col("risk_score"))}).withColumnRenamed("id", "row_ordinal")
    parents = common.students(spark, sf_dir).filter(normalised_label("result").isin("Pass", "Fail"))
    for batch, half in (("even", 0), ("odd", 1), ("odd", 1)):
        tables.append(spark, path, untidy.filter(F.pmod("row_ordinal", F.lit(2)) == half), A.PREDICTIONS_TABLE, ["row_ordinal"],
                      parents, batch, "predicted_at")
    return path


@register("a8_append_numbered", with_views(
    "SELECT ROW_NUMBER() OVER (ORDER BY id % 2, id) AS id, " + ", ".join(r.name for r in A.PREDICTIONS_TABLE) + " FROM judged WHERE reject_reasons = ''",
    STUDENTS_SQL, PREDICTIONS_SQL, _LOG_SQL))
def a8_append_numbered(spark, sf_dir):
    """The prediction log (A8): ids go on from the high-water mark; every column but the time stamp."""
    return _as_double(tables.read(spark, _appended_log(spark, sf_dir)), A.PREDICTIONS_TABLE).drop("predicted_at")


@register("a8_append_rejects", with_views(
    "SELECT id AS row_ordinal, student_id, reject_reasons FROM judged WHERE reject_reasons <> ''", STUDENTS_SQL, PREDICTIONS_SQL, _LOG_SQL))
def a8_append_rejects(spark, sf_dir):
    """Rows that the append refused: contract reasons and unknown parents."""
    return tables.rejects(spark, _appended_log(spark, sf_dir)).select("row_ordinal", "student_id", "reject_reasons")


@register("a5_single_lookup", with_views(
    "SELECT * FROM dedup WHERE student_id = (SELECT MIN(student_id) FROM predictions)", STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL))
def a5_single_lookup(spark, sf_dir):
    """One student's row by key from a bucketed table: one bucket is read, with the key's filter pushed into the scan."""
    path = scratch_path(spark, "student_table")
    tables.load(dedup_first(common.students(spark, sf_dir)), path, buckets=_BUCKETS)
    one = common.predictions(spark, sf_dir).agg(F.min("student_id")).first()[0]
    return tables.read(spark, path, [one])


@register("i5_single_history", with_views("""
SELECT *, ROW_NUMBER() OVER (ORDER BY predicted_at DESC, id DESC) AS history_position
FROM predictions WHERE student_id = (SELECT MIN(student_id) FROM predictions)""", PREDICTIONS_SQL))
def i5_single_history(spark, sf_dir):
    """One student's predictions, newest first, from a table bucketed by student."""
    path = scratch_path(spark, "prediction_table")
    p = common.predictions(spark, sf_dir)
    tables.load(p, path, buckets=_BUCKETS)
    return I.prediction_history(tables.read(spark, path, [p.agg(F.min("student_id")).first()[0]]))


# -- rows-only (time stamps, hashing RNG) -----------------------------------------

@register("a8_append_predictions")
def a8_append_predictions(spark, sf_dir):
    """Each student's latest prediction appended to a prediction log, stamped now."""
    path = scratch_path(spark, "prediction_log")
    latest = I.latest_one(common.predictions(spark, sf_dir)).drop("predicted_at", "id")
    A.append_stamped(latest, path, "predicted_at")
    return spark.read.parquet(path)


@register("a12_alert_log")
def a12_alert_log(spark, sf_dir):
    """J1's worklist appended to the alert log (type, recipient, status, time)."""
    path = scratch_path(spark, "alert_log")
    rows = J.alert_worklist(scored(spark, sf_dir)).select("student_id", "alert_type", "sent_to", "status")
    A.append_stamped(rows, path, "sent_at")
    return spark.read.parquet(path)


@register("a12_alert_log_rows", with_views(f"""
SELECT student_id, '{cfg.ALERT_TYPE}' AS alert_type, '{J.DEFAULT_RECIPIENT}' AS sent_to, 'pending' AS status
FROM scored WHERE risk_level = '{cfg.RISK_LABEL_HIGH}'""", STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, LATEST_ONE_SQL, SCORED_SQL))
def a12_alert_log_rows(spark, sf_dir):
    """The alert log of ``a12_alert_log`` without its time stamps."""
    return a12_alert_log(spark, sf_dir).drop("sent_at")


@register("a14_sample_shape", with_views(f"""
SELECT LEAST({cfg.SAMPLE_ROWS}, COUNT(*)) AS sampled, LEAST({cfg.SAMPLE_ROWS}, COUNT(*)) AS rows_of_the_table FROM students""", STUDENTS_SQL))
def a14_sample_shape(spark, sf_dir):
    """Size of the seeded sample and how many of its rows are rows of the table, all columns but the target compared."""
    s = common.students(spark, sf_dir)
    sample = a14_seeded_sample(spark, sf_dir)
    found = s.select(*sample.columns, F.lit(1).alias("_there")).unionByName(sample.withColumn("_there", F.lit(2)))
    both = found.groupBy(sample.columns).agg(F.sum(F.when(F.col("_there") == 2, 1)).alias("mine"), F.max(F.when(F.col("_there") == 1, 1)).alias("known"))
    return both.agg(F.sum("mine").alias("sampled"), F.sum(F.when(F.col("known") == 1, F.col("mine"))).alias("rows_of_the_table"))


@register("a14_seeded_sample")
def a14_seeded_sample(spark, sf_dir):
    """20 students chosen by seeded hash order, target dropped."""
    return synth.seeded_sample(common.students(spark, sf_dir), cfg.SAMPLE_ROWS, "row_ordinal")
