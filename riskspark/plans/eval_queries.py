"""Registered evaluation (2.E), scoring (2.F), recommendation (2.G) and outreach (2.J)
queries with their oracle SQL.

Evaluation operators take (label, prediction, score) frames, so they are checked
on closed-form scores: each student's latest prediction against the encoded
label (score = 1 - fail probability), as FIXTURES.md prescribes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import clip
from ..operators import analytics as I
from ..operators import evaluate as E
from ..operators import outreach as J
from ..operators import recommend as G
from ..operators import score as S
from ..operators import store as A
from ..operators.clean import dedup_first, encode_target
from ..session import scratch_path
from . import common
from .report_queries import SCORED_SQL, scored
from .sqlparts import (DEDUP_SQL, LATEST_ONE_SQL, PREDICTIONS_SQL, STUDENTS_SQL, cap, clipx, r, strip,
                       with_views)
from .store_queries import _as_double, _conform_sql

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# -- evaluation frames --------------------------------------------------------

def labelled_students(spark, sf_dir):
    d = encode_target(common.first_students(spark, sf_dir, ["result", "attendance_percentage"]))
    return d.select("student_id", F.col("result").alias("label"), "attendance_percentage")


def eval_frame(spark, sf_dir, scorer: str = "latest"):
    """(student_id, label, prediction, score) for one of three deterministic scorers."""
    lab = labelled_students(spark, sf_dir)
    preds = common.predictions(spark, sf_dir)
    if scorer == "latest":
        s = I.latest_one(preds.select("student_id", "predicted_at", "id", "fail_probability", "predicted_result")) \
            .select("student_id", (1 - F.col("fail_probability")).alias("score"),
                                       (F.col("predicted_result") == "Pass").cast("int").alias("prediction"))
        return lab.join(s, "student_id").select("student_id", "label", "prediction", "score")
    if scorer == "mean":
        s = preds.groupBy("student_id").agg((1 - F.avg("fail_probability")).alias("score"))
        return lab.join(s, "student_id").select("student_id", "label",
                                                (F.col("score") > 0.5).cast("int").alias("prediction"), "score")
    if scorer == "attendance":
        sc = clip(F.coalesce(F.col("attendance_percentage"), F.lit(0.0)), 0, 100) / 100
        return lab.select("student_id", "label", (sc > 0.5).cast("int").alias("prediction"), sc.alias("score"))
    raise ValueError(scorer)


SCORERS = {"Latest Prediction": "latest", "Mean Prediction": "mean", "Attendance Rule": "attendance"}

_LABEL_SQL = f"CASE WHEN d.result IS NULL THEN 0 WHEN {cap(strip('d.result'))} = 'Pass' THEN 1 ELSE 0 END"
EVAL_SQL = f"""
ev_latest AS (
  SELECT d.student_id, {_LABEL_SQL} AS label, CASE WHEN l.predicted_result = 'Pass' THEN 1 ELSE 0 END AS prediction,
         1 - l.fail_probability AS score
  FROM dedup d JOIN latest_one l ON l.student_id = d.student_id),
ev_mean AS (
  SELECT d.student_id, {_LABEL_SQL} AS label, CASE WHEN m.score > 0.5 THEN 1 ELSE 0 END AS prediction, m.score
  FROM dedup d JOIN (SELECT student_id, 1 - AVG(fail_probability) AS score FROM predictions GROUP BY 1) m
    ON m.student_id = d.student_id),
ev_attendance AS (
  SELECT d.student_id, {_LABEL_SQL} AS label,
         CASE WHEN {clipx('COALESCE(d.attendance_percentage, 0.0)', 0, 100)} / 100 > 0.5 THEN 1 ELSE 0 END AS prediction,
         {clipx('COALESCE(d.attendance_percentage, 0.0)', 0, 100)} / 100 AS score
  FROM dedup d)"""
_EVAL_VIEWS = (STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, LATEST_ONE_SQL, EVAL_SQL)


def _counts_sql(src):
    return f"""(SELECT COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
        COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
        COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
        COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM {src})"""


def _div(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"


def _metrics_sql(src):
    return f"""SELECT {r(_div('tp + tn', 'tp + fp + fn + tn'), 4)} AS accuracy, {r(_div('tp', 'tp + fp'), 4)} AS precision,
       {r(_div('tp', 'tp + fn'), 4)} AS recall, {r(_div('2 * tp', '2 * tp + fp + fn'), 4)} AS f1
FROM {_counts_sql(src)} c"""


def _roc_sql(src):
    return f"""WITH g AS (SELECT CAST(score AS DOUBLE) AS threshold, COUNT(*) FILTER (WHERE label = 1) AS pos,
                  COUNT(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY 1),
t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM g),
c AS (SELECT threshold,
        SUM(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
        SUM(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM g),
roc AS (
  SELECT CAST('infinity' AS DOUBLE) AS threshold, 0.0E0 AS fpr, 0.0E0 AS tpr
  UNION ALL
  SELECT threshold, {_div('cn', 'N')} AS fpr, {_div('cp', 'P')} AS tpr FROM c, t)"""


def _auc_sql(src):
    return _roc_sql(src) + f""",
seg AS (SELECT fpr, tpr, LAG(fpr) OVER (ORDER BY threshold DESC) AS pf, LAG(tpr) OVER (ORDER BY threshold DESC) AS pt
        FROM roc)
SELECT {r('COALESCE(SUM((fpr - pf) * (tpr + pt) / 2), 0.0)', 4)} AS auc FROM seg"""


@register("e1_binary_metrics", with_views(_metrics_sql("ev_latest"), *_EVAL_VIEWS))
def e1_binary_metrics(spark, sf_dir):
    return E.binary_metrics(eval_frame(spark, sf_dir))


@register("e2_confusion_matrix", with_views("""
SELECT CASE WHEN g.a = 0 THEN 'Fail' ELSE 'Pass' END AS actual_class,
       CASE WHEN g.p = 0 THEN 'Fail' ELSE 'Pass' END AS predicted_class, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM (SELECT a, p FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, p)) g
LEFT JOIN (SELECT label, prediction, COUNT(*) AS n FROM ev_latest GROUP BY 1, 2) c
  ON c.label = g.a AND c.prediction = g.p""", *_EVAL_VIEWS))
def e2_confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(eval_frame(spark, sf_dir))


_P1, _R1 = _div("tp", "tp + fp"), _div("tp", "tp + fn")
_P0, _R0 = _div("tn", "tn + fn"), _div("tn", "tn + fp")
_F1, _F0 = _div("2 * tp", "2 * tp + fp + fn"), _div("2 * tn", "2 * tn + fn + fp")
_N = "(tp + fp + fn + tn)"


@register("e3_classification_report", with_views(f"""
SELECT class_label, {r('p', 4)} AS precision, {r('rc', 4)} AS recall, {r('f', 4)} AS f1_score,
       CAST(s AS BIGINT) AS support FROM (
  SELECT 'Fail' AS class_label, {_P0} AS p, {_R0} AS rc, {_F0} AS f, tn + fp AS s FROM {_counts_sql('ev_latest')} c
  UNION ALL SELECT 'Pass', {_P1}, {_R1}, {_F1}, tp + fn FROM {_counts_sql('ev_latest')} c
  UNION ALL SELECT 'accuracy', NULL, NULL, {_div('tp + tn', _N)}, {_N} FROM {_counts_sql('ev_latest')} c
  UNION ALL SELECT 'macro avg', ({_P0} + {_P1}) / 2, ({_R0} + {_R1}) / 2, ({_F0} + {_F1}) / 2, {_N}
    FROM {_counts_sql('ev_latest')} c
  UNION ALL SELECT 'weighted avg', {_div(f'{_P0} * (tn + fp) + {_P1} * (tp + fn)', _N)},
    {_div(f'{_R0} * (tn + fp) + {_R1} * (tp + fn)', _N)}, {_div(f'{_F0} * (tn + fp) + {_F1} * (tp + fn)', _N)}, {_N}
    FROM {_counts_sql('ev_latest')} c) t""", *_EVAL_VIEWS))
def e3_classification_report(spark, sf_dir):
    return E.classification_report(eval_frame(spark, sf_dir))


@register("e4_roc_points", with_views(_roc_sql("ev_latest") + "\nSELECT threshold, fpr, tpr FROM roc",
                                      *_EVAL_VIEWS))
def e4_roc_points(spark, sf_dir):
    """Every distinct-score point kept."""
    return E.roc_points(eval_frame(spark, sf_dir), drop_intermediate=False)


def _roc_thin_sql(src):
    return f"""WITH g AS (SELECT CAST(score AS DOUBLE) AS threshold, COUNT(*) FILTER (WHERE label = 1) AS pos,
                  COUNT(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY 1),
t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM g),
c AS (SELECT threshold, pos, neg,
        SUM(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
        SUM(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
        LEAD(pos) OVER (ORDER BY threshold DESC) AS npos, LEAD(neg) OVER (ORDER BY threshold DESC) AS nneg,
        ROW_NUMBER() OVER (ORDER BY threshold DESC) AS rn FROM g)
SELECT CAST('infinity' AS DOUBLE) AS threshold, 0.0E0 AS fpr, 0.0E0 AS tpr
UNION ALL
SELECT threshold, {_div('cn', 'N')} AS fpr, {_div('cp', 'P')} AS tpr FROM c, t
WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg"""


@register("e4_roc_curve", with_views(_roc_thin_sql("ev_latest"), *_EVAL_VIEWS))
def e4_roc_curve(spark, sf_dir):
    """scikit-learn's default curve: repeated steps thinned (``drop_intermediate``)."""
    return E.roc_points(eval_frame(spark, sf_dir))


@register("e5_auc", with_views(_auc_sql("ev_latest"), *_EVAL_VIEWS))
def e5_auc(spark, sf_dir):
    return E.auc(eval_frame(spark, sf_dir))


def _metrics_table_sql():
    parts = []
    for i, (name, key) in enumerate(SCORERS.items()):
        src = f"ev_{key}"
        parts.append(f"""SELECT {i} AS model_order, '{name}' AS model, m.*, a.auc FROM ({_metrics_sql(src)}) m,
  ({_auc_sql(src).replace('WITH ', 'WITH ', 1)}) a""")
    return "\nUNION ALL\n".join(parts)


def _metrics_table(spark, sf_dir):
    return E.metrics_table({name: eval_frame(spark, sf_dir, key) for name, key in SCORERS.items()})


@register("e7_metrics_table", with_views(f"SELECT * FROM ({_metrics_table_sql()}) t", *_EVAL_VIEWS))
def e7_metrics_table(spark, sf_dir):
    return _metrics_table(spark, sf_dir)


_MT = f"mt AS ({_metrics_table_sql()})"
_LONG = " UNION ALL ".join(f"SELECT model_order, model, '{m}' AS metric, {m} AS value FROM mt"
                           for m in E.METRIC_COLUMNS)


_UNTIDY_METRICS_SQL = f"""WITH {_MT}, logged AS (SELECT model_order, CASE WHEN model_order = 2 THEN repeat(model, 20) ELSE model END AS model_name,
    CASE WHEN model_order = 1 THEN accuracy * 100000 ELSE accuracy END AS accuracy, "precision" AS precision_score, recall, f1 AS f1_score, auc,
    CASE WHEN model = (SELECT arg_min(model, (-f1, model_order)) FROM mt WHERE f1 IS NOT NULL) THEN 1 END AS is_best FROM mt)
{_conform_sql(A.METRICS_TABLE, "logged", "model_order", None)}"""


@register("a10_conform_metrics", with_views(_UNTIDY_METRICS_SQL, *_EVAL_VIEWS))
def a10_conform_metrics(spark, sf_dir):
    """The metrics log (E7, the best F1 marked) against its contract: one name is too long, one value out of range."""
    m = _metrics_table(spark, sf_dir)
    best = E.best_per_metric(m, ["f1"]).select(F.col("best_model").alias("model"), F.lit(1).alias("is_best"))
    logged = m.join(best, "model", "left").select(
        "model_order", F.when(F.col("model_order") == 2, F.repeat("model", 20)).otherwise(F.col("model")).alias("model_name"),
        F.when(F.col("model_order") == 1, F.col("accuracy") * 100000).otherwise(F.col("accuracy")).alias("accuracy"),
        F.col("precision").alias("precision_score"), "recall", F.col("f1").alias("f1_score"), "auc", "is_best")
    return _as_double(A.conform(logged, A.METRICS_TABLE, None, "model_order"), A.METRICS_TABLE)


@register("e8_best_per_metric", with_views(f"""WITH {_MT}, lg AS ({_LONG})
SELECT metric, MAX(value) AS best_value, arg_min(model, (-value, model_order)) AS best_model
FROM lg WHERE value IS NOT NULL GROUP BY metric""", *_EVAL_VIEWS))
def e8_best_per_metric(spark, sf_dir):
    return E.best_per_metric(_metrics_table(spark, sf_dir))


@register("e9_metrics_long", with_views(f"WITH {_MT} {_LONG}", *_EVAL_VIEWS))
def e9_metrics_long(spark, sf_dir):
    return E.metrics_long(_metrics_table(spark, sf_dir))


# -- scoring ------------------------------------------------------------------

@register("f2_f4_risk_from_probability", with_views(f"""
SELECT event_id AS id,
  CASE WHEN (1.0E0 - p) > p THEN 'Pass' ELSE 'Fail' END AS predicted_result,
  {r('1.0E0 - p', 4)} AS pass_probability, {r('p', 4)} AS fail_probability, {r('p * 100', 2)} AS risk_score,
  CASE WHEN p >= 0.7 THEN 'High Risk' WHEN p >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level,
  {r('GREATEST(1.0E0 - p, p) * 100', 2)} AS confidence
FROM (SELECT event_id, value / (value + 50) AS p FROM events) e"""))
def f2_f4_risk_from_probability(spark, sf_dir):
    """Model output = value / (value + 50) per event; bands on the unrounded probability."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), (F.col("value") / (F.col("value") + 50)).alias("p_fail"))
    return S.attach_risk(e, "p_fail")


@register("f6_gauge_band", with_views("""
SELECT id, risk_score, CASE WHEN risk_score >= 0 AND risk_score < 40 THEN '0-40'
  WHEN risk_score >= 40 AND risk_score < 70 THEN '40-70' WHEN risk_score >= 70 AND risk_score <= 100 THEN '70-100'
  END AS gauge_band FROM predictions""", PREDICTIONS_SQL))
def f6_gauge_band(spark, sf_dir):
    p = common.predictions(spark, sf_dir)
    return p.select("id", "risk_score", S.gauge_band("risk_score").alias("gauge_band"))


# -- recommendations ------------------------------------------------------------

def rec_source(spark, sf_dir):
    d = dedup_first(common.students(spark, sf_dir))
    latest = I.latest_one(common.predictions(spark, sf_dir).select("student_id", "predicted_at", "id", "risk_level"))
    return d.join(latest, "student_id", "left")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_message(template: str, col: str) -> str:
    out = _sql_text(template)
    out = out.replace("{v}", f"' || printf('%.1f', {col}) || '")
    out = out.replace("{n}", f"' || CAST(CAST(trunc({col}) AS BIGINT) AS VARCHAR) || '")
    return out


def _rules_sql():
    parts = []
    for i, (rule, col, tkey, category, priority, icon, msg, action) in enumerate(cfg.RECOMMENDATION_RULES):
        cond = f"{col} < {cfg.REC_THRESHOLDS[tkey]}"
        if rule == "attendance_low":
            cond += f" AND NOT ({col} < {cfg.REC_THRESHOLDS['attendance_critical']})"
        parts.append(
            f"SELECT student_id, {i + 1} AS rule_no, {cfg.PRIORITY_RANK[priority]} AS rnk, {_sql_text(category)} AS category, "
            f"{_sql_text(priority)} AS priority, {_sql_text(icon)} AS icon, {_sql_message(msg, col)} AS message, "
            f"{_sql_text(action)} AS action FROM recsrc WHERE {cond}")
    n = len(cfg.RECOMMENDATION_RULES) + 1
    case = {k: "CASE" for k in ("rnk", "category", "priority", "icon", "message", "action")}
    for level, category, priority, icon, msg, action in cfg.RISK_RECOMMENDATIONS:
        vals = {"rnk": str(cfg.PRIORITY_RANK[priority]), "category": _sql_text(category),
                "priority": _sql_text(priority), "icon": _sql_text(icon), "message": _sql_text(msg),
                "action": _sql_text(action)}
        for k in case:
            case[k] += (f" WHEN risk_level = {_sql_text(level)} THEN {vals[k]}" if level else f" ELSE {vals[k]} END")
    parts.append(f"SELECT student_id, {n} AS rule_no, " + ", ".join(f"{v} AS {k}" for k, v in case.items())
                 + " FROM recsrc")
    return " UNION ALL ".join(parts)


RECS_SQL = f"""
recsrc AS (SELECT d.*, l.risk_level FROM dedup d LEFT JOIN latest_one l ON l.student_id = d.student_id),
rules AS ({_rules_sql()}),
recrows AS (
  SELECT student_id, CAST(ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY rnk, rule_no) - 1 AS INTEGER) AS position,
         category, priority, icon, message, action FROM rules)"""
_REC_VIEWS = (STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, LATEST_ONE_SQL, RECS_SQL)


@register("g1_recommendation_summary", with_views("""
SELECT student_id, CAST(COUNT(*) AS INTEGER) AS n_recommendations,
       string_agg(category, '|' ORDER BY position) AS categories,
       string_agg(priority, '|' ORDER BY position) AS priorities
FROM recrows GROUP BY student_id""", *_REC_VIEWS))
def g1_recommendation_summary(spark, sf_dir):
    recs = G.with_recommendations(rec_source(spark, sf_dir))
    return recs.select("student_id", F.size("recommendations").alias("n_recommendations"),
                       F.array_join(F.transform("recommendations", lambda x: x["category"]), "|").alias("categories"),
                       F.array_join(F.transform("recommendations", lambda x: x["priority"]), "|").alias("priorities"))


@register("g3_recommendation_rows", with_views("SELECT * FROM recrows", *_REC_VIEWS))
def g3_recommendation_rows(spark, sf_dir):
    return G.explode_recommendations(G.with_recommendations(rec_source(spark, sf_dir)))


@register("g4_display_lines", with_views("""
SELECT student_id, position, icon || ' **[' || priority || '] ' || category || '** — ' || message || ' *→ ' || action || '*'
       AS display_line FROM recrows""", *_REC_VIEWS))
def g4_display_lines(spark, sf_dir):
    recs = G.display_lines(G.with_recommendations(rec_source(spark, sf_dir)))
    return recs.select("student_id", F.posexplode("display_lines").alias("position", "display_line"))


# -- alerts and reports -----------------------------------------------------------

@register("j1_alert_worklist", with_views(f"""
SELECT student_id, '{cfg.ALERT_TYPE}' AS alert_type, '{J.DEFAULT_RECIPIENT}' AS sent_to, 'pending' AS status,
  '{cfg.ALERT_SUBJECT_PREFIX}' || COALESCE(name, 'Student') || ' (' || COALESCE(student_id, 'N/A') || ')' AS subject,
  COALESCE(name, 'N/A') AS name, COALESCE(CAST(department AS VARCHAR), 'N/A') AS department,
  attendance_percentage, midterm_marks, risk_level, risk_score, predicted_result, confidence
FROM scored WHERE risk_level = 'High Risk'""", STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, LATEST_ONE_SQL, SCORED_SQL))
def j1_alert_worklist(spark, sf_dir):
    return J.alert_worklist(scored(spark, sf_dir))


@register("j2_alert_outcomes", with_views("""
SELECT s.status, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM (VALUES ('sent'), ('failed'), ('pending')) s(status)
LEFT JOIN (SELECT 'pending' AS status, COUNT(*) AS n FROM scored WHERE risk_level = 'High Risk') c
  ON c.status = s.status""", STUDENTS_SQL, PREDICTIONS_SQL, DEDUP_SQL, LATEST_ONE_SQL, SCORED_SQL))
def j2_alert_outcomes(spark, sf_dir):
    return J.alert_outcomes(J.alert_worklist(scored(spark, sf_dir)))


@register("j3_report_rows", with_views("""
SELECT r.student_id, r.risk_level AS report_risk_level, r.name, r.department, r.predicted_result, r.risk_score,
       CAST(COUNT(x.position) AS INTEGER) AS n_recommendations,
       string_agg(x.category, '|' ORDER BY x.position) AS categories
FROM (SELECT s.*, d.gender, d.age FROM scored s JOIN dedup d ON d.student_id = s.student_id) r
LEFT JOIN (SELECT rr.* FROM recrows rr) x ON x.student_id = r.student_id
GROUP BY r.student_id, r.risk_level, r.name, r.department, r.predicted_result, r.risk_score""",
    *_REC_VIEWS, SCORED_SQL))
def j3_report_rows(spark, sf_dir):
    d = dedup_first(common.students(spark, sf_dir))
    latest = I.latest_one(common.predictions(spark, sf_dir))
    src = d.join(latest.select("student_id", "predicted_result", "risk_level", "risk_score", "confidence",
                               "pass_probability", "fail_probability"), "student_id")
    rep = J.report_rows(src)
    return rep.select("student_id", "report_risk_level", "details.name", "details.department",
                      "prediction.predicted_result", "prediction.risk_score",
                      F.size("recommendations").alias("n_recommendations"),
                      F.array_join(F.transform("recommendations", lambda x: x["category"]), "|").alias("categories"))


_DETAILS = ["name", "gender", "age", "department", "attendance_percentage", "midterm_marks", "assignment_score", "quiz_score", "lab_score", "lms_activity"]
_PREDICTION = ["predicted_result", "risk_score", "confidence", "pass_probability", "fail_probability"]


@register("j3_report_files", with_views(f"""
SELECT d.student_id, l.risk_level AS report_risk_level, {", ".join(f"d.{c}" for c in _DETAILS)}, {", ".join(f"l.{c}" for c in _PREDICTION)},
       (SELECT string_agg(concat_ws('|', category, priority, icon, message, action), chr(10) ORDER BY position)
        FROM recrows x WHERE x.student_id = d.student_id) AS recommendations
FROM dedup d JOIN latest_one l ON l.student_id = d.student_id""", *_REC_VIEWS))
def j3_report_files(spark, sf_dir):
    """The report rows (J3) written as JSON by risk level and read back whole: details, prediction and every recommendation."""
    latest = I.latest_one(common.predictions(spark, sf_dir)).select("student_id", "risk_level", *_PREDICTION)
    reports = J.report_rows(dedup_first(common.students(spark, sf_dir)).join(latest, "student_id"))
    path = scratch_path(spark, "reports")
    J.write_reports(reports, path)
    back = spark.read.schema(reports.schema).json(path)
    line = lambda x: F.concat_ws("|", x["category"], x["priority"], x["icon"], x["message"], x["action"])
    return back.select("student_id", "report_risk_level", *[F.col(f"details.{c}").alias(c) for c in _DETAILS],
                       *[F.col(f"prediction.{c}").alias(c) for c in _PREDICTION],
                       F.array_join(F.transform("recommendations", line), "\n").alias("recommendations"))
