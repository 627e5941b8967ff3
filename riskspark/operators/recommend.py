"""Rule-based recommendations (survey 2.G), evaluated for a whole table at once.

Each rule is a ``when(condition, struct)``; the fired ones are filtered,
sorted by (priority rank, rule number) and stripped of the sort keys -- all
JVM-side higher-order functions, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import fixed1, trunc_int_str

REC_FIELDS = ["category", "priority", "icon", "message", "action"]


def _value(df: DataFrame, col: str) -> F.Column:
    if col in df.columns:
        return F.col(col).cast("double")
    return F.lit(cfg.REC_ABSENT_DEFAULTS[col])


def _message(template: str, v: F.Column) -> F.Column:
    parts = []
    rest = template
    while rest:
        i_v, i_n = rest.find("{v}"), rest.find("{n}")
        idx = min([i for i in (i_v, i_n) if i >= 0], default=-1)
        if idx < 0:
            parts.append(F.lit(rest))
            break
        if idx:
            parts.append(F.lit(rest[:idx]))
        parts.append(fixed1(v) if rest.startswith("{v}", idx) else trunc_int_str(v))
        rest = rest[idx + 3:]
    return F.concat(*parts)


def _rec(rule_no: int, category, priority, icon, message: F.Column, action) -> F.Column:
    return F.struct(F.lit(cfg.PRIORITY_RANK[priority]).alias("rank"), F.lit(rule_no).alias("rule_no"),
                    F.lit(category).alias("category"), F.lit(priority).alias("priority"),
                    F.lit(icon).alias("icon"), message.alias("message"), F.lit(action).alias("action"))


def recommendation_array(df: DataFrame, risk_col: str = "risk_level", thresholds=cfg.REC_THRESHOLDS) -> F.Column:
    """G1 + G2: ARRAY<STRUCT<category, priority, icon, message, action>> in priority order."""
    fired = []
    att_critical = None
    for i, (rule, col, tkey, category, priority, icon, msg, action) in enumerate(cfg.RECOMMENDATION_RULES):
        v = _value(df, col)
        cond = v < thresholds[tkey]
        if rule == "attendance_critical":
            att_critical = cond
        elif rule == "attendance_low":
            cond = cond & ~att_critical  # the reference's elif
        fired.append(F.when(cond, _rec(i + 1, category, priority, icon, _message(msg, v), action)))
    risk = F.col(risk_col) if risk_col in df.columns else F.lit(None).cast("string")
    n = len(cfg.RECOMMENDATION_RULES) + 1
    branch = None
    for level, category, priority, icon, msg, action in cfg.RISK_RECOMMENDATIONS:
        rec = _rec(n, category, priority, icon, F.lit(msg), action)
        if level is None:
            branch = branch.otherwise(rec)
        else:
            branch = F.when(risk == level, rec) if branch is None else branch.when(risk == level, rec)
    fired.append(branch)
    ordered = F.array_sort(F.filter(F.array(*fired), lambda x: x.isNotNull()))
    return F.transform(ordered, lambda x: F.struct(*[x[f].alias(f) for f in REC_FIELDS]))


def with_recommendations(df: DataFrame, risk_col: str = "risk_level", out: str = "recommendations") -> DataFrame:
    return df.withColumn(out, recommendation_array(df, risk_col))


def explode_recommendations(df: DataFrame, keys=("student_id",), col: str = "recommendations") -> DataFrame:
    """One row per recommendation with its 0-based position."""
    return df.select(*keys, F.posexplode(col).alias("position", "rec")).select(
        *keys, "position", *[F.col(f"rec.{f}").alias(f) for f in REC_FIELDS])


def display_line(rec: F.Column) -> F.Column:
    """``{icon} **[{priority}] {category}** — {message} *→ {action}*``."""
    return F.concat(rec["icon"], F.lit(" **["), rec["priority"], F.lit("] "), rec["category"],
                    F.lit("** — "), rec["message"], F.lit(" *→ "), rec["action"], F.lit("*"))


def display_lines(df: DataFrame, col: str = "recommendations", out: str = "display_lines") -> DataFrame:
    return df.withColumn(out, F.transform(F.col(col), display_line))
