"""Scoring operators (survey 2.F): probabilities -> result, bands and display numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import np_round


def risk_level(fail_prob, params: cfg.RiskParams = cfg.RiskParams()) -> F.Column:
    """band on the unrounded fail probability."""
    p = F.col(fail_prob) if isinstance(fail_prob, str) else fail_prob
    return F.when(p >= params.high, params.label_high).when(p >= params.medium, params.label_medium) \
        .otherwise(params.label_low)


def predicted_result(fail_prob, pass_prob) -> F.Column:
    """Pass only when the pass probability is strictly larger (argmax picks Fail on a tie)."""
    return F.when(pass_prob > fail_prob, "Pass").otherwise("Fail")


def with_record_identity(df: DataFrame, key: str = cfg.ID_COLUMN, name: str = "name") -> DataFrame:
    """records without an id or name column report ``UNKNOWN`` / ``Unknown``.

    Only an absent column takes the default; a NULL value stays NULL (a missing key
    versus a key holding None, as in the reference's record lookup).
    """
    defaults = {c: F.lit(v) for c, v in ((key, cfg.UNKNOWN_ID), (name, cfg.UNKNOWN_NAME)) if c not in df.columns}
    return df.withColumns(defaults) if defaults else df


def attach_risk(df: DataFrame, fail_col: str = "p_fail", pass_col: str | None = None,
                params: cfg.RiskParams = cfg.RiskParams(), drop_inputs: bool = True) -> DataFrame:
    """The six scoring columns from class probabilities (pass = 1 - fail when absent)."""
    fail = F.col(fail_col)
    pas = F.col(pass_col) if pass_col else (F.lit(1.0) - fail)
    out = df.withColumns({
        "predicted_result": predicted_result(fail, pas),
        "pass_probability": np_round(pas, 4),
        "fail_probability": np_round(fail, 4),
        "risk_score": np_round(fail * 100, 2),
        "risk_level": risk_level(fail, params),
        "confidence": np_round(F.greatest(pas, fail) * 100, 2),
    })
    if drop_inputs:
        out = out.drop(*[c for c in (fail_col, pass_col) if c and c not in (
            "pass_probability", "fail_probability")])
    return out


def gauge_band(score="risk_score", steps=cfg.GAUGE_STEPS) -> F.Column:
    """which gauge step (0-40, 40-70, 70-100) a risk score falls in; lower bound inclusive."""
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for lo, hi in steps:
        cond = (s >= lo) & ((s < hi) if hi != steps[-1][1] else (s <= hi))
        expr = F.when(cond, f"{lo}-{hi}") if expr is None else expr.when(cond, f"{lo}-{hi}")
    return expr
