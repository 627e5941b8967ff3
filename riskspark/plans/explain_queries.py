"""Registered attribution queries (2.H).

Oracle-checked form: the overall academic score is a linear scorer over five
raw columns with the reference's weights, so its exact Shapley values against
the cleaned table as background are ``w_j * (x_j - mean(x_j))``. Model-based
attributions (logistic regression, trees) are rows-only; tests check local
accuracy (base + sum = model output).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import np_round
from ..operators import explain as H
from . import common
from .sqlparts import CLEAN_SQL, STUDENTS_SQL, r, with_views

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


W = cfg.SCORE_WEIGHTS


def score_attributions(spark, sf_dir):
    c = common.cleaned(spark, sf_dir)
    return H.linear_attributions(c, W, H.background_means(c, list(W)))


_BG = "bg AS (SELECT " + ", ".join(f"AVG({f}) AS {f}" for f in W) + " FROM clean)"
_ATTR = "attr AS (" + " UNION ALL ".join(
    f"SELECT c.student_id, '{f}' AS feature, {w}E0 * (c.{f} - bg.{f}) AS value FROM clean c, bg"
    for f, w in W.items()) + ")"
_BASE = "base AS (SELECT " + " + ".join(f"{w}E0 * {f}" for f, w in W.items()) + " AS base_value FROM bg)"
_H_VIEWS = (STUDENTS_SQL, CLEAN_SQL, _BG, _ATTR, _BASE)


@register("h1_linear_attributions", with_views(
    f"SELECT student_id, feature, {r('value', 4)} AS shap_value FROM attr", *_H_VIEWS))
def h1_linear_attributions(spark, sf_dir):
    a = H.attributions_long(score_attributions(spark, sf_dir))
    return a.select("student_id", "feature", np_round("value", 4).alias("shap_value"))


@register("h2_global_importance", with_views(
    f"""SELECT feature, importance, CAST(ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, {r('AVG(ABS(value))', 4)} AS importance FROM attr GROUP BY feature) t""", *_H_VIEWS))
def h2_global_importance(spark, sf_dir):
    return H.global_importance(score_attributions(spark, sf_dir))


@register("h3_sorted_contributions", with_views(f"""
SELECT student_id, CAST(ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY v DESC, feature) - 1 AS INTEGER)
       AS position, feature, v AS shap_value
FROM (SELECT student_id, feature, {r('value', 4)} AS v FROM attr) t""", *_H_VIEWS))
def h3_sorted_contributions(spark, sf_dir):
    return H.sorted_contributions(score_attributions(spark, sf_dir))


def _waterfall_sql(max_display):
    keep = max_display - 1
    return f"""WITH ranked AS (
  SELECT student_id, feature, value,
         ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY ABS(value) DESC, feature) AS k,
         COUNT(*) OVER (PARTITION BY student_id) AS n FROM attr),
bars AS (
  SELECT student_id, CAST(k - 1 AS INTEGER) AS position, feature, value FROM ranked WHERE n <= {max_display} OR k <= {keep}
  UNION ALL
  SELECT student_id, {keep} AS position, CAST(MAX(n) - {keep} AS VARCHAR) || ' other features' AS feature,
         SUM(value) AS value FROM ranked WHERE n > {max_display} AND k > {keep} GROUP BY student_id)
SELECT b.student_id, {r('base.base_value', 4)} AS base_value, b.position, b.feature, {r('b.value', 4)} AS value
FROM bars b, base"""


def _waterfall(spark, sf_dir, max_display):
    w = H.waterfall(score_attributions(spark, sf_dir), max_display=max_display)
    return w.select("student_id", np_round("base_value", 4).alias("base_value"), "position", "feature",
                    np_round("value", 4).alias("value"))


@register("h4_waterfall", with_views(_waterfall_sql(cfg.WATERFALL_MAX_DISPLAY), *_H_VIEWS))
def h4_waterfall(spark, sf_dir):
    return _waterfall(spark, sf_dir, cfg.WATERFALL_MAX_DISPLAY)


@register("h4_waterfall_folded", with_views(_waterfall_sql(3), *_H_VIEWS))
def h4_waterfall_folded(spark, sf_dir):
    """max_display = 3: two largest bars, then one bar summing the remaining three features."""
    return _waterfall(spark, sf_dir, 3)


# -- model-based (rows-only) ----------------------------------------------------

@register("h1_model_linear_attributions")
def h1_model_linear_attributions(spark, sf_dir):
    """Logistic regression attributions (log-odds) of every student, training split as background."""
    from .ml_queries import trained
    from ..operators import models as D
    res = trained(spark, sf_dir)
    lr = res.models[D.LR]
    data = res.train.unionByName(res.test)
    return H.attributions_long(H.model_linear_attributions(lr, data, res.train))


@register("h1_tree_attributions")
def h1_tree_attributions(spark, sf_dir):
    """TreeSHAP of the forest (probability of Pass) for every student; local accuracy tested."""
    from .ml_queries import trained
    from ..operators import models as D
    res = trained(spark, sf_dir)
    data = res.train.unionByName(res.test)
    return H.attributions_long(H.tree_attributions(res.models[D.RF], data))


@register("h2_tree_global_importance")
def h2_tree_global_importance(spark, sf_dir):
    """Mean |TreeSHAP| per feature of the forest, every student as the explained set."""
    from .ml_queries import trained
    from ..operators import models as D
    res = trained(spark, sf_dir)
    data = res.train.unionByName(res.test)
    return H.global_importance(H.tree_attributions(res.models[D.RF], data))


@register("h1_sampled_probability")
def h1_sampled_probability(spark, sf_dir):
    """What each feature adds to the logistic regression's probability of Pass, for every student, with its error."""
    from .ml_queries import trained
    from ..operators import models as D
    res = trained(spark, sf_dir)
    data = res.train.unionByName(res.test)
    fn = H.logistic_probability(res.models[D.LR])
    return H.attributions_long(H.sampled_attributions(fn, data, H.background_table(res.train, cfg.MODEL_FEATURES)))
