"""Evaluation operators on (label, prediction, score) frames (survey 2.E).

Everything is an aggregate over the scored rows; the ROC curve and AUC need a
global order of scores, which ``running_totals`` provides after compacting to
one row per distinct score (so a score shared by a third of all rows is a
single row, counted map-side).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import np_round, safe_ratio
from .ordered import running_totals

CLASS_NAMES = {0: "Fail", 1: "Pass"}


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn (class 1 = positive); one row, or one per group."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*group_cols).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def _metric_exprs():
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": np_round(safe_ratio(tp + tn, tp + fp + fn + tn), 4),
        "precision": np_round(safe_ratio(tp, tp + fp), 4),
        "recall": np_round(safe_ratio(tp, tp + fn), 4),
        "f1": np_round(safe_ratio(2 * tp, 2 * tp + fp + fn), 4),
    }


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1; zero division -> 0; 4 dp."""
    return confusion_counts(df, label, pred).select(*[e.alias(k) for k, e in _metric_exprs().items()])


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """All four (actual, predicted) cells in Fail, Pass order, empty cells as 0."""
    counts = df.groupBy(F.col(label).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(4).select((F.col("id") / 2).cast("int").alias("actual"),
                                          (F.col("id") % 2).cast("int").alias("predicted"))
    names = F.create_map(F.lit(0), F.lit("Fail"), F.lit(1), F.lit("Pass"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        names[F.col("actual")].alias("actual_class"), names[F.col("predicted")].alias("predicted_class"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class precision/recall/F1/support, accuracy, macro and weighted averages (4 dp)."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    # class 1 positive: (tp, fp, fn); class 0 positive: (tn, fn, fp)
    p1, r1 = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    p0, r0 = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp)
    f1_1, f1_0 = safe_ratio(2 * tp, 2 * tp + fp + fn), safe_ratio(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = safe_ratio(tp + tn, n)
    rows = [
        ("Fail", p0, r0, f1_0, s0), ("Pass", p1, r1, f1_1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        ("weighted avg", safe_ratio(p0 * s0 + p1 * s1, n), safe_ratio(r0 * s0 + r1 * s1, n),
         safe_ratio(f1_0 * s0 + f1_1 * s1, n), n),
    ]
    structs = [F.struct(F.lit(k).alias("class_label"), np_round(p, 4).alias("precision"),
                        np_round(rc, 4).alias("recall"), np_round(f, 4).alias("f1_score"),
                        s.cast("bigint").alias("support")) for k, p, rc, f, s in rows]
    return c.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _score_groups(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score",
               drop_intermediate: bool = True) -> DataFrame:
    """ROC points over distinct scores (descending) with cumulative TPR/FPR, plus the (0, 0) origin.

    ``drop_intermediate`` (scikit-learn's default) drops a middle point when the
    step into it equals the step out of it; the step out of point m is the next
    point's own (pos, neg) count, so one equi-join on the point's position (itself a
    distributed running count) finds it. ``False`` keeps every point (AUC unchanged).
    """
    g = _score_groups(df, label, score).withColumn("_one", F.lit(1))
    cum = running_totals(g, ["threshold"], ["pos", "neg", "_one"], descending=True)
    # class totals are two scalars (fitted like any model parameter), read from the checkpoint
    tot = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    n_pos, n_neg = int(tot["P"] or 0), int(tot["N"] or 0)
    if drop_intermediate:
        nxt = cum.select((F.col("_one_cum") - 1).alias("_at"), F.col("pos").alias("_npos"),
                         F.col("neg").alias("_nneg"))
        cum = cum.join(nxt, cum["_one_cum"] == nxt["_at"], "left").where(
            (F.col("_one_cum") == 1) | F.col("_at").isNull()
            | (F.col("_npos") != F.col("pos")) | (F.col("_nneg") != F.col("neg")))
    pts = cum.select("threshold", safe_ratio(F.col("neg_cum"), F.lit(n_neg)).alias("fpr"),
                     safe_ratio(F.col("pos_cum"), F.lit(n_pos)).alias("tpr"))
    origin = g.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                            F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def auc(df: DataFrame, label: str = "label", score: str = "score",
        group_cols: Sequence[str] = ()) -> DataFrame:
    """E5: trapezoidal area under the ROC curve, 4 dp; one row, or one per group.

    Each distinct score s adds neg(s)/N * (2 * pos_above(s) + pos(s)) / (2P): the
    trapezoid between consecutive ROC points, so the sum is order-free.
    """
    group_cols = list(group_cols)
    g = _score_groups(df, label, score, group_cols)
    cum = running_totals(g, ["threshold"], ["pos"], group_cols=group_cols, descending=True)
    # counts of 10^9 multiply past a long: exact decimals for the sum, doubles for the ratio
    wide = lambda c: c.cast("decimal(19,0)")
    area = cum.groupBy(*group_cols).agg(
        F.sum(wide(F.col("neg")) * wide(2 * (F.col("pos_cum") - F.col("pos")) + F.col("pos"))).cast("double").alias("a"),
        F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"))
    return area.select(*group_cols, np_round(safe_ratio(F.col("a"), 2 * F.col("P") * F.col("N")), 4).alias("auc"))


def metrics_table(scored: dict[str, DataFrame], label: str = "label", pred: str = "prediction",
                  score: str | None = "score") -> DataFrame:
    """One row per model: accuracy, precision, recall, F1 and (when scores exist) AUC.

    ``scored`` maps model name -> its (label, prediction, score) frame. The
    frames are tagged and unioned, so all models share one grouped aggregate
    and one grouped AUC (a single shuffle each, however many models), and
    subplans the frames have in common are computed once.
    """
    keys = ["model_order", "model"]
    tagged = []
    for i, (name, df) in enumerate(scored.items()):
        has_score = score is not None and score in df.columns
        tagged.append(df.select(F.lit(i).alias("model_order"), F.lit(name).alias("model"),
                                F.col(label).alias("_y"), F.col(pred).alias("_p"),
                                (F.col(score).cast("double") if has_score else F.lit(None).cast("double"))
                                .alias("_s"), F.lit(has_score).alias("_has_score")))
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    counts = confusion_counts(rows, "_y", "_p", keys)
    out = counts.select(*keys, *[e.alias(k) for k, e in _metric_exprs().items()])
    areas = auc(rows.filter("_has_score"), "_y", "_s", keys)
    return out.join(areas, keys, "left").select(*keys, *METRIC_COLUMNS)


METRIC_COLUMNS = ["accuracy", "precision", "recall", "f1", "auc"]


def best_per_metric(metrics: DataFrame, metric_cols=METRIC_COLUMNS) -> DataFrame:
    """Best value per metric column and the model holding it (first in model order on ties)."""
    long = metrics_long(metrics, metric_cols)
    return long.where(F.col("value").isNotNull()).groupBy("metric").agg(
        F.max("value").alias("best_value"),
        F.min_by("model", F.struct((-F.col("value")).alias("neg"), F.col("model_order"))).alias("best_model"))


def metrics_long(metrics: DataFrame, metric_cols=METRIC_COLUMNS) -> DataFrame:
    """(model, metric, value)."""
    return metrics.unpivot(["model_order", "model"], list(metric_cols), "metric", "value")
