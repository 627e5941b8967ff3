import numpy as np
import pytest

from riskspark.operators import evaluate as E


def frame(spark, labels, scores, threshold=0.5):
    rows = [(int(y), int(s > threshold), float(s)) for y, s in zip(labels, scores)]
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def trapezoid_auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    P, N = (y == 1).sum(), (y == 0).sum()
    xs, ys = [0.0], [0.0]
    for t in sorted(set(s), reverse=True):
        xs.append(((s >= t) & (y == 0)).sum() / N)
        ys.append(((s >= t) & (y == 1)).sum() / P)
    return float(np.trapezoid(ys, xs))


def test_metrics_and_auc_match_hand_computation(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    s = np.round(np.clip(y * 0.3 + rng.uniform(0, 0.7, 200), 0, 1), 2)   # ties on purpose
    df = frame(spark, y, s)
    m = E.binary_metrics(df).first()
    p = (s > 0.5).astype(int)
    tp, fp, fn = int(((p == 1) & (y == 1)).sum()), int(((p == 1) & (y == 0)).sum()), int(((p == 0) & (y == 1)).sum())
    assert m.accuracy == round(float((p == y).mean()), 4)
    assert m.precision == round(tp / (tp + fp), 4)
    assert m.recall == round(tp / (tp + fn), 4)
    assert m.f1 == round(2 * tp / (2 * tp + fp + fn), 4)
    assert E.auc(df).first().auc == round(trapezoid_auc(y, s), 4)
    pts = E.roc_points(df, drop_intermediate=False).orderBy("fpr", "tpr").collect()
    assert (pts[0].fpr, pts[0].tpr) == (0.0, 0.0) and (pts[-1].fpr, pts[-1].tpr) == (1.0, 1.0)
    assert len(pts) == len(set(s)) + 1


def test_zero_division_and_one_class(spark):
    df = frame(spark, [1, 1, 1], [0.1, 0.2, 0.3])
    m = E.binary_metrics(df).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)
    assert E.auc(df).first().auc == 0.0


def test_confusion_matrix_has_all_cells(spark):
    cm = E.confusion_matrix(frame(spark, [1, 1], [0.9, 0.8])).collect()
    assert sorted((r.actual_class, r.predicted_class, r["count"]) for r in cm) == [
        ("Fail", "Fail", 0), ("Fail", "Pass", 0), ("Pass", "Fail", 0), ("Pass", "Pass", 2)]


def test_report_rows(spark):
    rep = {r.class_label: r for r in E.classification_report(frame(spark, [0, 1, 1, 0], [0.2, 0.9, 0.4, 0.6])).collect()}
    assert set(rep) == {"Fail", "Pass", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"].f1_score == 0.5 and rep["Pass"].support == 2


def test_metrics_table_best_and_long(spark):
    good = frame(spark, [0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8])
    bad = frame(spark, [0, 1, 0, 1], [0.9, 0.1, 0.8, 0.2])
    mt = E.metrics_table({"good": good, "bad": bad, "good2": good})
    best = {r.metric: r.best_model for r in E.best_per_metric(mt).collect()}
    assert best["auc"] == "good" and best["f1"] == "good"
    assert E.metrics_long(mt).count() == 15


def test_grouped_metrics_table_equals_per_model_operators(spark):
    rng = np.random.default_rng(7)
    frames = {}
    for name in ("a", "b", "c"):
        y = rng.integers(0, 2, 120)
        s = np.round(rng.uniform(0, 1, 120), 2)
        frames[name] = frame(spark, y, s)
    no_score = frame(spark, [0, 1, 1], [0.2, 0.7, 0.4]).drop("score")
    mt = {r.model: r for r in E.metrics_table({**frames, "d": no_score}).collect()}
    for name, df in frames.items():
        m, a = E.binary_metrics(df).first(), E.auc(df).first().auc
        got = mt[name]
        assert (got.accuracy, got.precision, got.recall, got.f1, got.auc) == (m.accuracy, m.precision, m.recall,
                                                                               m.f1, a)
    assert mt["d"].auc is None and mt["d"].accuracy == round(2 / 3, 4)


def thinned_roc(y, s):
    """Brute force: cumulative counts per distinct score, second differences, first/last kept."""
    y, s = np.asarray(y), np.asarray(s)
    ts = sorted(set(s), reverse=True)
    tps = np.array([((s >= t) & (y == 1)).sum() for t in ts])
    fps = np.array([((s >= t) & (y == 0)).sum() for t in ts])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True] if len(ts) > 2 else \
        np.ones(len(ts), bool)
    P, N = (y == 1).sum(), (y == 0).sum()
    return [(0.0, 0.0)] + [(round(f / N, 12), round(t / P, 12)) for f, t in zip(fps[keep], tps[keep])]


def test_roc_drop_intermediate_matches_second_differences(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.uniform(0, 1, 300), 2)          # many ties, many repeated steps
    df = frame(spark, y, s)
    got = sorted((round(r.fpr, 12), round(r.tpr, 12)) for r in E.roc_points(df).collect())
    assert got == sorted(thinned_roc(y, s))
    every = E.roc_points(df, drop_intermediate=False).count()
    assert every == len(set(s)) + 1 > len(got)


def test_auc_of_counts_past_a_long(spark, monkeypatch):
    from riskspark.operators import evaluate

    big = spark.createDataFrame([(0.9, 3_000_000_000, 1_000_000_000), (0.1, 1_000_000_000, 3_000_000_000)], "threshold double, pos long, neg long")
    monkeypatch.setattr(evaluate, "_score_groups", lambda *a, **k: big)
    assert evaluate.auc(None).first()["auc"] == 0.75
