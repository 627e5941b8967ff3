import datetime as dt

from pyspark.sql import functions as F

from riskspark.operators import analytics as I
from riskspark.operators import recommend as G
from riskspark.operators import score as S
from tests.conftest import STRONG, STUDENT_COLS, WEAK, student_row


def recs(spark, rows, risks):
    df = spark.createDataFrame([(*r, k) for r, k in zip(rows, risks)], STUDENT_COLS + ", risk_level string")
    return {r.student_id: r.recommendations for r in G.with_recommendations(df).collect()}


def test_weak_high_risk_has_critical_first(spark):
    out = recs(spark, [student_row("W", **WEAK)], ["High Risk"])["W"]
    assert out[0].priority == "CRITICAL"
    assert [r.category for r in out][:2] == ["Attendance", "Remedial Support"]
    prio = [G.cfg.PRIORITY_RANK[r.priority] for r in out]
    assert prio == sorted(prio)
    assert "critically low (55.0%)" in out[0].message
    assert any("Only 4 lecture videos" in r.message for r in out)


def test_strong_low_risk_only_maintain(spark):
    out = recs(spark, [student_row("S", **STRONG)], ["Low Risk"])["S"]
    assert [(r.category, r.priority) for r in out] == [("Maintain Performance", "LOW")]


def test_attendance_elif_and_null_values(spark):
    out = recs(spark, [student_row("A", att=70.0), student_row("B", att=None, quiz=None)], ["Medium Risk", None])
    assert [r.priority for r in out["A"] if r.category == "Attendance"] == ["HIGH"]
    assert [r.category for r in out["B"]] == ["Maintain Performance"]


def test_display_line(spark):
    df = G.display_lines(G.with_recommendations(spark.createDataFrame([student_row("S", **STRONG)], STUDENT_COLS)))
    assert df.first().display_lines[0].startswith("⭐ **[LOW] Maintain Performance** — Great work")


def test_risk_bands_on_unrounded_probability(spark):
    df = spark.createDataFrame([(0.69996,), (0.4,), (0.39999,), (0.5,)], "p_fail double")
    rows = S.attach_risk(df, "p_fail").collect()
    assert [r.risk_level for r in rows] == ["Medium Risk", "Medium Risk", "Low Risk", "Medium Risk"]
    assert rows[0].fail_probability == 0.7 and rows[3].predicted_result == "Fail"   # tie -> Fail
    assert rows[0].confidence == 70.0


def test_latest_views_ties(spark):
    t = dt.datetime(2024, 1, 1)
    preds = spark.createDataFrame(
        [(1, "S1", t, "Low Risk", 10.0), (2, "S1", t, "High Risk", 80.0), (3, "S1", t - dt.timedelta(1), "Low Risk", 5.0),
         (4, "S2", t, "Medium Risk", 50.0)],
        "id long, student_id string, predicted_at timestamp, risk_level string, risk_score double")
    assert I.latest_with_ties(preds).filter("student_id = 'S1'").count() == 2
    one = {r.student_id: r.id for r in I.latest_one(preds).collect()}
    assert one == {"S1": 2, "S2": 4}
    hist = {r.id: r.history_position for r in I.prediction_history(preds).collect()}
    assert hist == {2: 1, 1: 2, 3: 3, 4: 1}


def test_dashboard_stats_empty_sums_are_null(spark):
    df = spark.createDataFrame([], STUDENT_COLS)
    r = I.dashboard_stats(df).first()
    assert r.total_students == 0 and r.avg_attendance == 0.0 and r.pass_count is None
