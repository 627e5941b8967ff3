import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions import fixed1, np_round, py_capitalize, py_strip
from riskspark.operators import features as C
from tests.conftest import STUDENT_COLS, student_row


def test_np_round_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2.5,), (-0.125,)], "x double")
    got = [r[0] for r in df.select(np_round("x", 2)).collect()]
    assert got == [round(0.125, 2), 0.14, 2.5, -0.12]
    assert [r[0] for r in df.select(np_round("x", 0)).collect()] == [0.0, 0.0, 2.0, -0.0]


def test_python_fixed_point_format(spark):
    vals = [0.25, 0.35, 0.45, 1.05, 2.675, 1234.55, 150.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(fixed1("x")).collect()] == ["%.1f" % v for v in vals]


def test_python_strip_and_capitalize(spark):
    df = spark.createDataFrame([(" \tpASS\n",)], "s string")
    assert df.select(py_capitalize(py_strip("s"))).first()[0] == "Pass"


def test_golden_feature_row(spark):
    df = spark.createDataFrame([student_row("S1", att=80.0, asn=70.0, quiz=60.0, lab=65.0, mid=55.0,
                                            lms=60.0, vid=20, disc=10)], STUDENT_COLS)
    r = C.add_features(df).first()
    assert r.attendance_risk == 1
    assert r.assignment_completion_ratio == 0.7
    # 0.4*60 + 0.3*(20/60*100) + 0.3*(10/50*100) = 24 + 10 + 6
    assert r.engagement_score == 40.0
    assert r.performance_trend == 55.0 - (70.0 + 60.0) / 2
    assert r.overall_academic_score == pytest.approx(0.2 * 80 + 0.2 * 70 + 0.3 * 55 + 0.15 * 60 + 0.15 * 65)


def test_attendance_bands_and_caps(spark):
    rows = [student_row("a", att=85.0), student_row("b", att=84.99), student_row("c", att=75.0),
            student_row("d", att=74.9), student_row("e", att=None, vid=500, disc=500, lms=300.0)]
    got = {r.student_id: (r.attendance_risk, r.engagement_score, r.overall_academic_score)
           for r in C.add_features(spark.createDataFrame(rows, STUDENT_COLS)).collect()}
    assert [got[k][0] for k in "abcde"] == [2, 1, 1, 0, 0]
    assert got["e"][1] == 100.0          # capped inputs
    assert got["e"][2] is None           # NULL attendance -> NULL overall (pandas NaN)


def test_overall_score_skips_absent_columns_without_renormalising(spark):
    df = spark.createDataFrame([student_row("S1")], STUDENT_COLS).drop("lab_score")
    r = df.select(C.overall_academic_score(df.columns).alias("o")).first()
    assert r.o == pytest.approx(0.2 * 80 + 0.2 * 70 + 0.3 * 55 + 0.15 * 60, abs=0.005)


def test_describe_matches_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(1)
    vals = rng.uniform(0, 100, 57).round(2)
    df = spark.createDataFrame([(float(v),) for v in vals], "engagement_score double")
    got = C.describe_features(df, ["engagement_score"]).first()
    d = pd.Series(vals).describe()
    assert got["count"] == d["count"]
    for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"),
                         ("p75", "75%"), ("max", "max")]:
        assert got[ours] == pytest.approx(d[theirs], rel=1e-12)


def test_profile_axes(spark):
    df = spark.createDataFrame([student_row("S1", vid=90)], STUDENT_COLS)
    rows = C.profile_axes(df).orderBy("axis_no").collect()
    assert [r.axis for r in rows][0] == "Attendance" and len(rows) == 7
    assert rows[-1].value == 100.0 and rows[0].target == 75.0


def test_standalone_standardiser_population_sd_and_zero_variance(spark):
    from riskspark.operators import models as D
    x = [1.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([(f"S{i}", v, 5.0, None if i == 0 else v) for i, v in enumerate(x)],
                               "student_id string, a double, flat double, gappy double")
    st = D.fit_standardiser(df, ["a", "flat", "gappy"])
    assert st.means["a"] == pytest.approx(np.mean(x)) and st.scales["a"] == pytest.approx(np.std(x))  # ddof 0
    assert st.scales["flat"] == 1.0                        # zero spread: centred only
    assert st.means["gappy"] == pytest.approx(np.mean(x[1:]))   # NULLs ignored in the fit
    z = {r.student_id: r for r in D.standardise(df, st).collect()}
    assert z["S3"].a == pytest.approx((9.0 - np.mean(x)) / np.std(x))
    assert z["S1"].flat == 0.0 and z["S0"].gappy is None
    assert [r.feature for r in st.frame(spark).orderBy("position").collect()] == ["a", "flat", "gappy"]
