"""Kept tables: bucketed upserts, stale writers, single-key reads, numbered and checked appends."""

import pytest
from pyspark.sql import functions as F

from riskspark.operators import store, tables
from riskspark.session import scratch_path
from tests.conftest import STUDENT_COLS, student_row


def rows(spark, students):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(students)], "row_ordinal long, " + STUDENT_COLS)


@pytest.fixture()
def path(spark):
    path = scratch_path(spark, "tables")
    tables.create(spark, path, tables.table_schema(store.STUDENTS_TABLE), buckets=8)
    return path


def test_upsert_rewrites_touched_buckets_only(spark, path):
    first = tables.upsert(spark, path, rows(spark, [student_row(f"S{i}", att=50.0, quiz=10.0) for i in range(60)]))
    assert (first["inserted"], first["updated"], first["rejected"], first["buckets"], first["version"]) == (60, 0, 0, 8, 1)
    before = {p["bucket"]: p["dir"] for p in tables.latest(spark, path).parts}
    batch = [student_row("S7", name="n1", att=60.0, quiz=99.0), student_row("S7", name="n2", att=70.0), student_row("S7", att=99999.0),
             student_row("S8", gender=None), student_row("S7", name="x" * 101)]
    got = tables.upsert(spark, path, rows(spark, batch))
    assert {k: got[k] for k in ("inserted", "updated", "accepted", "rejected", "buckets")} == {"inserted": 0, "updated": 1, "accepted": 2, "rejected": 3, "buckets": 1}
    after = {p["bucket"]: p["dir"] for p in tables.latest(spark, path).parts}
    assert sum(before[b] != after[b] for b in before) == 1
    r = tables.read(spark, path, ["S7"]).first()
    assert (r.name, float(r.attendance_percentage), float(r.quiz_score)) == ("n2", 70.0, 10.0)
    assert tables.read(spark, path).count() == 60
    assert sorted(x.reject_reasons for x in tables.rejects(spark, path).collect()) == ["attendance_percentage out of range", "gender is null", "name too long"]
    refused = tables.upsert(spark, path, rows(spark, [student_row("S9", age=1000)]))
    assert (refused["version"], refused["rejected"]) == (got["version"], 1)


def test_a_stale_writer_is_refused(spark, path):
    base = tables.latest(spark, path)
    tables.upsert(spark, path, rows(spark, [student_row("S1", name="one")]), base=base)
    with pytest.raises(tables.StaleBase):
        tables.upsert(spark, path, rows(spark, [student_row("S1", name="two"), student_row("S2")]), base=base)
    assert [(r.student_id, r.name) for r in tables.read(spark, path).collect()] == [("S1", "one")]
    assert tables.upsert(spark, path, rows(spark, [student_row("S2")]))["version"] == 2  # from the version that is there


def test_single_key_read(spark, path):
    tables.upsert(spark, path, rows(spark, [student_row(f"S{i}") for i in range(200)]))
    one = tables.read(spark, path, ["S17"])
    assert [r.student_id for r in one.collect()] == ["S17"]
    assert len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) == 1 < len({f.rsplit("/", 2)[1] for f in tables.read(spark, path).inputFiles()})
    assert "PushedFilters: [In(student_id, [S17])]" in one._jdf.queryExecution().executedPlan().toString() or "EqualTo(student_id,S17)" in one._jdf.queryExecution().executedPlan().toString()
    assert tables.read(spark, path, ["S999", "S3"]).count() == 1
    assert tables.read(spark, path, []).count() == 0


def prediction(i, sid="S1", **more):
    return (i, sid, more.get("result", "Fail"), more.get("level", "High Risk"), more.get("score", 80.0), 0.2, 0.8, 80.0)


def predictions(spark, values):
    return spark.createDataFrame(values, "row_ordinal long, student_id string, predicted_result string, risk_level string, risk_score double, "
                                 "pass_probability double, fail_probability double, confidence double")


def test_append_numbers_and_checks(spark):
    path = scratch_path(spark, "tables")
    tables.create(spark, path, tables.log_schema(store.PREDICTIONS_TABLE, "predicted_at"), buckets=0)
    parent = spark.createDataFrame([("S1",), ("S2",), ("S2",)], "student_id string")
    args = dict(rules=store.PREDICTIONS_TABLE, order_cols=["row_ordinal"], parent=parent, ts_col="predicted_at")
    values = [prediction(i, "S1" if i % 2 else "S2") for i in range(40, 0, -1)] + [prediction(50, "S9"), prediction(51, level="Severe"), prediction(52, "S9", score=1e9), prediction(53, None)]
    got = tables.append(spark, path, predictions(spark, values).repartition(5), batch="a", **args)
    assert (got["accepted"], got["rejected"], got["first_id"]) == (40, 4, 1)
    assert tables.append(spark, path, predictions(spark, values), batch="a", **args)["accepted"] == 0  # run again
    got = tables.append(spark, path, predictions(spark, [prediction(7), prediction(3)]), batch="b", **args)
    assert got["first_id"] == 41
    out = tables.read(spark, path).orderBy("id").collect()
    assert [r.id for r in out] == list(range(1, 43))
    assert [r.student_id for r in out[:4]] == ["S1", "S2", "S1", "S2"] and all(r.predicted_at is not None for r in out)
    reasons = sorted(r.reject_reasons for r in tables.rejects(spark, path).collect())
    assert reasons == ["risk_level not in domain", "risk_score out of range;unknown student_id", "student_id is null", "unknown student_id"]
    nothing = tables.append(spark, path, predictions(spark, [prediction(1, "S9")]), batch="c", **args)
    assert (nothing["accepted"], nothing["rejected"], tables.read(spark, path).count()) == (0, 1, 42)


def test_empty_batches(spark, path):
    assert tables.upsert(spark, path, rows(spark, []).limit(0))["accepted"] == 0
    assert tables.read(spark, path).count() == 0 and tables.rejects(spark, path) is None
    with pytest.raises(ValueError):
        tables.latest(spark, scratch_path(spark, "tables"))
