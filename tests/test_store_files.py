import pytest
from pyspark.sql import functions as F

from riskspark.operators import store as A
from riskspark.session import scratch_path
from riskspark.sources import files, synth
from tests.conftest import STUDENT_COLS, student_row


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_ordinal long, " + STUDENT_COLS)


def test_upsert_semantics(spark):
    existing = table(spark, [student_row("S1", name="old", att=50.0, quiz=10.0)])
    batch = spark.createDataFrame(
        [(10, *student_row("S1", name="n1", att=60.0, quiz=99.0)), (11, *student_row("S2", name="a", att=1.0)),
         (12, *student_row("S2", name="b", att=2.0, quiz=42.0)), (13, *student_row("S1", name="n2", att=70.0))],
        "row_ordinal long, " + STUDENT_COLS)
    out = {r.student_id: r for r in A.upsert(existing, batch).collect()}
    assert (out["S1"].name, out["S1"].attendance_percentage, out["S1"].quiz_score, out["S1"]._action) == \
        ("n2", 70.0, 10.0, "updated")
    assert (out["S2"].name, out["S2"].attendance_percentage, out["S2"].quiz_score, out["S2"]._action) == \
        ("b", 2.0, 60.0, "inserted")
    counts = {r._action: r.batch_rows_accepted for r in A.upsert_counts(A.upsert(existing, batch)).collect()}
    assert counts == {"updated": 2, "inserted": 2}


def test_foreign_key_and_cascades(spark):
    parent = spark.createDataFrame([("S1",), ("S2",)], "student_id string")
    child = spark.createDataFrame([(1, "S1"), (2, "S3"), (3, "S2")], "id int, student_id string")
    assert [r.id for r in A.fk_rejected(child, parent).collect()] == [2]
    assert sorted(r.id for r in A.cascade_delete(child, parent.filter("student_id = 'S1'")).collect()) == [1]
    m = spark.createDataFrame([("S1", "X1")], "old_key string, new_key string")
    assert sorted(r.student_id for r in A.cascade_rename(child, m).collect()) == ["S2", "S3", "X1"]


def test_conform_reasons(spark):
    rows = [student_row("S1", result="FAIL "), student_row("S2", result=" pass", att=None),
            student_row("S3", att=1234.5), student_row("S1"), student_row("S4", gender=None, age=300)]
    c = {(r.student_id, r.row_ordinal): r for r in A.conform(table(spark, rows)).collect()}
    assert c[("S1", 0)].reject_reasons == "" and c[("S1", 0)].result == "Fail"
    assert c[("S2", 1)].reject_reasons == "result not in domain"
    assert float(c[("S2", 1)].attendance_percentage) == 0.0
    assert c[("S3", 2)].reject_reasons == "attendance_percentage out of range"
    assert c[("S1", 3)].reject_reasons == "duplicate student_id"
    assert c[("S4", 4)].reject_reasons == "gender is null;age out of range"


def test_csv_roundtrip_with_na_tokens(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("student_id,name,age,attendance_percentage,result\n"
                 "S1,Ann,20,55.5, pass\nS2,NA,n/a,nan,\nS3,Bob,x,#N/A,Fail\n")
    df = files.read_csv(spark, str(p))
    rows = {r.student_id: r for r in df.collect()}
    assert rows["S1"].result == " pass" and rows["S1"].age == 20
    assert rows["S2"].name is None and rows["S2"].age is None and rows["S2"].attendance_percentage is None
    assert rows["S3"].age is None
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "missing.csv")).collect()


def test_csv_messy_header_extra_column_and_line_break(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('Student ID,Name,AGE,Extra\nS1,"Ann\nLee",21.0,x\nS2,Bob,21.5,NA\n')
    df = files.read_csv(spark, str(p))
    assert df.columns == ["student_id", "name", "age", "extra"]
    assert [tuple(r) for r in df.orderBy("student_id").collect()] == [("S1", "Ann\nLee", 21, "x"), ("S2", "Bob", None, None)]
    clash = tmp_path / "clash.csv"
    clash.write_text("Student ID,student_id\n1,2\n")
    with pytest.raises(ValueError, match="clash"):
        files.read_csv(spark, str(clash))


def test_csv_files_must_share_a_header(spark, tmp_path):
    for i, head in enumerate(["student_id,name", "name,student_id"]):
        (tmp_path / f"part-{i}.csv").write_text(f"{head}\na,b\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path)).collect()


def test_seeded_sample_is_partition_independent(spark):
    rows = table(spark, [student_row(f"S{i}") for i in range(60)])
    a = synth.seeded_sample(rows.repartition(1), 20, "student_id")
    b = synth.seeded_sample(rows.repartition(7), 20, "student_id")
    assert a.count() == 20 and "result" not in a.columns
    assert {r.student_id for r in a.collect()} == {r.student_id for r in b.collect()}


def test_fold_keeps_a_row_without_order(spark):
    b = table(spark, [student_row("S1", name="only")]).withColumn("row_ordinal", F.lit(None).cast("long"))
    assert A.fold_batch(b).first()._first.name == "only"
    assert A.lookup_first(b, b).first().name == "only"


def test_snapshot_never_overwrites(spark):
    df = spark.range(3)
    p = A.commit_snapshot(df)
    assert spark.read.parquet(p).count() == 3
    with pytest.raises(Exception):
        A.commit_snapshot(df, p)


def test_student_ids_never_truncated(spark):
    from riskspark.sources.fixtures import student_key
    got = [r[0] for r in spark.createDataFrame([(42,), (1234567,)], "k long").select(student_key(F.col("k"))).collect()]
    assert got == ["STU000042", "STU1234567"]


def test_metrics_contract_defaults_and_rejects(spark):
    rows = spark.createDataFrame([(1, "Random Forest", 0.91237, None), (2, None, 0.5, 1), (3, "x" * 51, 0.5, 1), (4, "Boosting", 100.0, 300)],
                                 "id long, model_name string, accuracy double, is_best int")
    full = rows.selectExpr("*", "0.5D AS precision_score", "0.5D AS recall", "0.5D AS f1_score").drop("auc")
    got = {r.id: r for r in A.conform(full.withColumn("auc", full.recall), A.METRICS_TABLE, None, "id").collect()}
    assert float(got[1].accuracy) == 0.9124 and got[1].is_best is None and got[1].reject_reasons == ""
    assert got[2].reject_reasons == "model_name is null" and got[3].reject_reasons == "model_name too long"
    assert got[4].reject_reasons == "accuracy out of range;is_best out of range"
    absent = A.conform(full.drop("is_best", "model_name"), A.METRICS_TABLE, None, "id").filter("id = 1").first()
    assert absent.is_best == 0 and absent.auc is None and absent.reject_reasons == "model_name is null"


def test_csv_splits_inside_quotes(spark, tmp_path):
    """Splits of a few bytes to a few kilobytes: every record is whole, whatever its line breaks and quotes."""
    import csv
    import io
    import random

    rng = random.Random(3)
    bits = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "\n\n", 'tail"', '"', "x" * 300, "late\n" * 80, "é", "", 'in 5" pipe'.replace('"', "''")]
    rows = [[f"S{i}", rng.choice(bits), rng.choice(bits), str(i)] for i in range(400)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([["Student ID", "Name", "Remark", "Age"], *rows])
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text(text.getvalue())
    more = [[f"T{i}", 'half 5" open', "b", "7"] for i in range(50)]  # a quote inside an unquoted field is a character
    (tmp_path / "a" / "two.csv").write_text("Student ID,Name,Remark,Age\r\n\r\n" + "".join(",".join(r) + "\r\n" for r in more))
    want = sorted((a, None if b in files.PANDAS_NA_TOKENS else b, None if c in files.PANDAS_NA_TOKENS else c, int(d)) for a, b, c, d in rows + more)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("97", "1000", "7001", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = files.read_csv(spark, str(tmp_path / "a"), position="place")
            got = df.collect()
            assert sorted(((r.student_id, r.name, r.remark, r.age) for r in got), key=str) == sorted(want, key=str), size
            in_order = [r.student_id for r in sorted(got, key=lambda r: tuple(r.place)) if r.student_id[0] == "S"]
            if size == "128m":
                assert in_order == [r[0] for r in rows]
            if size == "97":
                assert spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_csv_open_quote_runs_to_the_end(spark, tmp_path):
    (tmp_path / "x.csv").write_text('student_id,name\nS1,a\nS2,"never closed\nS3,b\n')
    assert [(r.student_id, r.name) for r in files.read_csv(spark, str(tmp_path / "x.csv")).orderBy("student_id").collect()] == [("S1", "a"), ("S2", "never closed\nS3,b")]
    (tmp_path / "y.csv").write_text("student_id,name\nS4,d\n")
    assert files.read_csv(spark, str(tmp_path)).count() == 3
    (tmp_path / "empty.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
