"""Student and prediction tables derived from the driver's TPC-H-style tables.

The test data has no student table, so ``students`` and ``predictions`` are
derived views: one student per customer (plus re-sent copies of every 40th
customer, to exercise de-duplication), with scores aggregated from that
customer's orders and line items; one prediction per event. The Spark side is
DataFrame code; ``STUDENTS_SQL`` / ``PREDICTIONS_SQL`` are the same views as
SQL text, used by the DuckDB oracle.

Scale: the only heavy step is lineitem -> orders -> customer. Line items are
aggregated per order before the join (see ``line_stats``), the join is on the
order key, and the per-customer roll-up is partial (map-side) before its
shuffle, so a customer holding a third of all lines is pre-aggregated per map
task. ``nation`` (25 rows) is
broadcast by the planner under the autoBroadcastJoinThreshold size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

DUP_EVERY = 40
DUP_OFFSET = 1_000_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def student_key(col) -> F.Column:
    """``STU`` + the key zero-padded to at least 6 digits (never truncated: ``lpad`` would
    cut longer keys and merge distinct customers once keys pass 999,999)."""
    return F.format_string("STU%06d", col.cast("long"))


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer line statistics.

    Aggregated per order first (lineitem -> one row per order, partial
    aggregation on the map side), then joined to orders and rolled up per
    customer: the join carries one row per order instead of one per line, and
    the distinct order count becomes a plain count. The per-order aggregate is
    already hash-partitioned on the order key, so the join reuses it.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_discount", "l_tax", "l_quantity")
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("kept"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tax"),
        F.sum(F.round(F.col("l_quantity")).cast("bigint")).alias("qty"),
    )
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = o.join(per_order, per_order.l_orderkey == o.o_orderkey)
    return j.groupBy(F.col("o_custkey").alias("k")).agg(
        F.sum("lines").alias("n_lines"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("kept").alias("n_kept"),
        F.sum("disc").alias("disc_pts"),
        F.sum("tax").alias("tax_pts"),
        F.sum("qty").alias("qty_pts"),
        F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("lines")).otherwise(0))
        .alias("n_hi"),
    )


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw student table (with NULLs, duplicates, odd labels); ``row_ordinal`` gives input order."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = line_stats(spark, sf_dir)
    k = F.col("c_custkey")
    att = (F.col("c_acctbal") + 1000) / 100
    base = (
        c.join(n, n.n_nationkey == c.c_nationkey)
        .join(li, li.k == c.c_custkey, "left")
        .select(
            k.alias("row_ordinal"),
            student_key(k).alias("student_id"),
            F.col("c_name").alias("name"),
            F.when(k % 17 == 0, F.lit(None).cast("string"))
            .when(k % 3 == 0, "Male").when(k % 3 == 1, "Female").otherwise("Other").alias("gender"),
            F.when(k % 23 == 0, F.lit(None).cast("int")).when(k % 50 == 1, F.lit(45))
            .otherwise((F.lit(18) + k % 7).cast("int")).alias("age"),
            F.when(k % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("department"),
            F.when(k % 19 == 0, F.lit(None).cast("double")).otherwise(att).alias("attendance_percentage"),
            F.when(k % 31 == 0, F.lit(None).cast("double"))
            .otherwise(F.lit(100.0) * F.col("n_kept") / F.col("n_lines")).alias("assignment_score"),
            (F.lit(10.0) * F.col("disc_pts") / F.col("n_lines")).alias("quiz_score"),
            (F.lit(12.5) * F.col("tax_pts") / F.col("n_lines")).alias("lab_score"),
            (F.lit(2.0) * F.col("qty_pts") / F.col("n_lines")).alias("midterm_marks"),
            (F.lit(100.0) * F.col("n_hi") / F.col("n_lines")).alias("lms_activity"),
            F.col("n_lines").cast("int").alias("videos_watched"),
            F.col("n_orders").cast("int").alias("discussion_participation"),
            F.when(k % 37 == 0, F.lit(None).cast("string"))
            .when(att + (k * 7919) % 41 - 20 >= 50, " pass").otherwise("FAIL ").alias("result"),
        )
    )
    # Every DUP_EVERY-th customer is sent twice. One pass: each row explodes into
    # one or two copies in the same stage, so the line-item aggregate is computed
    # once (a union of two filtered branches would scan and aggregate it twice).
    ro = F.col("row_ordinal")
    copies = F.when(ro % DUP_EVERY == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dup = F.col("_dup")
    return base.select("*", F.explode(copies).alias("_dup")).select(
        F.when(dup, ro + DUP_OFFSET).otherwise(ro).alias("row_ordinal"),
        "student_id",
        F.when(dup, F.concat(F.col("name"), F.lit(" (dup)"))).otherwise(F.col("name")).alias("name"),
        *[c for c in base.columns if c not in ("row_ordinal", "student_id", "name")],
    )


def predictions(spark: SparkSession, sf_dir: str, full: bool = False) -> DataFrame:
    """Prediction history: one row per event. ``full`` adds result, pass probability, confidence."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    p = F.col("value") / (F.col("value") + 50)
    out = e.select(
        F.col("event_id").alias("id"),
        student_key(F.col("user_id")).alias("student_id"),
        F.col("ts").alias("predicted_at"),
        F.round(p, 4).alias("fail_probability"),
        F.round(100 * p, 2).alias("risk_score"),
        F.when(p >= 0.70, "High Risk").when(p >= 0.40, "Medium Risk").otherwise("Low Risk").alias("risk_level"),
    )
    if full:
        out = out.withColumns({
            "predicted_result": F.when(F.col("fail_probability") >= 0.5, "Fail").otherwise("Pass"),
            "pass_probability": F.round(1 - F.col("fail_probability"), 4),
            "confidence": F.round(F.greatest(F.col("fail_probability"), 1 - F.col("fail_probability")) * 100, 2),
        })
    return out


# ---------------------------------------------------------------------------
# The same views as SQL text (DuckDB oracle). Kept verbatim-equivalent to the
# DataFrame code above.
# ---------------------------------------------------------------------------

STUDENTS_SQL = """
li AS (
  SELECT o.o_custkey AS k, COUNT(*) AS n_lines, COUNT(DISTINCT o.o_orderkey) AS n_orders,
         SUM(CASE WHEN l.l_returnflag <> 'R' THEN 1 ELSE 0 END) AS n_kept,
         SUM(CAST(ROUND(l.l_discount * 100) AS BIGINT)) AS disc_pts,
         SUM(CAST(ROUND(l.l_tax * 100) AS BIGINT)) AS tax_pts,
         SUM(CAST(ROUND(l.l_quantity) AS BIGINT)) AS qty_pts,
         SUM(CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) AS n_hi
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey),
student_base AS (
  SELECT c.c_custkey AS row_ordinal,
    printf('STU%06d', CAST(c.c_custkey AS BIGINT)) AS student_id, c.c_name AS name,
    CASE WHEN c.c_custkey % 17 = 0 THEN NULL WHEN c.c_custkey % 3 = 0 THEN 'Male' WHEN c.c_custkey % 3 = 1 THEN 'Female' ELSE 'Other' END AS gender,
    CASE WHEN c.c_custkey % 23 = 0 THEN NULL WHEN c.c_custkey % 50 = 1 THEN 45 ELSE CAST(18 + c.c_custkey % 7 AS INTEGER) END AS age,
    CASE WHEN c.c_custkey % 29 = 0 THEN NULL ELSE n.n_name END AS department,
    CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE (c.c_acctbal + 1000) / 100 END AS attendance_percentage,
    CASE WHEN c.c_custkey % 31 = 0 THEN NULL ELSE 100.0E0 * li.n_kept / li.n_lines END AS assignment_score,
    10.0E0 * li.disc_pts / li.n_lines AS quiz_score,
    12.5E0 * li.tax_pts / li.n_lines AS lab_score,
    2.0E0 * li.qty_pts / li.n_lines AS midterm_marks,
    100.0E0 * li.n_hi / li.n_lines AS lms_activity,
    CAST(li.n_lines AS INTEGER) AS videos_watched, CAST(li.n_orders AS INTEGER) AS discussion_participation,
    CASE WHEN c.c_custkey % 37 = 0 THEN NULL
         WHEN (c.c_acctbal + 1000) / 100 + (c.c_custkey * 7919) % 41 - 20 >= 50 THEN ' pass' ELSE 'FAIL ' END AS result
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN li ON li.k = c.c_custkey),
students AS (
  SELECT * FROM student_base
  UNION ALL
  SELECT row_ordinal + 1000000000, student_id, CONCAT(name, ' (dup)'), gender, age, department, attendance_percentage,
    assignment_score, quiz_score, lab_score, midterm_marks, lms_activity, videos_watched, discussion_participation, result
  FROM student_base WHERE row_ordinal % 40 = 0)"""

PREDICTIONS_SQL = """
predictions AS (
  SELECT event_id AS id, printf('STU%06d', CAST(user_id AS BIGINT)) AS student_id, ts AS predicted_at,
    ROUND(value / (value + 50), 4) AS fail_probability, ROUND(100 * (value / (value + 50)), 2) AS risk_score,
    CASE WHEN value / (value + 50) >= 0.70 THEN 'High Risk' WHEN value / (value + 50) >= 0.40 THEN 'Medium Risk'
         ELSE 'Low Risk' END AS risk_level,
    CASE WHEN ROUND(value / (value + 50), 4) >= 0.5 THEN 'Fail' ELSE 'Pass' END AS predicted_result,
    ROUND(1 - ROUND(value / (value + 50), 4), 4) AS pass_probability,
    ROUND(GREATEST(ROUND(value / (value + 50), 4), 1 - ROUND(value / (value + 50), 4)) * 100, 2) AS confidence
  FROM events)"""


def with_views(body: str, *views: str) -> str:
    """``WITH <views> <body>``; views are CTE fragments (``STUDENTS_SQL`` etc.)."""
    ctes = ",\n".join(v.strip() for v in views)
    body = body.strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH" and body[4:5].isspace():
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
