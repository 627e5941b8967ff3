"""Table maintenance on Parquet snapshots (survey 2.A: A3-A12).

Parquet has no MERGE, unique key or foreign key, so each relational guarantee
of the reference's tables is a set operation:

* upsert   -- fold the batch per key (partial ``min``/``max`` of the order), full outer
              join with the current snapshot, write a new snapshot;
* FK       -- ``left_semi`` keeps, ``left_anti`` rejects, cascades are joins;
* DDL      -- every row checked against the column contract, split into
              accepted (conformed types) and rejected (with reasons).

Joins on the student key carry at most one row per key on one side (the folded
batch, the snapshot); AQE's skew-join split handles a hot key on the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as cfg
from ..session import scratch_path
from .ordered import first_rows

UPDATE_ON_DUPLICATE = ["name", "attendance_percentage"]


# -- A3-A5 ------------------------------------------------------------------

def scan_ordered(table: DataFrame, key: str = cfg.ID_COLUMN) -> DataFrame:
    """A3: full scan ordered by key (global sort = range partitioning, no single task)."""
    tie = ["row_ordinal"] if "row_ordinal" in table.columns else []
    return table.orderBy(key, *tie)


def select_with_params(spark, query: str, args: dict, **frames) -> DataFrame:
    """A4: parameterised SELECT; values are bound, never spliced into the text."""
    return spark.sql(query, args=args, **frames)


def lookup_first(table: DataFrame, keys: DataFrame, key: str = cfg.ID_COLUMN,
                 order_col: str = "row_ordinal") -> DataFrame:
    """A5 for a batch of ids: the first matching row per requested id."""
    return first_rows(table.join(keys.select(key).distinct(), key, "left_semi").select(*table.columns), key, order_col)


# -- A6 / A7 ------------------------------------------------------------------

def fold_batch(batch: DataFrame, key: str = cfg.ID_COLUMN, update_cols=UPDATE_ON_DUPLICATE,
               order_col: str = "row_ordinal") -> DataFrame:
    """Per key ``_first`` (the first row's columns), ``_last`` (the ``update_cols`` of the last row) and the row count.

    First, last and count are one hash aggregate; a join on (key, order) fetches the two rows' columns."""
    others = [c for c in batch.columns if c != key]
    at, k = F.col(order_col), F.col(key)
    ends = batch.groupBy(k.alias("_k")).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count(F.lit(1)).alias("_batch_rows"))
    on = k.eqNullSafe(F.col("_k")) & (at.eqNullSafe(F.col("_lo")) | at.eqNullSafe(F.col("_hi")))
    among = F.row_number().over(Window.partitionBy("_k", at).orderBy(at))
    rows = batch.join(ends.hint("shuffle_hash"), on).withColumn("_of", among).filter("_of = 1")  # any one of equal orders
    pick = lambda c, cols: F.get(F.collect_list(F.when(at.eqNullSafe(F.col(c)), F.struct(*cols))), F.lit(0))  # noqa: E731  one row at most
    return rows.groupBy(k).agg(pick("_lo", others).alias("_first"), pick("_hi", update_cols).alias("_last"), F.first("_batch_rows").alias("_batch_rows"))


def upsert(existing: DataFrame, batch: DataFrame, key: str = cfg.ID_COLUMN,
           update_cols=UPDATE_ON_DUPLICATE, order_col: str = "row_ordinal") -> DataFrame:
    """New snapshot. New key -> insert the first batch row; existing key -> only
    ``update_cols`` change, to the last batch row's values. Adds ``_action``."""
    folded = fold_batch(batch.select(*existing.columns), key, update_cols, order_col)
    e = existing.withColumn("_exists", F.lit(True))
    j = e.join(folded, key, "full_outer")
    cols = []
    for c in existing.columns:
        if c == key:
            cols.append(F.col(key))
        elif c in update_cols:
            cols.append(F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(F.col("_exists"), F.col(c)).otherwise(F.col(f"_first.{c}")).alias(c))
    action = F.when(F.col("_exists").isNull(), "inserted").when(F.col("_last").isNull(), "unchanged") \
        .otherwise("updated")
    return j.select(*cols, action.alias("_action"), F.coalesce("_batch_rows", F.lit(0)).alias("_batch_rows"))


def upsert_counts(snapshot_with_action: DataFrame) -> DataFrame:
    """A7 return value: rows accepted from the batch, per action."""
    return snapshot_with_action.groupBy("_action").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("_batch_rows").alias("batch_rows_accepted"))


def commit_snapshot(df: DataFrame, base_path: str | None = None) -> str:
    """Write a snapshot to a fresh path (never over the one being read); returns the path."""
    path = base_path or scratch_path(df.sparkSession, "snapshots")
    df.write.mode("errorifexists").parquet(path)
    return path


# -- A8 / A11 / A12 -------------------------------------------------------------

def append_stamped(df: DataFrame, path: str, ts_col: str) -> str:
    """Append rows stamped with the commit time (``NOW()``); returns the path, to be
    read back (the frame itself would run again and stamp another time)."""
    df.withColumn(ts_col, F.current_timestamp()).write.mode("append").parquet(path)
    return path


# -- A9 --------------------------------------------------------------------------

def fk_accepted(child: DataFrame, parent: DataFrame, key: str = cfg.ID_COLUMN) -> DataFrame:
    """Rows whose parent exists (the foreign key would accept them)."""
    return child.join(parent.select(key), key, "left_semi")


def fk_rejected(child: DataFrame, parent: DataFrame, key: str = cfg.ID_COLUMN) -> DataFrame:
    """Rows the foreign key rejects: unknown parent."""
    return child.join(parent.select(key), key, "left_anti")


def cascade_delete(child: DataFrame, parent_after_delete: DataFrame, key: str = cfg.ID_COLUMN) -> DataFrame:
    """ON DELETE CASCADE: children of deleted parents disappear."""
    return fk_accepted(child, parent_after_delete, key)


def cascade_rename(child: DataFrame, key_map: DataFrame, key: str = cfg.ID_COLUMN,
                   old: str = "old_key", new: str = "new_key") -> DataFrame:
    """ON UPDATE CASCADE: re-key children through an (old, new) map; unmapped keys stay."""
    m = key_map.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    j = child.join(m, child[key] == m["_old"], "left")
    return j.select(*[F.coalesce(F.col("_new"), F.col(key)).alias(key) if c == key else F.col(c)
                      for c in child.columns])


# -- A10 -------------------------------------------------------------------------

@dataclass(frozen=True)
class ColumnRule:
    name: str
    kind: str                 # varchar | decimal | tinyint | smallint | enum
    nullable: bool = True
    default: object = None
    length: int | None = None   # varchar
    precision: int | None = None
    scale: int | None = None
    domain: tuple = ()


# fixed values: the reference's ``students`` table contract
STUDENTS_TABLE = [
    ColumnRule("student_id", "varchar", nullable=False, length=20),
    ColumnRule("name", "varchar", nullable=False, length=100),
    ColumnRule("gender", "varchar", nullable=False, length=10),
    ColumnRule("age", "tinyint", nullable=False),
    ColumnRule("department", "varchar", nullable=False, length=100),
    ColumnRule("attendance_percentage", "decimal", nullable=False, default=0.0, precision=5, scale=2),
    ColumnRule("assignment_score", "decimal", nullable=False, default=0.0, precision=5, scale=2),
    ColumnRule("quiz_score", "decimal", nullable=False, default=0.0, precision=5, scale=2),
    ColumnRule("lab_score", "decimal", nullable=False, default=0.0, precision=5, scale=2),
    ColumnRule("midterm_marks", "decimal", nullable=False, default=0.0, precision=5, scale=2),
    ColumnRule("lms_activity", "decimal", nullable=False, default=0.0, precision=5, scale=2),
    ColumnRule("videos_watched", "smallint", nullable=False, default=0),
    ColumnRule("discussion_participation", "smallint", nullable=False, default=0),
    ColumnRule("result", "enum", nullable=True, domain=tuple(cfg.RESULT_DOMAIN)),
]

# fixed values: the reference's contracts of its other tables (their ``id`` and time stamp are given on append)
PREDICTIONS_TABLE = [
    ColumnRule("student_id", "varchar", nullable=False, length=20),
    ColumnRule("predicted_result", "enum", nullable=False, domain=tuple(cfg.RESULT_DOMAIN)),
    ColumnRule("risk_level", "enum", nullable=False,
               domain=(cfg.RISK_LABEL_HIGH, cfg.RISK_LABEL_MEDIUM, cfg.RISK_LABEL_LOW)),
    ColumnRule("risk_score", "decimal", nullable=False, precision=5, scale=2),
    ColumnRule("pass_probability", "decimal", nullable=False, precision=6, scale=4),
    ColumnRule("fail_probability", "decimal", nullable=False, precision=6, scale=4),
    ColumnRule("confidence", "decimal", nullable=False, precision=5, scale=2),
]
METRICS_TABLE = [
    ColumnRule("model_name", "varchar", nullable=False, length=50),
    ColumnRule("accuracy", "decimal", precision=6, scale=4),
    ColumnRule("precision_score", "decimal", precision=6, scale=4),
    ColumnRule("recall", "decimal", precision=6, scale=4),
    ColumnRule("f1_score", "decimal", precision=6, scale=4),
    ColumnRule("auc", "decimal", precision=6, scale=4),
    ColumnRule("is_best", "tinyint", default=0),
]
ALERTS_TABLE = [
    ColumnRule("student_id", "varchar", nullable=False, length=20),
    ColumnRule("alert_type", "varchar", default=cfg.ALERT_TYPE, length=50),
    ColumnRule("sent_to", "varchar", length=200),
    ColumnRule("status", "enum", default="pending", domain=tuple(cfg.ALERT_STATUSES)),
]

_INT_RANGES = {"tinyint": (-128, 127), "smallint": (-32768, 32767)}


def _enum_value(c: F.Column, domain) -> F.Column:
    """ENUM matching: trailing spaces ignored, case-insensitive; canonical member returned."""
    key = F.lower(F.rtrim(c))
    expr = None
    for m in domain:
        expr = F.when(key == m.lower(), F.lit(m)) if expr is None else expr.when(key == m.lower(), F.lit(m))
    return expr


def conform(df: DataFrame, rules=STUDENTS_TABLE, key: str | None = cfg.ID_COLUMN,
            order_col: str = "row_ordinal") -> DataFrame:
    """A10: conformed columns + ``reject_reasons`` ('' when the row is accepted).

    Defaults fill NULLs of NOT NULL columns that have one; decimals round half up
    to their scale; values outside a type's range, over-long strings, values
    outside an ENUM, NULLs without default and repeated keys are reasons. An absent
    column has its default in every row. ``key=None``: the table has no unique key of its own.
    """
    out, reasons = {}, []
    for r in rules:
        c = F.col(r.name) if r.name in df.columns else F.lit(r.default)
        if r.kind == "varchar":
            v = c.cast("string")
            reasons.append(F.when(F.length(v) > r.length, F.lit(f"{r.name} too long")))
        elif r.kind == "decimal":
            src = c.cast("double")
            if r.default is not None and not r.nullable:
                src = F.coalesce(src, F.lit(float(r.default)))
            v = src.try_cast(f"decimal({r.precision},{r.scale})")
            reasons.append(F.when(src.isNotNull() & v.isNull(), F.lit(f"{r.name} out of range")))
        elif r.kind in _INT_RANGES:
            lo, hi = _INT_RANGES[r.kind]
            src = c.cast("double")
            if r.default is not None and not r.nullable:
                src = F.coalesce(src, F.lit(float(r.default)))
            v = F.when((src >= lo) & (src <= hi), F.round(src).cast("int"))
            reasons.append(F.when(src.isNotNull() & v.isNull(), F.lit(f"{r.name} out of range")))
        elif r.kind == "enum":
            v = _enum_value(c.cast("string"), r.domain)
            reasons.append(F.when(c.isNotNull() & v.isNull(), F.lit(f"{r.name} not in domain")))
        else:
            raise ValueError(r.kind)
        if not r.nullable:
            reasons.append(F.when(v.isNull() & c.isNull(), F.lit(f"{r.name} is null")))
        out[r.name] = v
    def checked(rows, *more):
        return rows.select(F.col(order_col), *[out[r.name].alias(r.name) for r in rules],
                           F.concat_ws(";", F.filter(F.array(*reasons, *more), lambda x: x.isNotNull())).alias("reject_reasons"))

    if key is None:
        return checked(df)
    # first occurrence per key: join on (key, ordinal), which spreads a hot key's rows
    firsts = df.groupBy(F.col(key).alias("_fk")).agg(F.min(order_col).alias("_first_ordinal"))
    j = df.join(firsts, F.col(key).eqNullSafe(F.col("_fk")) & (F.col(order_col) == F.col("_first_ordinal")), "left")
    return checked(j, F.when(F.col("_first_ordinal").isNull(), F.lit(f"duplicate {key}")))


def accepted_rows(conformed: DataFrame) -> DataFrame:
    return conformed.filter(F.col("reject_reasons") == "").drop("reject_reasons")


def rejected_rows(conformed: DataFrame) -> DataFrame:
    return conformed.filter(F.col("reject_reasons") != "")
