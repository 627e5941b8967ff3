"""Kept tables with a manifest (survey 2.A: A5-A9, K1): bucketed upserts, checked appends, single-key reads.

A table is a folder of Parquet directories and of numbered manifests. A manifest names the directories that
are the table, one per key bucket (``buckets`` > 0) or one per append. A change writes new directories, then
puts the next manifest in place by a rename that fails if it is there already: of two writers that began at one
version the second gets ``StaleBase`` and nothing of it shows. Readers see whole versions; what a failed
change left behind is named by no manifest. The rename is atomic on HDFS and the like; an object store
needs a committer that gives the same.

Rows meet the table's column contract (``store.conform``) and its foreign key before anything else; those that
fail are written, with their reasons, to the table's ``rejects`` and counted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as cfg
from ..session import scratch_path
from . import store


class StaleBase(RuntimeError):
    """Another writer has put the next version in place."""


class Files:
    """The few file operations of a manifest, on the file system of the path (Hadoop's, as Spark's own)."""

    def __init__(self, spark: SparkSession, path: str):
        self.gateway, self.jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, p: str, text: str) -> bool:
        """Puts a whole file in place; False if there is one already."""
        folder, _, name = p.rpartition("/")
        held = f"{folder}/.{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(held))
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.context.rename(self.path(held), self.path(p), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self.fs.delete(self.path(held), False)
            return False


@dataclass
class Manifest:
    """One version: ``parts`` are {"dir", "bucket" or "batch", "rows"}; ``high_water`` is the largest id given so far."""

    version: int
    key: str
    buckets: int
    schema: str
    parts: list[dict] = field(default_factory=list)
    high_water: int = 0
    batches: list[str] = field(default_factory=list)


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/_manifest/{version:020d}.json"


def latest(spark: SparkSession, path: str) -> Manifest:
    """The newest version of a table."""
    files = Files(spark, path)
    names = [n for n in files.names(f"{path}/_manifest") if n.endswith(".json") and not n.startswith(".")]
    if not names:
        raise ValueError(f"no table at {path}")
    return Manifest(**json.loads(files.read(f"{path}/_manifest/{names[-1]}")))


def commit(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    """Puts a manifest in place as the version that follows the one it was made from."""
    if not Files(spark, path).write_once(_manifest_path(path, m.version), json.dumps(m.__dict__)):
        raise StaleBase(f"{path} has a version {m.version} already")
    return m


def create(spark: SparkSession, path: str, schema: T.StructType, key: str = cfg.ID_COLUMN, buckets: int = 64) -> Manifest:
    """An empty table; ``buckets`` 0: a log that is appended to."""
    return commit(spark, path, Manifest(0, key, buckets, schema.json()))


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, keys: list | None = None, m: Manifest | None = None) -> DataFrame:
    """The table, or the rows of some keys: only the keys' buckets are read, and in them, as files are sorted by key and
    carry a Bloom filter of it, only row groups that can hold one."""
    m = m or latest(spark, path)
    schema = T.StructType.fromJson(json.loads(m.schema))
    parts = m.parts
    if keys is not None and m.buckets:
        asked = spark.createDataFrame([(k,) for k in keys], T.StructType([schema[m.key]]))
        mine = {r[0] for r in asked.select(bucket_of(m.key, m.buckets)).collect()}
        parts = [p for p in parts if p["bucket"] in mine]
    if not parts:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(*[f"{path}/{p['dir']}" for p in parts])
    return df if keys is None else df.filter(F.col(m.key).isin(list(keys)))


def _write(df: DataFrame, path: str, m: Manifest) -> str:
    """Writes rows to a new directory (by bucket, sorted by key, with a Bloom filter); returns its place in the table."""
    place = f"data/{uuid.uuid4().hex}"
    bloom = {f"parquet.bloom.filter.enabled#{m.key}": "true"}
    if m.buckets:
        df = df.withColumn("bucket", bucket_of(m.key, m.buckets)).repartition(m.buckets, "bucket").sortWithinPartitions("bucket", m.key)
        df.write.options(**bloom).partitionBy("bucket").parquet(f"{path}/{place}")
    else:
        df.write.options(**bloom).parquet(f"{path}/{place}")
    return place


def load(df: DataFrame, path: str, key: str = cfg.ID_COLUMN, buckets: int = 64) -> Manifest:
    """A new bucketed table that holds ``df`` (any schema, any number of rows per key)."""
    spark = df.sparkSession
    m = create(spark, path, df.schema, key, buckets)
    place = _write(df, path, m)
    there = [n for n in Files(spark, path).names(f"{path}/{place}") if n.startswith("bucket=")]
    parts = [{"dir": f"{place}/{n}", "bucket": int(n[len("bucket="):])} for n in there]
    return commit(spark, path, Manifest(1, key, buckets, m.schema, sorted(parts, key=lambda p: p["bucket"])))


def _checked(rows: DataFrame, rules, parent: DataFrame | None, key: str, order_col: str) -> DataFrame:
    """Conformed rows with ``reject_reasons``, written once; an unknown parent is a reason like the others."""
    out = store.conform(rows, rules, None, order_col)
    if parent is not None:
        known = parent.select(F.col(key).alias("_parent")).distinct()
        out = out.join(known, F.col(key) == F.col("_parent"), "left")
        unknown = F.when(F.col(key).isNotNull() & F.col("_parent").isNull(), F.lit(f"unknown {key}"))
        out = out.withColumn("reject_reasons", F.concat_ws(";", F.when(F.col("reject_reasons") != "", F.col("reject_reasons")), unknown)).drop("_parent")
    path = scratch_path(rows.sparkSession, "checked")
    out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def _reject(checked: DataFrame, path: str) -> int:
    rejected = store.rejected_rows(checked)
    n = rejected.count()
    if n:
        rejected.write.parquet(f"{path}/rejects/{uuid.uuid4().hex}")
    return n


def rejects(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows that the table has refused, with their reasons (None: there are none)."""
    folders = Files(spark, path).names(f"{path}/rejects")
    return spark.read.parquet(*[f"{path}/rejects/{n}" for n in folders]) if folders else None


def table_schema(rules, order_col: str = "row_ordinal", order_type: T.DataType = T.LongType()) -> T.StructType:
    """Types of conformed rows."""
    kinds = {"tinyint": T.IntegerType(), "smallint": T.IntegerType()}
    return T.StructType([T.StructField(order_col, order_type)] + [
        T.StructField(r.name, T.DecimalType(r.precision, r.scale) if r.kind == "decimal" else kinds.get(r.kind, T.StringType())) for r in rules])


def upsert(spark: SparkSession, path: str, batch: DataFrame, rules=None, base: Manifest | None = None,
           update_cols=store.UPDATE_ON_DUPLICATE, order_col: str = "row_ordinal") -> dict:
    """A6/A7 on a bucketed table: rows that the contract refuses are counted and kept aside, the others are folded
    per key; only buckets that hold one of their keys are read and written anew.

    Returns {"version", "inserted", "updated" (keys), "accepted", "rejected" (batch rows), "buckets"}."""
    m = base or latest(spark, path)
    rules = store.STUDENTS_TABLE if rules is None else rules
    checked = _checked(batch, rules, None, m.key, order_col)
    rejected = _reject(checked, path)
    accepted = store.accepted_rows(checked)
    touched = sorted(r[0] for r in accepted.select(bucket_of(m.key, m.buckets)).distinct().collect())  # at most ``buckets`` numbers
    result = {"version": m.version, "inserted": 0, "updated": 0, "accepted": 0, "rejected": rejected, "buckets": len(touched)}
    if not touched:
        return result
    old = [p for p in m.parts if p["bucket"] in touched]
    schema = T.StructType.fromJson(json.loads(m.schema))
    existing = spark.read.schema(schema).parquet(*[f"{path}/{p['dir']}" for p in old]) if old else spark.createDataFrame([], schema)
    keys = accepted.groupBy(m.key).agg(F.count(F.lit(1)).alias("n"))
    known = existing.select(F.col(m.key).alias("_known"))  # one row per key
    c = keys.join(known, F.col(m.key) == F.col("_known"), "left").agg(F.count("_known"), F.count_if(F.col("_known").isNull()), F.sum("n")).first()
    new = store.upsert(existing, accepted, m.key, update_cols, order_col).drop("_action", "_batch_rows").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    place = _write(new, path, m)
    parts = [p for p in m.parts if p["bucket"] not in touched] + [{"dir": f"{place}/bucket={b}", "bucket": b} for b in touched]
    commit(spark, path, Manifest(m.version + 1, m.key, m.buckets, m.schema, sorted(parts, key=lambda p: p["bucket"]), m.high_water, m.batches))
    return result | {"version": m.version + 1, "updated": c[0], "inserted": c[1], "accepted": c[2]}


def _numbered(rows: DataFrame, order_cols: list[str], first: int) -> DataFrame:
    """``rows`` with ids from ``first`` on, in the order of ``order_cols``: rows are written by ranges of the order, and a
    row's id is its file's offset (a sum over the files before) and its place in the file."""
    spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "numbered")
    rows.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).write.parquet(path)
    name, place = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    held = spark.read.schema(rows.schema).parquet(path).withColumns({"_file": name, "_place": place})
    number = F.regexp_extract(F.col("_file"), r"part-(\d+)", 1).cast("long")
    sizes = held.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))  # one row per file
    before = F.coalesce(F.sum("_n").over(Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_file", before.alias("_before"))
    return held.join(offsets, "_file").select((F.lit(first) + F.col("_before") + F.col("_place")).alias("id"), *rows.columns)


def append(spark: SparkSession, path: str, rows: DataFrame, rules, order_cols: list[str], parent: DataFrame | None = None,
           batch: str | None = None, ts_col: str | None = None, order_col: str = "row_ordinal", base: Manifest | None = None) -> dict:
    """A8/A9 on a log: contract and foreign key are checked, accepted rows get ids after the table's high-water mark in
    the order of ``order_cols`` and the commit time. A ``batch`` that is in the table already adds nothing.

    Returns {"version", "accepted", "rejected", "first_id"}."""
    m = base or latest(spark, path)
    if batch is not None and batch in m.batches:
        return {"version": m.version, "accepted": 0, "rejected": 0, "first_id": None}
    checked = _checked(rows, rules, parent, m.key, order_col)
    n = checked.agg(F.count_if(F.col("reject_reasons") == ""), F.count_if(F.col("reject_reasons") != "")).first()
    done = [*m.batches, batch] if batch is not None else m.batches
    parts = m.parts
    if n[0]:
        out = _numbered(store.accepted_rows(checked), order_cols, m.high_water + 1)
        if ts_col:
            out = out.withColumn(ts_col, F.current_timestamp())
        schema = T.StructType.fromJson(json.loads(m.schema))
        place = _write(out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), path, m)
        parts = [*parts, {"dir": place, "batch": batch, "rows": n[0]}]
    out = commit(spark, path, Manifest(m.version + 1, m.key, m.buckets, m.schema, parts, m.high_water + n[0], done))
    if n[1]:  # after the commit: a batch that is run again is not refused twice
        _reject(checked, path)
    return {"version": out.version, "accepted": n[0], "rejected": n[1], "first_id": m.high_water + 1 if n[0] else None}


def log_schema(rules, ts_col: str | None = None) -> T.StructType:
    """Types of a log's rows: id, the contract's columns and the time stamp."""
    fields = [T.StructField("id", T.LongType()), *table_schema(rules).fields[1:]]
    return T.StructType(fields + ([T.StructField(ts_col, T.TimestampType())] if ts_col else []))
