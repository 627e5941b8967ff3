"""File sources and sinks (survey A1, A2): CSV with a declared schema and pandas' NA tokens.

A CSV record may hold line breaks inside quotes, so a reader that starts in the middle of a file does not know
whether a line break ends a record. Files are read as lines, split as Spark splits them. A first pass says
of each split how it would leave the quoting for either way it could begin; put together along each file, that tells every
split how it does begin. The second pass then cuts records at their true ends. A record that crosses splits is put
together from its pieces; no file is one task.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import standard_name

# fixed values: the strings pandas' CSV reader treats as missing by default
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

STUDENT_SCHEMA = T.StructType([
    T.StructField("row_ordinal", T.LongType()),
    T.StructField("student_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("department", T.StringType()),
    T.StructField("attendance_percentage", T.DoubleType()),
    T.StructField("assignment_score", T.DoubleType()),
    T.StructField("quiz_score", T.DoubleType()),
    T.StructField("lab_score", T.DoubleType()),
    T.StructField("midterm_marks", T.DoubleType()),
    T.StructField("lms_activity", T.DoubleType()),
    T.StructField("videos_watched", T.IntegerType()),
    T.StructField("discussion_participation", T.IntegerType()),
    T.StructField("result", T.StringType()),
])

_CSV_OPTS = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
             "escape": '"'}


def _typed(c: F.Column, kind: T.DataType) -> F.Column:
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.IntegerType):  # "21.0", as writers with gaps in the column put it, is 21
        d = c.try_cast("double")
        return F.coalesce(c.try_cast("int"), F.when(d == F.floor(d), d.try_cast("int")))
    return c.try_cast(kind)


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, which begins inside one or at a record's start. A quote opens a
    field only as its first character; elsewhere in an unquoted field it is a character."""
    if '"' not in line:
        return inside
    at, size = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            at, inside = at + 1, False
        elif at < size and line[at] == '"' and (at == 0 or line[at - 1] == ","):
            at, inside = at + 1, True
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((path, start), lines) of each split that a task reads; lines of a split come one after the other."""
    rows = ((key, line) for b in batches for *key, line in zip(*[c.to_pylist() for c in b.columns]))
    ahead = next(rows, None)

    def lines(key):
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            line = ahead[1]
            ahead = next(rows, None)
            yield line

    while ahead is not None:
        key = ahead[0]
        inner = lines(key)
        yield tuple(key), inner
        for _ in inner:  # what the caller has left
            pass


def _quoting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, plain, quoted, closes): whether a field is open after a split that begins at a record's start, or
    inside a quoted field, and whether in the latter case some line ends outside."""
    for (path, start), lines in _splits(batches):
        plain, quoted, closes = False, True, False
        for line in lines:
            if plain == quoted and '"' not in line:
                continue
            plain, quoted = open_after(line, plain), open_after(line, quoted)
            closes |= not quoted
        yield pa.record_batch({"path": [path], "start": [start], "plain": [plain], "quoted": [quoted], "closes": [closes]})


def _records(starts: dict):
    """(path, start, line, part, text) of a task's splits: whole records (part -1), and pieces of records that cross
    splits, under the split and line where the record begins, numbered by the split that has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows():
            table = pa.record_batch([pa.array(x) for x in zip(*out)], names=["path", "start", "line", "part", "text"])
            out.clear()
            return table.cast(pa.schema([("path", pa.string()), ("start", pa.int64()), ("line", pa.int64()), ("part", pa.int64()), ("text", pa.string())]))

        for (path, start), lines in _splits(batches):
            owner = starts.get((path, start))  # the split where the record that is open at this split's start begins
            inside, held, first = owner is not None, [], 0
            for number, line in enumerate(lines):
                if not held:
                    first = number
                held.append(line)
                inside = open_after(line, inside)
                if not inside:
                    text = "\n".join(held)
                    out.append((path, start, first, -1, text) if owner is None else (path, owner, 1 << 62, start, text))
                    held, owner = [], None
                    if len(out) >= 5000:
                        yield rows()
            if held:  # the record goes on in the next split
                out.append((path, start if owner is None else owner, 1 << 62, start, "\n".join(held)))
        if out:
            yield rows()
    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, line, record): the records of CSV files with their place (file, split, line in the split; a record that
    crosses splits comes after all others of the one where it begins). Blank lines outside quotes are no records.

    The driver holds one row per split; tasks get those of the splits that begin inside a quoted field."""
    lines = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    found = lines.mapInArrow(_quoting, "path string, start long, plain boolean, quoted boolean, closes boolean").collect()
    starts, open_now, unclosed, at, owner = {}, False, False, None, 0
    for r in sorted(found, key=lambda r: (r.path, r.start)):
        if r.path != at:
            unclosed |= open_now
            at, open_now = r.path, False
        if open_now:
            starts[r.path, r.start] = owner
        if not open_now or r.closes:
            owner = r.start
        open_now = r.quoted if open_now else r.plain
    rows = lines.mapInArrow(_records(starts), "path string, start long, line long, part long, text string")
    whole = rows.filter("part < 0").select("path", "start", "line", F.col("text").alias("record"))
    if starts or open_now or unclosed:
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x.text)
        crossing = rows.filter("part >= 0").groupBy("path", "start", "line").agg(F.array_join(pieces, "\n").alias("record"))
        whole = whole.unionByName(crossing)
    return whole.withColumn("record", F.regexp_replace("record", "\r$", "")).filter(F.trim("record") != "")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = STUDENT_SCHEMA,
             na_tokens=PANDAS_NA_TOKENS, position: str | None = None) -> DataFrame:
    """A1: header CSV -> declared types. Every field is read as text, NA tokens become NULL,
    then each column is ``try_cast`` to its declared type (bad values -> NULL, not an error).

    Headers are matched after B1's name rule ("Student ID" is ``student_id``); columns that the
    schema does not declare follow as text under their standard names. All files of a folder must
    have the same header, and two headers must not share a standard name: both raise, as does a
    missing path. Quoted fields may hold line breaks; large files are split all the same.
    ``position`` names a column for each record's place (file, split, line), which is file order."""
    records = csv_records(spark, path)
    place = F.struct("path", "start", "line")
    tops = records.filter("start = 0").groupBy("path").agg(F.min_by("record", place).alias("header"), F.min(place).alias("top"))
    heads = [r.header for r in tops.select("header").distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError(f"files of {path} differ in their header: {heads}")
    columns = next(csv.reader([heads[0].removeprefix("\ufeff")])) if heads else []
    names = [standard_name(c) for c in columns]
    if len(set(names)) < len(names):
        raise ValueError(f"header names clash: {sorted(n for n in set(names) if names.count(n) > 1)}")
    # a file's first record is its header; in every other split all records are rows
    body = records.join(tops.select(F.col("path").alias("_path"), F.col("top.line").alias("_line")), F.col("path") == F.col("_path"))
    body = body.filter((F.col("start") > 0) | (F.col("line") > F.col("_line")))
    raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {k: v for k, v in _CSV_OPTS.items() if k != "header"} | {"multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = body.select(place.alias("_place"), F.from_csv("record", raw.simpleString()[len("struct<"):-1].replace(":", " ") or "c0 string", options).alias("r"))
    na = F.array(*[F.lit(t) for t in na_tokens])
    fields = {}
    for i, name in enumerate(names):
        c = F.col(f"r.c{i}")
        fields[name] = F.when(c.isNull() | F.array_contains(na, c), F.lit(None)).otherwise(c)
    declared = [_typed(fields[f.name], f.dataType).alias(f.name) for f in schema.fields if f.name in fields]
    extra = [fields[n].alias(n) for n in names if n not in schema.fieldNames()]
    return parsed.select(*declared, *extra, *([F.col("_place").alias(position)] if position else []))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A2: header CSV, values written as-is (no whitespace trimming), NULL as empty."""
    df.write.mode(mode).options(**_CSV_OPTS).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=()) -> None:
    """A2 (table form)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
