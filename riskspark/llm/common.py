"""Shared steps of the training-data operators: tables in the shared folder, map jobs over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, kind: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: later jobs neither repeat its
    work nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch of ``df``; it may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that a worker no longer needs goes back to the system; otherwise a reused worker keeps the most that any task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def arrow_fs(path: str):
    """(file system, path on it) of any address that Arrow opens."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def list_array(values, first, kind=None) -> pa.Array:
    """Arrow list array of flat ``values`` cut at ``first``."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def id_text(df: DataFrame) -> DataFrame:
    """The two columns that the document operators read; other columns may clash with none of theirs."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def in_part(total: int, *remainders: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``total``, is one of ``remainders``."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % total).isin(*remainders)
