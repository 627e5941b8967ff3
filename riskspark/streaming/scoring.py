"""Continuous scoring of arriving student records (survey K1) with Structured Streaming.

Arriving records take the record-mode path (constants instead of medians, clip,
no encoder), then features, then -- when a fitted pipeline is given -- the
model, the risk columns and the ordered recommendations. Everything is a
stateless per-row transform, so the query runs in append mode with any file or
message source; ``trigger(availableNow=True)`` drains what has arrived and stops
(the same plan runs continuously with a processing-time trigger). Progress and
sink metadata live in the shared folder, so a restarted query resumes exactly
where it stopped.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import config as cfg
from ..operators import store, tables
from ..operators.clean import clean_single
from ..operators.features import add_features
from ..operators.recommend import recommendation_array
from ..operators.score import attach_risk, with_record_identity
from ..session import scratch_path


class Running(NamedTuple):
    """A started stream: the query, which the caller may stop, and where its rows go."""

    query: StreamingQuery
    sink: str


def scoring_transform(records: DataFrame, model=None, features=cfg.MODEL_FEATURES) -> DataFrame:
    """The per-record plan (works on batch and streaming frames alike)."""
    df = add_features(with_record_identity(clean_single(records)))
    if model is None:
        return df.withColumn("recommendations", recommendation_array(df, "risk_level"))
    df = df.withColumns({c: (F.col(c).cast("double") if c in df.columns else F.lit(0.0)) for c in features})
    p = vector_to_array(F.col("probability"))
    scored = model.transform(df).withColumn("_fail", p[0]).withColumn("_pass", p[1]) \
        .drop("features_raw", "features", "rawPrediction", "probability", "prediction")
    scored = attach_risk(scored, "_fail", "_pass")
    return scored.withColumn("recommendations", recommendation_array(scored, "risk_level"))


def run_stream(spark: SparkSession, source_dir: str, schema: T.StructType, model=None,
               sink_dir: str | None = None, checkpoint_dir: str | None = None,
               available_now: bool = True, processing_time: str | None = None) -> Running:
    """Start the streaming query over a parquet file source into Parquet files.

    With ``available_now`` the call blocks until every file present at start is
    processed; otherwise the query runs on until the caller stops it.
    """
    sink_dir = sink_dir or scratch_path(spark, "stream_sink")
    out = scoring_transform(spark.readStream.schema(schema).parquet(source_dir), model)
    writer = out.writeStream.format("parquet").outputMode("append").option("path", sink_dir)
    return _started(spark, writer, sink_dir, checkpoint_dir, available_now, processing_time)


def run_stream_to_tables(spark: SparkSession, source_dir: str, schema: T.StructType, table_path: str, model,
                         parent: DataFrame | None = None, checkpoint_dir: str | None = None,
                         available_now: bool = True, processing_time: str | None = None) -> Running:
    """Score arriving records into a kept log of predictions (``operators.tables``), each batch exactly once.

    Every micro-batch goes through the predictions' contract and, with ``parent``, their foreign key; refused rows are
    kept aside with their reasons. The batch's number is its commit key: a batch that is run again after
    a failure, whether before or after its commit, adds its rows once. The log is created where there is none."""
    try:
        tables.latest(spark, table_path)
    except ValueError:
        tables.create(spark, table_path, tables.log_schema(store.PREDICTIONS_TABLE, "predicted_at"), buckets=0)
    write = batch_writer(table_path, model, parent)
    writer = spark.readStream.schema(schema).parquet(source_dir).writeStream.foreachBatch(write)
    return _started(spark, writer, table_path, checkpoint_dir, available_now, processing_time)


def batch_writer(table_path: str, model, parent: DataFrame | None = None, order_col: str = "row_ordinal"):
    """The ``foreachBatch`` function: scores one batch and appends it under its number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = scoring_transform(batch, model)
        tables.append(batch.sparkSession, table_path, rows.select(order_col, *[r.name for r in store.PREDICTIONS_TABLE]),
                      store.PREDICTIONS_TABLE, [order_col], parent, batch=str(batch_id), ts_col="predicted_at", order_col=order_col)
    return write


def _started(spark, writer, sink: str, checkpoint_dir, available_now: bool, processing_time) -> Running:
    writer = writer.option("checkpointLocation", checkpoint_dir or scratch_path(spark, "stream_checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return Running(q, sink)
