"""Requests, eval records and article patches as streams.

Each micro-batch runs the batch operators inside ``foreachBatch`` (windows such as
the top-k ``row_number`` are not allowed directly on a stream). Every write is keyed
by ``batch_id``: answers overwrite the batch's own folder, eval records, patches and cache entries
are committed once, so a batch that is replayed after a failure does not double its output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.pipeline import Pipeline, answers, metric_rows
from ..session import materialised
from ..sources import articles as A
from ..sources import evallog as EL
from ..sources import requests as RQ

REQUEST_STREAM_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_query", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("qvec", T.ArrayType(T.FloatType())),
])

PATCH_STREAM_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("created_date", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])


def answer_stream(spark: SparkSession, source_dir: str, pipeline: Pipeline, out_path: str, checkpoint: str,
                  eval_path: str | None = None, available_now: bool = True, timed: bool = False):
    """J1 (+J2): JSON request files -> answers (and eval records) per micro-batch."""
    stream = spark.readStream.schema(REQUEST_STREAM_SCHEMA).json(source_dir)

    def run_batch(df: DataFrame, batch_id: int) -> None:
        state, secs = pipeline.run(df, timed=timed, batch=f"answers-{batch_id}")
        state = materialised(state, "answered")  # one evaluation feeds both sinks
        answers(state).withColumn("batch_id", F.lit(batch_id)) \
            .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
        if eval_path is not None:
            EL.write(EL.records(metric_rows(state, secs)), eval_path, batch_id=batch_id)

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def intake_stream(spark: SparkSession, source_dir: str, pipeline: Pipeline, out_path: str, quarantine_path: str, checkpoint: str,
                  eval_path: str | None = None, within: str = "1 day", available_now: bool = True):
    """A13 + H11 + J1: files of request lines -> each request gets its event id and is answered once, however often it is
    sent; lines that are no request go to the quarantine with the reason."""
    lines = spark.readStream.text(source_dir)

    def run_batch(df: DataFrame, batch_id: int) -> None:
        df = materialised(df, "intake")  # the state of the stream is read once, for both sinks
        RQ.quarantine(df).select("event_id", "value", "reason").write.mode("overwrite").parquet(f"{quarantine_path.rstrip('/')}/batch_id={batch_id}")
        state, secs = pipeline.run(RQ.valid_requests(df).select("event_id", "user_query", "metadata"), batch=f"requests-{batch_id}")
        state = materialised(state, "answered")
        answers(state).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
        if eval_path is not None:
            EL.write(EL.records(metric_rows(state, secs)), eval_path, batch_id=batch_id)

    writer = RQ.intake(lines, within).writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def patch_stream(spark: SparkSession, source_dir: str, store: A.ArticleStore, checkpoint: str, available_now: bool = True,
                 compact_every: int = 16):
    """Article patches per micro-batch -> changes in the store, once for each batch id; the buckets that were
    touched are compacted every ``compact_every`` batches."""
    stream = spark.readStream.schema(PATCH_STREAM_SCHEMA).json(source_dir)

    def run_batch(df: DataFrame, batch_id: int) -> None:
        store.apply(df, batch=f"patches-{batch_id}")
        if batch_id % compact_every == compact_every - 1:
            store.compact()

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
