"""Eval log sink and its reads.

Records: ``event_id string, log string`` (JSON ``{"metric", "value"}``) plus ``ts``
parsed from the event id. :class:`EvalLog` keeps them by the day in the event id and by
buckets of event ids, with versions: a batch is appended once, a delete writes tombstones,
and reads of an event or of a day read their partitions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import event_id as make_event_id
from ..functions.text import event_time, json_field
from .versioned import Part, VersionedTable, bucket


def records(metrics: DataFrame) -> DataFrame:
    """Long metrics ``(event_id, metric, value)`` -> eval records with a JSON log."""
    log = F.to_json(F.struct(F.col("metric").alias("metric"), F.col("value").alias("value")))
    return metrics.select("event_id", log.alias("log"), event_time(F.col("event_id")).alias("ts"))


RECORD_TYPE = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("log", T.StringType()), T.StructField("ts", T.TimestampType())])
NO_DAY = "none"


def day_of(event_id: Column) -> Column:
    """The day inside an event id, as text; ``none`` for ids without one."""
    day = F.substring(event_id, 37, 10)
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day).otherwise(F.lit(NO_DAY))


class EvalLog(VersionedTable):
    """Eval records in partitions of day and event bucket."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8) -> None:
        super().__init__(spark, root, RECORD_TYPE, "event_id", [Part("day", T.StringType(), day_of), bucket(buckets)])

    def of_event(self, event_id: str) -> DataFrame:
        return self.read(where=self.of_keys([event_id])).where(F.col("event_id") == F.lit(event_id))

    def of_day(self, day: str) -> DataFrame:
        """The records of a day, with those whose ids have no day: the partitions in which an id may name the day."""
        return self.read(where=F.col("day").isin(day, NO_DAY))


def write(records_df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append; with ``batch_id`` a batch that is replayed is written once."""
    EvalLog(records_df.sparkSession, path).append(records_df, None if batch_id is None else str(batch_id))


def read(spark: SparkSession, path: str, event_id: str | None = None) -> DataFrame:
    """All records, or those of one event (its partition only)."""
    log = EvalLog(spark, path)
    return log.read() if event_id is None else log.of_event(event_id)


def delete(records_df: DataFrame, event_ids: DataFrame | str | None = None) -> DataFrame:
    """A10: the table without one event, without a set of events (anti join), or empty."""
    if event_ids is None:
        return records_df.limit(0)
    if isinstance(event_ids, str):
        return records_df.where(~F.col("event_id").eqNullSafe(F.lit(event_ids)))
    return records_df.join(event_ids.select("event_id").distinct(), "event_id", "left_anti")


def from_events(events: DataFrame) -> DataFrame:
    """Eval records derived from ``events``: metric = event_type, value = value."""
    eid = make_event_id(F.col("event_id"), F.col("ts"))
    log = F.to_json(F.struct(F.col("event_type").alias("metric"), F.col("value").alias("value")))
    return events.select(eid.alias("event_id"), log.alias("log"), F.col("ts").cast("timestamp").alias("ts"))


def metrics_wide(records_df: DataFrame, names=None) -> DataFrame:
    """One row per event, one column per metric: the value of the earliest record, the
    smallest among records of one time, so that repeats give the same row in any layout."""
    names = list(names or K.METRIC_NAMES)
    long = records_df.select("event_id", json_field(F.col("log"), "metric").alias("metric"),
                             json_field(F.col("log"), "value").alias("value"), "ts")
    return long.groupBy("event_id").pivot("metric", names).agg(F.min_by("value", F.struct("ts", "value")))


def latest_of_day(spark: SparkSession, view: str, day: str) -> DataFrame:
    """the monitoring query as written (orders by the id text, so by its uuid part)."""
    return spark.sql("SELECT event_id, log FROM IDENTIFIER(:view) WHERE event_id LIKE :pattern "
                     "ORDER BY event_id DESC LIMIT 1", args={"view": view, "pattern": f"%{day}%"})


def latest_by_ts(records_df: DataFrame, day: str) -> DataFrame:
    """F5 variant: latest record of the day by the timestamp inside the id."""
    t = event_time(F.col("event_id"))
    return records_df.where(F.to_date(t) == F.lit(day).cast("date")) \
        .orderBy(t.desc(), F.col("event_id").desc()).limit(1).select("event_id", "log")
