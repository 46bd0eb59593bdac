"""Request intake -- JSON requests validated against the request schema.

``user_query`` must be a JSON string (a number or a missing field is rejected, as
the request model does); ``metadata`` defaults to an empty map and must be an
object of scalars, whose JSON types are kept (``"1"`` and ``1`` stay apart). Valid rows go on, the
others are kept apart with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import event_id

REQUEST_SCHEMA = "user_query string, metadata map<string,string>"


def validate_json_requests(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Adds ``valid``, ``reason``, ``user_query`` and ``metadata`` (JSON-literal values)."""
    v = F.try_parse_json(F.col(value_col))
    uq = F.try_variant_get(v, "$.user_query", "string")
    uq_type = F.schema_of_variant(F.try_variant_get(v, "$.user_query", "variant"))
    meta_v = F.try_variant_get(v, "$.metadata", "variant")
    meta_type = F.schema_of_variant(meta_v)
    meta_ok = meta_v.isNull() | meta_type.startswith("OBJECT")
    values = F.try_variant_get(v, "$.metadata", "map<string,variant>")
    nested = F.exists(F.map_values(values), lambda x: F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"))
    meta = F.when(meta_v.isNotNull() & meta_ok, F.transform_values(values, lambda _k, x: F.to_json(x)))
    reason = (F.when(v.isNull(), F.lit("malformed JSON"))
              .when(uq_type.isNull() | (uq_type == "NULL"), F.lit("user_query is required"))
              .when(uq_type != "STRING", F.lit("user_query must be a string"))
              .when(~meta_ok, F.lit("metadata must be an object"))
              .when(F.coalesce(nested, F.lit(False)), F.lit("metadata values must be scalars")))
    return lines.withColumn("reason", reason) \
        .withColumn("valid", F.col("reason").isNull()) \
        .withColumn("user_query", F.when(F.col("valid"), uq)) \
        .withColumn("metadata", F.when(F.col("valid"), F.coalesce(meta, F.create_map().cast("map<string,string>"))))


def valid_requests(validated: DataFrame) -> DataFrame:
    return validated.where("valid")


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.where("NOT valid")


def intake(lines: DataFrame, within: str = "1 day") -> DataFrame:
    """A13 + H11 on a stream (or table) of request lines: ``event_id, sent_at`` and the columns of the validation, each request once.

    The event id is made of what the sender says: ``request_id`` and ``sent_at``; without them, of the file and the line,
    and of the file's time. A request that is sent again, in any file and batch, thus has the same id and is dropped while its
    id is kept as state: ``within`` of its arrival. The watermark is on the arrival, so no request is ever too late."""
    parsed = F.try_parse_json(F.col("value"))
    sent = F.coalesce(F.try_variant_get(parsed, "$.sent_at", "timestamp"), F.col("_metadata.file_modification_time"))
    name = F.coalesce(F.try_variant_get(parsed, "$.request_id", "string"), F.sha2(F.concat_ws("|", F.col("_metadata.file_path"), F.col("value")), 256))
    rows = lines.select("value", sent.alias("sent_at"), name.alias("request_id"), F.current_timestamp().alias("arrived"))
    rows = rows.withColumn("event_id", event_id(F.col("request_id"), F.col("sent_at")))
    if rows.isStreaming:
        rows = rows.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["event_id"])
    else:
        rows = rows.dropDuplicates(["event_id"])
    return validate_json_requests(rows).drop("arrived")
