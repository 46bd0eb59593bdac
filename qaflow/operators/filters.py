"""Payload predicates, per-question metadata filters, search options."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K


class SearchArgumentsError(ValueError):
    """Search options clash with the search call's own arguments, or are unknown."""


def parse_literal(text):
    """Metadata values are stored as JSON literals (``1`` vs ``"1"``); plain text stays text."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return text


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def type_matches(data_type: T.DataType, value) -> bool:
    """Typed match rule: ``1`` never equals ``"1"`` and ``True`` never equals ``1``."""
    if isinstance(value, bool):
        return isinstance(data_type, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(data_type, _NUMERIC)
    if isinstance(value, str):
        return isinstance(data_type, T.StringType)
    return False


def _eq(schema: T.StructType, key: str, value) -> Column:
    # a key the collection does not carry, or a value of another type, never matches
    # (and is never cast: no ANSI cast errors); NULL drops the row in a filter, and the
    # bare equality stays pushable to the scan
    if key not in schema.fieldNames() or not type_matches(schema[key].dataType, value):
        return F.lit(False)
    return F.col(key) == F.lit(value)


def must_should_predicate(df: DataFrame, must=(), should=()) -> Column | None:
    """Every ``must`` equal AND (no ``should`` OR at least one ``should`` equal).

    Plain column equalities, so Catalyst pushes them into the parquet scan. Use it as
    a filter only (NULL comparisons drop the row there, as a missing key does).
    """
    schema = df.schema
    parts = []
    if must:
        parts.append(reduce(lambda a, b: a & b, [_eq(schema, k, v) for k, v in must]))
    if should:
        parts.append(reduce(lambda a, b: a | b, [_eq(schema, k, v) for k, v in should]))
    if not parts:
        return None
    return reduce(lambda a, b: a & b, parts)


def metadata_must(metadata: Column) -> Column:
    """A per-row must-filter spec from request metadata, as canonical sorted JSON.

    ``{"label": "3"}`` becomes ``{"label":"3"}`` with keys sorted, so equal specs group.
    Empty/NULL metadata gives NULL (= no filter).
    """
    entries = F.array_sort(F.map_entries(metadata))
    return F.when(F.size(metadata) > 0, F.to_json(F.map_from_entries(entries)))


def spec_items(spec_json: str | None) -> tuple:
    """Canonical spec text -> ((key, typed value), ...)."""
    if not spec_json:
        return ()
    d = {k: parse_literal(v) for k, v in json.loads(spec_json).items()}
    # only scalars can match a column: a list or an object is treated as null, which matches nothing
    return tuple((k, d[k] if isinstance(d[k], (str, int, float, bool)) else None) for k in sorted(d))


def canonical(value: Column, data_type: T.DataType) -> Column:
    """A column's values as text that is equal for equal values; null for types that no literal matches."""
    if isinstance(data_type, T.StringType):
        return value
    if isinstance(data_type, T.BooleanType):
        return value.cast("string")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), (value + F.lit(0).cast(data_type)).cast("string"))
    if isinstance(data_type, _NUMERIC):
        return value.try_cast("decimal(38,18)").cast("string")
    return F.lit(None).cast("string")


def restored(text: str, data_type: T.DataType) -> Column:
    """A canonical value as a constant of the column's type (a fraction asked of whole numbers is cut, which matches too much, never too little)."""
    value = F.lit(text)
    if isinstance(data_type, _NUMERIC) and not isinstance(data_type, (T.FloatType, T.DoubleType)):
        value = value.cast("decimal(38,18)")
    return value.try_cast(data_type)


def _literal_as(literal: Column, data_type: T.DataType) -> Column:
    """A metadata literal (JSON, or plain text) in the canonical form of a column's type; null if it is of another type."""
    parsed = F.try_parse_json(literal)
    kind = F.schema_of_variant(parsed)
    if isinstance(data_type, T.StringType):
        return F.when(parsed.isNull(), literal).when(kind == "STRING", F.try_variant_get(parsed, "$", "string"))
    if isinstance(data_type, T.BooleanType):
        return F.when(kind == "BOOLEAN", F.trim(literal))
    if isinstance(data_type, _NUMERIC):
        number = F.trim(literal).try_cast(data_type if isinstance(data_type, (T.FloatType, T.DoubleType)) else "decimal(38,18)")
        return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), canonical(number, number_type(data_type)))
    return F.lit(None).cast("string")


def number_type(data_type: T.DataType) -> T.DataType:
    return data_type if isinstance(data_type, (T.FloatType, T.DoubleType)) else T.DecimalType(38, 18)


def no_group() -> Column:
    """The group of a question without a filter: all points."""
    return F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("vals"))


def spec_group(spec: str, schema: T.StructType, filter_keys: list[str]) -> Column:
    """A must-spec as ``struct<keys, vals>``, the keys sorted and the values in the canonical form of the collection's columns.

    Null if it can match no point: a key that the collection lacks, or a value of another type than its column."""
    entries = F.map_entries(F.from_json(F.col(spec), "map<string,string>"))
    entries = F.array_sort(entries)
    keys = F.transform(entries, lambda e: e["key"])

    def value(e: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in filter_keys:
            out = F.when(e["key"] == name, _literal_as(e["value"], schema[name].dataType)).otherwise(out)
        return out

    group = F.struct(keys.alias("keys"), F.transform(entries, value).alias("vals"))
    sound = F.forall(group["vals"], lambda v: v.isNotNull())
    return F.when(F.col(spec).isNull(), no_group()).when(sound, group)


def search_options(options: dict | None) -> tuple[int, float | None]:
    """Understood extra options are ``offset`` and ``score_threshold``; ``with_vectors`` is taken and
    changes nothing, as hits carry no vectors here."""
    options = dict(options or {})
    clash = set(options) & set(K.RESERVED_SEARCH_KEYS)
    if clash:
        raise SearchArgumentsError(f"reserved search options: {', '.join(sorted(clash))}")
    unknown = set(options) - {"offset", "score_threshold", "with_vectors"}
    if unknown:
        raise SearchArgumentsError(f"Unsupported search options: {', '.join(sorted(unknown))}")
    offset = int(options.get("offset", 0) or 0)
    threshold = options.get("score_threshold")
    return offset, (None if threshold is None else float(threshold))


def hit_metadata(payload: Column) -> Column:
    """Payload map minus the reserved keys."""
    reserved = F.array(*[F.lit(k) for k in K.RESERVED_PAYLOAD_KEYS])
    return F.map_filter(payload, lambda k, _v: ~F.array_contains(reserved, k))
