"""RETRIEVE: hits -> typed contexts (B7, B8), fallbacks (G1, G2), hit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from . import filters as FL
from .topk import BLOCK_BYTES, similarity_topk

CONTEXT_TYPE = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("has_meta", T.BooleanType()),
])
CONTEXTS_TYPE = T.ArrayType(CONTEXT_TYPE)


def score_text(score: Column) -> Column:
    """Scores as fixed 6-decimal text, identical across engines."""
    return score.cast("decimal(18,6)").cast("string")


def embedding_log(vec: Column) -> Column:
    """D3: comma-joined vector values."""
    return F.array_join(F.transform(vec, lambda x: x.cast("double").cast("decimal(18,6)").cast("string")), ",")


def hits_with_payload(hits: DataFrame, points: DataFrame, key: str = "event_id",
                      point_id: str = "id", broadcast_hits: bool = False, vector: str | None = None) -> DataFrame:
    """Join the payload back to the top-k hits (only k rows per question travel).

    Hits are a small, bounded side (k per question); hinting them as the build side
    keeps the collection scan un-shuffled when they fit the broadcast threshold.
    """
    meta = FL.hit_metadata(F.col("payload")) if "payload" in points.columns else F.create_map().cast("map<string,string>")
    pay = points.select(F.col(point_id).alias("_pid"), F.col("doc_id").cast("string").alias("doc_id"), "text",
                        meta.alias("meta"), *([F.col(vector).cast("array<double>").alias("vector")] if vector else []))
    h = F.broadcast(hits) if broadcast_hits else hits
    j = h.join(pay, h[point_id] == pay["_pid"], "inner")
    has_meta = F.coalesce(F.size("meta") > 0, F.lit(False))
    return j.select(
        key, "rank", "score", "doc_id", "text",
        F.when(has_meta, F.col("meta").getItem("title")).alias("title"),
        F.when(has_meta, F.coalesce(F.col("meta").getItem("url"), F.lit(""))).alias("url"),
        has_meta.alias("has_meta"), *(["vector"] if vector else []),
    )


def contexts_per_event(hits_payload: DataFrame, key: str = "event_id") -> DataFrame:
    """Long hits -> one row per event with contexts in rank order and the D2 log text."""
    ctx = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CONTEXT_TYPE.fields])
    parts = [F.array_sort(F.collect_list(ctx)).alias("contexts")]
    extra = []
    if "vector" in hits_payload.columns:  # for a reranker: in the order of the contexts
        parts.append(F.array_sort(F.collect_list(F.struct("rank", "vector"))).alias("_v"))
        extra = [F.transform("_v", lambda x: x["vector"]).alias("vectors")]
    agg = hits_payload.groupBy(key).agg(*parts)
    # A context with metadata must have a title, else the event takes the error path
    bad_title = F.exists("contexts", lambda c: c["has_meta"] & c["title"].isNull())
    log = F.array_join(F.transform("contexts", lambda c: F.concat(c["doc_id"], F.lit(":"), score_text(c["score"]))),
                       ",")
    return agg.select(key, "contexts", log.alias("hit_log"), bad_title.alias("bad_title"), *extra)


def fallback_context(prefix: str) -> Column:
    """A single context that explains the failure."""
    return F.array(F.struct(
        F.lit(0).alias("rank"), F.lit("").alias("doc_id"), F.lit(prefix + K.FALLBACK_TAIL).alias("text"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("url"), F.lit(False).alias("has_meta")))


SEARCH_KEY = "_search"


def search_key(query_vector: str = "qvec", metadata: str | None = "metadata") -> Column:
    """128 bits over all that a search depends on: the vector and the filter. Rows are matched with their
    hits by it, not by the event id, so repeated and null event ids keep their own contexts."""
    parts = [F.col(query_vector)] + ([F.to_json(F.array_sort(F.map_entries(metadata)))] if metadata else [])
    return F.concat_ws(":", F.xxhash64(*parts).cast("string"), F.xxhash64(F.lit(1), *parts).cast("string"))


def state_key(asks: Column, key: Column) -> Column:
    """``key`` for the rows that search; the others get one of many values that no search has, so that they
    do not meet in one task when the results are joined back."""
    return F.when(asks, key).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64("event_id", "user_query"), F.lit(1 << 20)).cast("string")))


def retrieve_contexts(questions: DataFrame, points: DataFrame, k: int, *, key: str = "event_id",
                      query_vector: str = "qvec", metadata: str | None = "metadata",
                      filter_keys=None, search_params=None, must=(), should=(),
                      max_broadcast_bytes: int = 64 << 20, block_bytes: int = BLOCK_BYTES, metric: str = "dot",
                      info: dict | None = None, with_vectors: bool = False) -> DataFrame:
    """Questions -> ``(key, contexts, hit_log, bad_title)`` (and ``vectors``, those of the contexts): one row for each ``key`` with at least one hit.
    Without ``filter_keys`` metadata may name any plain column of ``points`` but its text."""
    q = questions
    spec = None
    if metadata is not None:
        q = q.withColumn("_spec", FL.metadata_must(F.col(metadata)))
        spec = "_spec"
        if filter_keys is None:
            filter_keys = [f.name for f in points.schema if isinstance(f.dataType, T.AtomicType) and f.name not in ("id", "text")]
    q = q.dropDuplicates([key])
    info = info if info is not None else {}
    hits = similarity_topk(q, points, k, key=key, query_vector=query_vector, metadata_filter=spec,
                           filter_keys=filter_keys, must=must, should=should, search_params=search_params,
                           metric=metric, block_bytes=block_bytes, info=info)
    return contexts_per_event(hits_with_payload(hits, points, key=key, broadcast_hits=hits_fit(info, k, max_broadcast_bytes),
                                                vector="vector" if with_vectors else None), key=key)


_HIT_BYTES = 96


def hits_fit(info: dict, k: int, budget: int) -> bool:
    """Broadcast the hits into the collection scan when they are provably small.

    The top-k counts the questions, so the hits are at most ``n * k`` rows of (key, rank, id, score):
    broadcasting them keeps the collection and its texts from being shuffled for the payload join. Beyond the
    budget the join is left to the planner and AQE.
    """
    n = info.get("n_questions")
    return n is not None and n * k * _HIT_BYTES <= budget


def zip_hits(documents: Column, ids: Column, scores: Column) -> Column:
    """Pair parallel arrays by position, stopping at the shortest."""
    n = F.least(F.size(documents), F.size(ids), F.size(scores))
    return F.arrays_zip(F.slice(documents, 1, n).alias("document"), F.slice(ids, 1, n).alias("id"),
                        F.slice(scores, 1, n).alias("score"))
