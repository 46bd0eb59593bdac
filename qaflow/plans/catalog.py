"""Registered queries: one Spark plan per operator, each over the whole driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame; :data:`ORACLES`
holds the DuckDB SQL with the same column names for the keys that have one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..config import GenerateConfig, PipelineConfig, RedactionConfig, RerankConfig, RetrievalConfig
from ..functions import text as TX
from ..functions import vectors as V
from ..operators import cache as C
from ..operators import consolidate as CO
from ..operators import filters as FL
from ..operators import generate as G
from ..operators import rerank as RR
from ..operators import retrieve as R
from ..operators.topk import adhoc_query, similarity_topk
from ..session import materialised, shared_path
from ..sources import articles as A
from ..sources import evallog as EL
from ..sources import tables as TB
from . import oracle_sql as O
from . import routing as RT
from .pipeline import Pipeline, metric_rows

# ------------------------------------------------------------------------------ shared inputs


def _points(spark, d):
    return TB.collection_points(spark, d)


def _questions(spark, d):
    return TB.questions(spark, d)


def _hits(spark, d, k, label_filter=True, **kw):
    q = _questions(spark, d)
    spec = None
    if label_filter:
        q = q.withColumn("_spec", FL.metadata_must(F.col("metadata")))
        spec = "_spec"
    return similarity_topk(q, kw.pop("points", None) or _points(spark, d), k, metadata_filter=spec,
                           filter_keys=["label"], **kw)


def _ctx_long(spark, d, k, **kw):
    pts = _points(spark, d)
    info: dict = {}
    hits = _hits(spark, d, k, points=pts, info=info, **kw)
    return R.hits_with_payload(hits, pts, broadcast_hits=R.hits_fit(info, k, 64 << 20))


def _pipeline_state(spark, d, cfg=None, **kw):
    p = Pipeline(points=_points(spark, d), config=cfg or PipelineConfig(), filter_keys=["label"], **kw)
    state, _ = p.run(_questions(spark, d))
    return state


def _error_types(col="errors"):
    return F.array_join(F.transform(col, lambda e: e["error_type"]), ",")


Q: dict = {}
ORACLES: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------------------ P1 pipeline

@register("rag_pipeline", O.pipeline() + """
SELECT event_id, cleaned_request, relevant_document_ids_scores, prompt, generated_text, error_types FROM pipe""")
def rag_pipeline(spark, d):
    s = _pipeline_state(spark, d)
    return s.select("event_id", F.col("m_cleaned_request").alias("cleaned_request"),
                    F.col("m_relevant_document_ids_scores").alias("relevant_document_ids_scores"),
                    F.col("m_prompt").alias("prompt"), F.col("response").alias("generated_text"),
                    _error_types().alias("error_types"))


@register("contexts_array", O.pipeline() + "\nSELECT event_id, context_ids FROM pipe")
def contexts_array(spark, d):
    s = _pipeline_state(spark, d)
    return s.select("event_id", F.array_join(F.transform("contexts", lambda c: c["doc_id"]), ",").alias("context_ids"))


@register("error_stack", O.pipeline() + """,
errs AS (
  SELECT event_id, 5 AS stage, 'AllDocumentsExceedContextWindowError' AS error_type, 0 AS o FROM pipe WHERE cons_err
  UNION ALL SELECT event_id, 3, 'NoDcoumentsRetrievedError', 0 FROM pipe WHERE NOT has_hits
  UNION ALL SELECT event_id, 6, 'ModelUnavailableError', 1 FROM pipe
)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY o, stage) - 1 AS INTEGER) AS seq,
       CAST(stage AS INTEGER) AS stage, error_type FROM errs""")
def error_stack(spark, d):
    s = _pipeline_state(spark, d)
    return s.select("event_id", F.posexplode("errors").alias("seq", "e")) \
        .select("event_id", F.col("seq").cast("int").alias("seq"), F.col("e.stage").alias("stage"),
                F.col("e.error_type").alias("error_type"))


@register("eval_metrics_wide", O.pipeline() + """
SELECT event_id, cleaned_request, prompt, relevant_document_ids_scores, CAST(NULL AS VARCHAR) AS response_text FROM pipe""")
def eval_metrics_wide(spark, d):
    s = _pipeline_state(spark, d)
    recs = EL.records(metric_rows(s))
    wide = EL.metrics_wide(recs, ["cleaned_request", "prompt", "relevant_document_ids_scores", "response_text"])
    return wide.select("event_id", "cleaned_request", "prompt", "relevant_document_ids_scores", "response_text")


_TIMED = "'clean_sensitive_info_seconds', 'embed_seconds', 'retrieve_seconds', 'query_llm_seconds'"


@register("eval_log_write", O.pipeline() + """,
emb AS (SELECT 'q' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS event_id, array_to_string(list_transform(embedding,
               lambda x: CAST(CAST(CAST(x AS DOUBLE) AS DECIMAL(18,6)) AS VARCHAR)), ',') AS v FROM embeddings)
SELECT p.event_id, m.metric, CASE m.metric WHEN 'cleaned_request' THEN cleaned_request WHEN 'user_query_embedding' THEN emb.v
       WHEN 'relevant_document_ids_scores' THEN relevant_document_ids_scores WHEN 'prompt' THEN prompt ELSE 'seconds' END AS value
FROM pipe p JOIN emb ON emb.event_id = p.event_id,
     (VALUES ('clean_sensitive_info_seconds'), ('cleaned_request'), ('embed_seconds'), ('user_query_embedding'), ('retrieve_seconds'),
             ('relevant_document_ids_scores'), ('prompt')) m(metric)""")
def eval_log_write(spark, d):
    """A8 + D7: timed run (a checkpoint per stage), records appended, read back. Wall times are only tested to be numbers."""
    p = Pipeline(points=_points(spark, d), filter_keys=["label"])
    state, secs = p.run(_questions(spark, d), timed=True)
    path = shared_path(spark, "eval")
    EL.write(EL.records(metric_rows(state, secs)), path)
    value = TX.json_field(F.col("log"), "value")
    return EL.read(spark, path).select("event_id", TX.json_field(F.col("log"), "metric").alias("metric"), value.alias("v")) \
        .select("event_id", "metric", F.when(F.expr(f"metric IN ({_TIMED})") & (F.col("v").try_cast("double") >= 0), F.lit("seconds")).otherwise(F.col("v")).alias("value"))


@register("generate_with_fallback", O.pipeline() + f"""
SELECT event_id,
       CASE WHEN length(prompt) <= 3000 THEN substr(prompt || 'The answer is 42.', length(prompt))
            ELSE generated_text END AS response,
       CASE WHEN length(prompt) <= 3000 THEN NULL ELSE 'ValueError' END AS error_type
FROM pipe""")
def generate_with_fallback(spark, d):
    """A model that answers short prompts and fails on long ones."""
    base = G.echo_model()

    def model(prompts):
        if (prompts.str.len() > 3000).any():
            raise ValueError("prompt longer than the model's window")
        return base(prompts)

    cfg = PipelineConfig(generate=GenerateConfig(model=model))
    s = _pipeline_state(spark, d, cfg)
    last = F.element_at("errors", -1)
    err = F.when(F.size("errors") > 0, F.when(last["stage"] == K.GENERATE, last["error_type"]))
    return s.select("event_id", F.col("response").alias("response"), err.alias("error_type"))


@register("rewrite_identity", O.pipeline() + "\nSELECT event_id, cleaned_request, generated_text FROM pipe")
def rewrite_identity(spark, d):
    p = Pipeline(points=_points(spark, d), filter_keys=["label"],
                 stages=["SECURITY", "REWRITE", "RETRIEVE", "RERANK", "CONSOLIDATE", "GENERATE", "WCACHE"])
    s, _ = p.run(_questions(spark, d))
    return s.select("event_id", F.col("m_cleaned_request").alias("cleaned_request"),
                    F.col("response").alias("generated_text"))


# ------------------------------------------------------------------------------ scalar functions

@register("redact_requests", f"WITH {O.QUESTIONS.strip()}\nSELECT event_id, {O.redact('user_query')} AS user_query FROM questions")
def redact_requests(spark, d):
    q = _questions(spark, d)
    return q.select("event_id", TX.redact(F.col("user_query"), K.REDACTION_TOKENS).alias("user_query"))


@register("redact_documents", f"SELECT doc_id, {O.redact('text')} AS text FROM documents")
def redact_documents(spark, d):
    docs = TB.table(spark, d, "documents")
    return docs.select("doc_id", TX.redact(F.col("text"), K.REDACTION_TOKENS).alias("text"))


@register("format_context", f"WITH {O.POINTS.strip()}\nSELECT id, {O.fmt()} AS formatted FROM points")
def format_context(spark, d):
    p = _points(spark, d)
    has_meta = F.size("payload") > 0
    return p.select("id", TX.format_context(F.col("text"), F.col("title"),
                                            F.coalesce(F.col("url"), F.lit("")), has_meta).alias("formatted"))


@register("prompt_basic", f"WITH {O.QUESTIONS.strip()}, {O.POINTS.strip()}\n"
          f"SELECT q.event_id, {O.prompt('q.user_query', O.fmt('p.text', 'p.title', 'p.url', 'p.has_meta'))} AS prompt "
          "FROM questions q JOIN points p ON p.id = CAST(substr(q.event_id, 2) AS BIGINT)")
def prompt_basic(spark, d):
    """H8 on each question with the formatted text of its own point as context."""
    q, p = _questions(spark, d), _points(spark, d)
    j = q.join(p, F.substring("event_id", 2, 9).cast("long") == p.id)
    ctx = TX.format_context(F.col("text"), F.col("title"), F.coalesce(F.col("url"), F.lit("")), F.size("payload") > 0)
    return j.select("event_id", TX.build_prompt(F.col("user_query"), ctx, "basic").alias("prompt"))


@register("prompt_plain", f"WITH {O.QUESTIONS.strip()}, {O.POINTS.strip()}\n"
          f"SELECT q.event_id, {O.prompt('q.user_query', 'p.text', 'plain')} AS prompt "
          "FROM questions q JOIN points p ON p.id = CAST(substr(q.event_id, 2) AS BIGINT)")
def prompt_plain(spark, d):
    q, p = _questions(spark, d), _points(spark, d)
    j = q.join(p, F.substring("event_id", 2, 9).cast("long") == p.id)
    return j.select("event_id", TX.build_prompt(F.col("user_query"), F.col("text"), "plain").alias("prompt"))


@register("prompt_too_long", O.pipeline() + "\nSELECT event_id, (300 - length(prompt)) <= 10 AS prompt_too_long FROM pipe")
def prompt_too_long(spark, d):
    s = _pipeline_state(spark, d)
    return s.select("event_id", "prompt_too_long")


@register("strip_prompt", f"WITH {O.QUESTIONS.strip()}\n"
          "SELECT event_id, CASE WHEN length(user_query) = 0 THEN right(user_query || ' Answer: ' || event_id, 1) "
          "ELSE substr(user_query || ' Answer: ' || event_id, length(user_query)) END AS answer FROM questions")
def strip_prompt(spark, d):
    q = _questions(spark, d)
    gen = F.concat(F.col("user_query"), F.lit(" Answer: "), F.col("event_id"))
    return q.select("event_id", TX.strip_prompt(gen, F.col("user_query")).alias("answer"))


_EVENT_ID_SQL = ("substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) || '-' || substr(sha256(CAST(event_id AS VARCHAR)), 9, 4) "
                 "|| '-' || substr(sha256(CAST(event_id AS VARCHAR)), 13, 4) || '-' || substr(sha256(CAST(event_id AS VARCHAR)), 17, 4) "
                 "|| '-' || substr(sha256(CAST(event_id AS VARCHAR)), 21, 12) || strftime(ts, '%Y-%m-%d %H:%M:%S.%f')")


@register("event_day", f"SELECT event_id AS source_id, {_EVENT_ID_SQL} AS eval_event_id, CAST(ts AS DATE) AS day FROM events")
def event_day(spark, d):
    ev = TB.table(spark, d, "events")
    eid = TX.event_id(F.col("event_id"), F.col("ts"))
    return ev.select(F.col("event_id").alias("source_id"), eid.alias("eval_event_id")) \
        .select("source_id", "eval_event_id", F.to_date(TX.event_time(F.col("eval_event_id"))).alias("day"))


@register("digit_encode", "SELECT o_orderkey, CASE WHEN regexp_matches(substr(CAST(o_orderkey AS VARCHAR) || ' ' || "
          "o_orderpriority, 1, 4), '^[0-9]{4}$') THEN array_to_string(list_transform(string_split(substr(CAST(o_orderkey "
          "AS VARCHAR) || ' ' || o_orderpriority, 1, 4), ''), lambda x: CAST(CAST(x AS FLOAT) AS VARCHAR)), ',') END AS vec "
          "FROM orders")
def digit_encode(spark, d):
    o = TB.table(spark, d, "orders")
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority"))
    vec = TX.digit_encode(text, 4)
    return o.select("o_orderkey", F.array_join(F.transform(vec, lambda x: x.cast("string")), ",").alias("vec"))


@register("json_log_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, "
          "json_extract_string(json_object('metric', event_type, 'value', value), '$.metric') AS metric FROM events")
def json_log_fields(spark, d):
    ev = TB.table(spark, d, "events")
    log = F.to_json(F.struct(F.col("event_type").alias("metric"), F.col("value").alias("value")))
    return ev.select("event_id", TX.json_field(F.col("props"), "k").alias("k"),
                     TX.json_field(log, "metric").alias("metric"))


@register("embedding_log", "SELECT 'q' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS event_id, "
          "array_to_string(list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) AS DECIMAL(18,6)) AS VARCHAR)), ',') "
          "AS user_query_embedding FROM embeddings")
def embedding_log(spark, d):
    q = _questions(spark, d)
    return q.select("event_id", R.embedding_log(F.col("qvec")).alias("user_query_embedding"))


# ------------------------------------------------------------------------------ top-k / retrieval

_HITS_OUT = "SELECT event_id, rank, id, round(score, 6) AS score FROM hits"


def _hits_out(df):
    return df.select("event_id", F.col("rank").cast("int").alias("rank"), "id", F.round("score", 6).alias("score"))


@register("topk_dot", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(2, label_filter=False).strip()}\n{_HITS_OUT}")
def topk_dot(spark, d):
    return _hits_out(_hits(spark, d, 2, label_filter=False))


@register("topk_must", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(3).strip()}\n{_HITS_OUT}")
def topk_must(spark, d):
    return _hits_out(_hits(spark, d, 3))


@register("topk_must_should", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, "
          f"{O.hits(4, label_filter=False, where=chr(39).join(['p.lang = ', 'en', ' AND p.source IN (', 'src1', ', ', 'src2', ', ', 'src3', ')'])).strip()}\n{_HITS_OUT}")
def topk_must_should(spark, d):
    """Must lang = 'en' AND (source = src1 OR src2 OR src3), for every question."""
    return _hits_out(_hits(spark, d, 4, label_filter=False, must=[("lang", "en")],
                           should=[("source", "src1"), ("source", "src2"), ("source", "src3")]))


@register("topk_threshold_offset", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, "
          f"{O.hits(3, offset=1, threshold=0.2).strip()}\n{_HITS_OUT}")
def topk_threshold_offset(spark, d):
    return _hits_out(_hits(spark, d, 3, search_params={"offset": 1, "score_threshold": 0.2}))


@register("hit_metadata", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(2).strip()}, {O.CTX.strip()}\n"
          "SELECT event_id, rank, doc_id, title, url, has_meta FROM ctx")
def hit_metadata(spark, d):
    return _ctx_long(spark, d, 2).select("event_id", F.col("rank").cast("int").alias("rank"), "doc_id", "title", "url",
                                         "has_meta")


@register("contexts", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(2).strip()}, {O.CTX.strip()}\n"
          "SELECT event_id, rank, doc_id, text, round(score, 6) AS score, title, url, has_meta FROM ctx")
def contexts(spark, d):
    c = _ctx_long(spark, d, 2)
    return c.select("event_id", F.col("rank").cast("int").alias("rank"), "doc_id", "text",
                    F.round("score", 6).alias("score"), "title", "url", "has_meta")


@register("hit_log", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(3).strip()}, {O.CTX.strip()}\n"
          "SELECT event_id, string_agg(doc_id || ':' || CAST(CAST(score AS DECIMAL(18,6)) AS VARCHAR), ',' ORDER BY rank) "
          "AS relevant_document_ids_scores FROM ctx GROUP BY event_id")
def hit_log(spark, d):
    per = R.contexts_per_event(_ctx_long(spark, d, 3))
    return per.select("event_id", F.col("hit_log").alias("relevant_document_ids_scores"))


@register("context_text", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(3).strip()}, {O.CTX.strip()}\n"
          f"SELECT event_id, string_agg({O.fmt()}, '' ORDER BY rank) AS context FROM ctx GROUP BY event_id")
def context_text(spark, d):
    per = R.contexts_per_event(_ctx_long(spark, d, 3))
    fmt = F.transform("contexts", lambda c: c.withField(
        "text", TX.format_context(c["text"], c["title"], c["url"], c["has_meta"])))
    return per.select("event_id", G.context_text(fmt).alias("context"))


@register("fallback_references", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(3).strip()}, {O.CTX.strip()}\n"
          f"SELECT event_id, {O.lit(K.NO_MODEL_REFERENCES_PREFIX)} || string_agg({O.ref_line('rank - 1')}, '' ORDER BY rank) "
          "AS generated_text FROM ctx GROUP BY event_id")
def fallback_references(spark, d):
    per = R.contexts_per_event(_ctx_long(spark, d, 3))
    return per.select("event_id", G.fallback_answer(F.col("contexts"), "references").alias("generated_text"))


@register("fallback_documents", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(3).strip()}, {O.CTX.strip()}\n"
          f"SELECT event_id, {O.lit(K.NO_MODEL_DOCUMENTS_PREFIX)} || string_agg(text, '' ORDER BY rank) "
          "AS generated_text FROM ctx GROUP BY event_id")
def fallback_documents(spark, d):
    per = R.contexts_per_event(_ctx_long(spark, d, 3))
    return per.select("event_id", G.fallback_answer(F.col("contexts"), "documents").alias("generated_text"))


@register("zip_hits", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(3).strip()}, {O.CTX.strip()}\n"
          "SELECT event_id, CAST(rank - 1 AS INTEGER) AS pos, doc_id, round(score, 6) AS score FROM ctx WHERE rank <= 2")
def zip_hits(spark, d):
    """Documents (3 per event) zipped with scores cut to 2 -> 2 pairs per event."""
    per = _ctx_long(spark, d, 3).groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("h"))
    docs = F.transform("h", lambda x: x["doc_id"])
    scores = F.slice(F.transform("h", lambda x: x["score"]), 1, 2)
    z = R.zip_hits(docs, docs, scores)
    return per.select("event_id", F.posexplode(z).alias("pos", "z")).select(
        "event_id", F.col("pos").cast("int").alias("pos"), F.col("z.document").alias("doc_id"),
        F.round("z.score", 6).alias("score"))


_FIRST_VEC = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@register("adhoc_query", f"WITH {O.POINTS.strip()}\nSELECT id, doc_id, round({O.DOT.format(a='p.vector', b=_FIRST_VEC)}, 6) "
          "AS score FROM points p ORDER BY score DESC, id ASC LIMIT 3")
def adhoc_query_q(spark, d):
    """One query (the first embedding's vector) against the whole collection, limit 3."""
    first = TB.table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]
    out = adhoc_query(_points(spark, d), list(first), 3)
    return out.select("id", "doc_id", F.round("score", 6).alias("score"))


_CURATED = ("points_curated AS (SELECT p.* FROM points p WHERE p.id IN (SELECT doc_id FROM labels WHERE quality = 1))")


@register("retrieve_fallback", f"WITH {O.POINTS.strip()}, {_CURATED}, {O.QUESTIONS.strip()}, "
          f"{O.hits(2, threshold=0.25, points='points_curated').strip()}\n"
          f"SELECT q.event_id, coalesce(string_agg(CAST(h.id AS VARCHAR), ',' ORDER BY h.rank), '') AS context_ids, "
          f"CASE WHEN count(h.id) = 0 THEN {O.lit(K.NO_DOCUMENTS_PREFIX + K.FALLBACK_TAIL)} END AS fallback, "
          f"CASE WHEN count(h.id) = 0 THEN {O.lit(K.NO_DOCUMENTS_ERROR)} END AS error_type "
          "FROM questions q LEFT JOIN hits h ON h.event_id = q.event_id GROUP BY q.event_id")
def retrieve_fallback(spark, d):
    """G1: a curated collection (quality documents) with a relevance cut: questions without
    any hit get the no-documents context and jump to GENERATE."""
    curated = _points(spark, d).join(TB.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")),
                                     "id", "left_semi")
    cfg = PipelineConfig(retrieval=RetrievalConfig(search_params={"score_threshold": 0.25}))
    s, _ = Pipeline(points=curated, config=cfg, filter_keys=["label"], stages=["RETRIEVE"]).run(_questions(spark, d))
    nohit = F.exists("errors", lambda e: e["error_type"] == K.NO_DOCUMENTS_ERROR)
    return s.select("event_id",
                    F.when(nohit, F.lit("")).otherwise(F.array_join(F.transform("contexts", lambda c: c["doc_id"]), ","))
                    .alias("context_ids"),
                    F.when(nohit, F.element_at("contexts", 1)["text"]).alias("fallback"),
                    F.when(nohit, F.lit(K.NO_DOCUMENTS_ERROR)).alias("error_type"))


# ------------------------------------------------------------------------------ consolidation

def _consolidate_key(strategy, limit, k, tokens_sql="length(fmt)", counter=TX.char_tokens):
    sql = (f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(k).strip()}, {O.CTX.strip()}, "
           f"{O.consolidation(strategy, limit, tokens_sql).strip()}\n"
           "SELECT event_id, pos, rank, doc_id, out_text AS text, error FROM cons")

    def fn(spark, d):
        c = _ctx_long(spark, d, k)
        out = CO.consolidate_long(c, strategy, limit, counter)
        return out.select("event_id", "pos", F.col("rank").cast("int").alias("rank"), "doc_id", "text", "error")

    return fn, sql


for _name, _args in {
    "consolidate_simple": ("simple", 4000, 3),
    "consolidate_score_weighted": ("score_weighted", 4000, 3),
    "consolidate_unsorted": ("unsorted", 4000, 3),
    "consolidate_overflow": ("simple", 1000, 3),
}.items():
    _fn, _sql = _consolidate_key(*_args)
    register(_name, _sql)(_fn)

_fn, _sql = _consolidate_key("simple", 600, 3,
                             "CASE WHEN length(trim(fmt)) = 0 THEN 0 ELSE length(string_split_regex(trim(fmt), '\\s+')) END",
                             TX.word_tokens)
register("consolidate_words", _sql)(_fn)


@register("consolidate_array", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(3).strip()}, {O.CTX.strip()}, "
          f"{O.consolidation('simple', 2500).strip()},\n"
          "agg AS (SELECT event_id, string_agg(doc_id, ',' ORDER BY pos) AS ids, string_agg(out_text, '' ORDER BY pos) AS txt, "
          "max(error) AS error FROM cons GROUP BY event_id)\n"
          "SELECT e.event_id, coalesce(a.ids, '') AS context_ids, coalesce(a.txt, '') AS context, a.error "
          "FROM (SELECT DISTINCT event_id FROM ctx) e LEFT JOIN agg a ON a.event_id = e.event_id")
def consolidate_array_q(spark, d):
    """The in-row form used by the pipeline, on the same hits (must equal the window form)."""
    per = R.contexts_per_event(_ctx_long(spark, d, 3))
    r = CO.consolidate_array(F.col("contexts"), "simple", 2500)
    out = per.select("event_id", r.alias("r"))
    return out.select("event_id", F.array_join(F.transform("r.contexts", lambda c: c["doc_id"]), ",").alias("context_ids"),
                      G.context_text(F.col("r.contexts")).alias("context"), F.col("r.error").alias("error"))


# ------------------------------------------------------------------------------ rerank / cache

@register("rerank_by_score", f"WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(5).strip()}, {O.CTX.strip()},\n"
          "rr AS (SELECT c.event_id, CAST(row_number() OVER (PARTITION BY c.event_id ORDER BY coalesce(l.quality, 0) DESC, "
          "c.rank ASC) AS INTEGER) AS new_rank, c.doc_id, c.rank AS retrieval_rank FROM ctx c LEFT JOIN labels l "
          "ON CAST(l.doc_id AS VARCHAR) = c.doc_id)\n"
          "SELECT event_id, new_rank AS rank, doc_id, retrieval_rank FROM rr WHERE new_rank <= 3")
def rerank_by_score(spark, d):
    """K6 with a column scorer: quality label first, retrieval order second; keep 3 of 5."""
    c = _ctx_long(spark, d, 5).withColumn("retrieval_rank", F.col("rank").cast("int"))
    lab = TB.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality")
    c = c.join(lab, "doc_id", "left")
    out = RR.rerank_long(c, F.coalesce(F.col("quality"), F.lit(0)), 3)
    return out.select("event_id", F.col("rank").cast("int").alias("rank"), "doc_id", "retrieval_rank")


@register("rerank_svm")
def rerank_svm(spark, d):
    """K6: a linear SVM learned from document quality labels reorders each question's hits."""
    pts = _points(spark, d)
    model = RR.fit_svm_scorer(pts, TB.table(spark, d, "labels"))
    hits = _hits(spark, d, 5, points=pts).join(pts.select("id", "vector", "doc_id"), "id")
    scored = RR.svm_margins(model, hits)
    return RR.rerank_long(scored, F.col("margin"), 3).select("event_id", "rank", "doc_id", "margin")


@register("rerank_ranking_svm")
def rerank_ranking_svm(spark, d):
    """K6 in the pipeline: a ranking SVM learned from pairs of each question's hits (label quality) reorders the contexts in the
    RERANK stage. Trained, so no SQL: ``ordered`` says that the contexts are in the order of the exported weights."""
    pts = _points(spark, d)
    quality = TB.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("relevance"))
    hits = _hits(spark, d, 5, points=pts).join(pts.select("id", "vector"), "id").join(quality, "id")
    weights = RR.fit_ranking_svm(hits)
    cfg = PipelineConfig(retrieval=RetrievalConfig(top_k=5), rerank=RerankConfig(top_k=3))
    s, _ = Pipeline(points=pts, config=cfg, filter_keys=["label"], rerank_weights=weights, stages=["RETRIEVE", "RERANK"]).run(_questions(spark, d))
    w = F.array(*[F.lit(x) for x in weights])
    scores = F.reverse(F.array_sort(F.transform("context_vectors", lambda v: V.dot(v, w))))
    top = s.select("event_id", "contexts", F.slice(scores, 1, 3).alias("best"))
    own = top.select("event_id", "best", F.posexplode("contexts").alias("pos", "c")).join(pts.select(F.col("doc_id").alias("of"), V.dot(F.col("vector"), w).alias("score")), F.col("c.doc_id") == F.col("of"))
    return own.select("event_id", F.col("c.rank").alias("rank"), F.col("c.doc_id").alias("doc_id"), F.round("score", 9).alias("score"),
                      (F.abs(F.col("score") - F.col("best")[F.col("pos")]) < 1e-9).alias("ordered"))


@register("redact_two_kinds", f"WITH {O.QUESTIONS.strip()}\nSELECT event_id, regexp_replace({O.redact('user_query')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '<REDACTED: Dates>', 'g') "
          "AS cleaned_request FROM questions")
def redact_two_kinds(spark, d):
    """H2 through the pipeline's config: a second kind with its own pattern and token."""
    kinds = RedactionConfig(redaction_map=K.REDACTION_TOKENS | {"Dates": "<REDACTED: Dates>"}, patterns={"Dates": "[0-9]{4}-[0-9]{2}-[0-9]{2}"})
    s, _ = Pipeline(points=_points(spark, d), config=PipelineConfig(redaction=kinds), stages=["SECURITY"]).run(_questions(spark, d))
    return s.select("event_id", F.col("m_cleaned_request").alias("cleaned_request"))


@register("retrieve_bad_vectors", f"""WITH {O.POINTS.strip()}, {O.QUESTIONS.strip()}, {O.hits(2).strip()},
q AS (SELECT event_id, CAST(substr(event_id, 2) AS BIGINT) % 3 AS kind FROM questions),
agg AS (SELECT event_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM hits GROUP BY event_id)
SELECT q.event_id, CASE WHEN kind = 0 THEN coalesce(a.ids, '') ELSE '' END AS context_ids,
       CASE WHEN kind = 1 THEN {O.lit(K.OTHER_ERROR_PREFIX + K.FALLBACK_TAIL)} WHEN kind = 2 THEN {O.lit(K.EMBED_ERROR_PREFIX + K.FALLBACK_TAIL)} END AS fallback,
       CASE kind WHEN 1 THEN {O.lit(K.SEARCH_ARGUMENTS_ERROR)} WHEN 2 THEN {O.lit(K.EMBED_TIMEOUT_ERROR)} ELSE '' END AS error_types,
       CAST(CASE WHEN kind = 2 THEN {K.GENERATE} END AS INTEGER) AS sentinel
FROM q LEFT JOIN agg a ON a.event_id = q.event_id""")
def retrieve_bad_vectors(spark, d):
    """A third of the questions has a vector of another size, a third has none and an encoder that fails; the rest is answered."""
    class Failing:
        def encode(self, texts):
            raise RuntimeError("no model today")

    kind = F.substring("event_id", 2, 9).cast("long") % 3
    q = _questions(spark, d).withColumn("qvec", F.when(kind == 0, F.col("qvec")).when(kind == 1, F.slice("qvec", 1, 5)))
    s, _ = Pipeline(points=_points(spark, d), filter_keys=["label"], encoder=V.model_encoder(Failing, 64), stages=["RETRIEVE"]).run(q)
    failed = F.size("errors") > 0
    return s.select("event_id", F.when(failed, F.lit("")).otherwise(F.array_join(F.transform("contexts", lambda c: c["doc_id"]), ",")).alias("context_ids"),
                    F.when(failed, F.element_at("contexts", 1)["text"]).alias("fallback"), _error_types().alias("error_types"), "sentinel")


_CACHE_SQL = f"""WITH {O.QUESTIONS.strip()},
cache AS (SELECT vec_id AS cache_id, embedding AS cvec FROM embeddings WHERE label < 5),
sc AS (SELECT q.event_id, c.cache_id,
              {O.DOT.format(a='q.qvec', b='c.cvec')} / (sqrt({O.DOT.format(a='q.qvec', b='q.qvec')}) *
              sqrt({O.DOT.format(a='c.cvec', b='c.cvec')})) AS sim
       FROM questions q JOIN cache c ON TRUE),
best AS (SELECT event_id, cache_id, 1 - sim AS distance FROM sc
         QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY sim DESC, cache_id ASC) = 1)"""


def _cache_table(spark, d):
    e = TB.table(spark, d, "embeddings").where("label < 5")
    return e.select(F.col("vec_id").alias("cache_id"), F.col("embedding").alias("cvec"),
                    F.lit(None).cast("string").alias("user_query"), F.lit(None).cast(R.CONTEXTS_TYPE).alias("contexts"),
                    F.concat(F.lit("cached answer "), F.col("vec_id").cast("string")).alias("response"),
                    (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(secs=F.col("vec_id").cast("double")))
                    .alias("ts"))


@register("cache_hits", _CACHE_SQL + "\nSELECT event_id, cache_id, round(greatest(distance, 0.0), 6) AS distance FROM best "
          "WHERE distance <= 0.05")
def cache_hits(spark, d):
    from ..config import CacheConfig
    h = C.cache_lookup(_questions(spark, d).select("event_id", "qvec"), _cache_table(spark, d), CacheConfig())
    return h.select("event_id", "cache_id", F.round(F.greatest("distance", F.lit(0.0)), 6).alias("distance"))


@register("cache_misses", _CACHE_SQL + "\nSELECT q.event_id FROM questions q WHERE q.event_id NOT IN "
          "(SELECT event_id FROM best WHERE distance <= 0.05)")
def cache_misses(spark, d):
    from ..config import CacheConfig
    q = _questions(spark, d).select("event_id", "qvec")
    h = C.cache_lookup(q, _cache_table(spark, d), CacheConfig())
    return C.cache_misses(q, h).select("event_id")


@register("cache_write", "WITH cache AS (SELECT vec_id AS cache_id, TIMESTAMP '2024-01-01' + to_seconds(vec_id) AS ts "
          "FROM embeddings WHERE label < 5), new AS (SELECT vec_id AS cache_id, TIMESTAMP '2024-01-02' AS ts "
          "FROM embeddings WHERE label >= 3 AND vec_id NOT IN (SELECT cache_id FROM cache)), "
          "allc AS (SELECT * FROM cache UNION ALL SELECT * FROM new)\n"
          "SELECT cache_id, ts FROM allc ORDER BY ts DESC, cache_id ASC LIMIT 300")
def cache_write(spark, d):
    """Answered questions (labels 3..9) appended to the cache (labels 0..4), newest 300 kept."""
    cache = _cache_table(spark, d)
    e = TB.table(spark, d, "embeddings").where("label >= 3")
    entries = e.select(F.col("vec_id").alias("cache_id"), F.col("embedding").alias("cvec"),
                       F.lit(None).cast("string").alias("user_query"), F.lit(None).cast(R.CONTEXTS_TYPE).alias("contexts"),
                       F.lit("new answer").alias("response"), F.lit("2024-01-02").cast("timestamp_ntz").alias("ts"))
    return C.cache_write(cache, entries, size=300).select("cache_id", "ts")


_MOVED_SQL = "list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i = 1 THEN 0.2 ELSE 0 END)"


def _moved(vec):
    """The vector with its first number moved by 0.2: near the old one, not equal to it."""
    return F.transform(vec, lambda x, i: x.cast("double") + F.when(i == 0, 0.2).otherwise(0.0))


@register("cache_hits_near", f"""WITH cache AS (SELECT vec_id AS cache_id, embedding AS cvec FROM embeddings WHERE label < 5),
q AS (SELECT 'q' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS event_id, {_MOVED_SQL} AS qvec FROM embeddings),
sc AS (SELECT q.event_id, c.cache_id, {O.DOT.format(a='q.qvec', b='c.cvec')} / (sqrt({O.DOT.format(a='q.qvec', b='q.qvec')}) *
              sqrt({O.DOT.format(a='c.cvec', b='c.cvec')})) AS sim FROM q JOIN cache c ON TRUE)
SELECT event_id, cache_id, round(1 - sim, 6) AS distance FROM sc
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY sim DESC, cache_id ASC) = 1 AND 1 - sim <= 0.05""")
def cache_hits_near(spark, d):
    """C4 with questions that are near their cached vectors but not equal to them."""
    from ..config import CacheConfig
    q = _questions(spark, d).select("event_id", _moved(F.col("qvec")).alias("qvec"))
    h = C.cache_lookup(q, _cache_table(spark, d), CacheConfig())
    return h.select("event_id", "cache_id", F.round("distance", 6).alias("distance"))


@register("cache_two_batches", O.pipeline() + f""",
vec AS (SELECT 'q' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS event_id, vec_id, embedding AS cvec, {_MOVED_SQL} AS qvec FROM embeddings),
cached AS (SELECT p.event_id, p.context_ids, v.cvec FROM pipe p JOIN vec v ON v.event_id = p.event_id WHERE v.vec_id % 2 = 0 AND p.has_hits),
sc AS (SELECT v.event_id, c.event_id AS cached_id, c.context_ids, {O.DOT.format(a='v.qvec', b='c.cvec')} / (sqrt({O.DOT.format(a='v.qvec', b='v.qvec')}) *
              sqrt({O.DOT.format(a='c.cvec', b='c.cvec')})) AS sim FROM vec v JOIN cached c ON TRUE),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY sim DESC) = 1 AND 1 - sim <= 0.05)
SELECT v.event_id, b.event_id IS NOT NULL AS cache_hit, b.context_ids AS cached_context_ids, '>The answer is 42.' AS response
FROM vec v LEFT JOIN best b ON b.event_id = v.event_id""")
def cache_two_batches(spark, d):
    """C4 + C5: a first batch (every second question) answers and fills the cache; the second (all questions, moved a little)
    finds it: hits skip to GENERATE with the cached contexts, the rest takes all stages."""
    store = C.CacheStore(spark, shared_path(spark, "cache"))
    cfg = PipelineConfig(generate=GenerateConfig(model=G.echo_model()))
    points = materialised(_points(spark, d), "points")  # read by both batches, several times each
    p = Pipeline(points=points, config=cfg, filter_keys=["label"], cache_store=store,
                 stages=["SECURITY", "RCACHE", "RETRIEVE", "CONSOLIDATE", "GENERATE", "WCACHE"])
    q = _questions(spark, d)
    p.run(q.where(F.substring("event_id", 2, 9).cast("long") % 2 == 0), batch="first")
    s, _ = p.run(q.withColumn("qvec", _moved(F.col("qvec"))), batch="second")
    ids = F.array_join(F.transform("contexts", lambda c: c["doc_id"]), ",")
    return s.select("event_id", "cache_hit", F.when(F.col("cache_hit"), ids).alias("cached_context_ids"), "response")


# ------------------------------------------------------------------------------ routing

def _met_sql(*stages):
    return "'" + "".join(RT.visited(x) for x in stages) + "'"


@register("stage_increment", "SELECT l_orderkey, l_linenumber, CAST(s AS INTEGER) AS sentinel, "
          "CAST(CASE WHEN s IS NULL OR s >= 7 THEN NULL ELSE s + 1 END AS INTEGER) AS next_stage FROM "
          "(SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL "
          "ELSE l_linenumber - (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 2 END) END AS s FROM lineitem)")
def stage_increment(spark, d):
    li = TB.table(spark, d, "lineitem")
    s = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.lit(None)) \
        .otherwise(F.col("l_linenumber") - F.when(F.col("l_linestatus") == "F", 0).otherwise(2)).cast("int")
    return li.select("l_orderkey", "l_linenumber", s.alias("sentinel")) \
        .withColumn("next_stage", RT.increment(F.col("sentinel")))


def _trace_input(spark, d):
    return TB.table(spark, d, "documents").select("doc_id", "lang", "text")


_ALL = range(K.LAST_STAGE + 1)


@register("stage_trace", f"SELECT doc_id, text || {_met_sql(*_ALL)} AS text, CAST(NULL AS INTEGER) AS sentinel FROM documents")
def stage_trace(spark, d):
    """I1 + I3: every stage in turn, on the whole texts."""
    s = RT.run_stages(RT.start(_trace_input(spark, d), K.SECURITY), RT.all_trace_stages(), linked=False)
    return s.select("doc_id", "text", "sentinel")


_SOME = (K.SECURITY, K.REWRITE, K.CONSOLIDATE, K.WCACHE)


@register("stage_trace_linked", f"SELECT doc_id, text || {_met_sql(*_SOME)} AS text, CAST(NULL AS INTEGER) AS sentinel FROM documents")
def stage_trace_linked(spark, d):
    """A list of some stages, each linked to the next one of the list."""
    s = RT.run_stages(RT.start(_trace_input(spark, d), K.SECURITY), [RT.trace_stage(x) for x in _SOME])
    return s.select("doc_id", "text", "sentinel")


@register("stage_trace_cache_hit", "SELECT doc_id, text || CASE WHEN lang = 'en' "
          f"THEN {_met_sql(K.SECURITY, K.GENERATE, K.WCACHE)} ELSE {_met_sql(*[x for x in _ALL if x != K.RCACHE])}"
          " END AS text, CAST(NULL AS INTEGER) AS sentinel FROM documents")
def stage_trace_cache_hit(spark, d):
    """I4: English documents are cache hits and jump from RCACHE to GENERATE."""
    s = RT.start(_trace_input(spark, d), K.SECURITY).withColumn("_hit", F.col("lang") == "en")
    stages = RT.all_trace_stages()
    stages[K.RCACHE] = RT.trace_cache_stage(lambda _t: F.col("_hit"))
    return RT.run_stages(s, stages, linked=False).select("doc_id", "text", "sentinel")


# ------------------------------------------------------------------------------ sources / sinks

@register("scan_articles_json", "SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.text, d.lang, d.source, "
          "CASE WHEN p.page_id IS NOT NULL THEN p.url END AS url FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def scan_articles_json(spark, d):
    """A1: articles written as JSON by Spark, then read with the article schema."""
    docs = TB.table(spark, d, "documents")
    pages = TB.table(spark, d, "pages")
    arts = docs.join(pages, docs.doc_id == pages.page_id, "left").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source", "url")
    path = shared_path(spark, "articles-json")
    arts.write.mode("overwrite").json(path)
    back = A.read_articles_json(spark, path, array_file=False)
    return back.select("doc_id", "text", "lang", "source", "url")


@register("collection_from_json", """WITH a AS (SELECT d.doc_id, d.text, d.lang, d.source, p.url FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, '0' || CAST(doc_id AS VARCHAR) AS doc_id, text, lang AS region, '{"name":"' || source || '"}' AS publisher, url,
       array_to_string(list_transform(string_split(lpad(CAST(doc_id AS VARCHAR), 6, '0'), ''), lambda x: CAST(CAST(x AS FLOAT) AS VARCHAR)), ',') AS vec FROM a""")
def collection_from_json(spark, d):
    """A1 + A2: all documents in files of one JSON array each, read in parallel with every key, numbered in the order of the files."""
    from ..sources import json_array as J
    docs, pages = TB.table(spark, d, "documents"), TB.table(spark, d, "pages")
    item = F.to_json(F.struct(F.concat(F.lit("0"), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.col("lang").alias("region"),
                              F.struct(F.col("source").alias("name")).alias("publisher"), "url", F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("code")))
    arts = docs.join(pages, docs.doc_id == pages.page_id, "left").select("doc_id", item.alias("item"))
    path = shared_path(spark, "article-arrays")
    J.write_json_arrays(arts.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)  # names of part files are in the order of the ranges
    arts = J.read_articles_array(spark, path).where("valid").withColumn("code", F.col("payload")["code"])
    coll = A.build_collection(arts, lambda t: TX.digit_encode(t, 6), text="code", order=["path", "block", "idx"])
    return coll.select("id", "doc_id", "text", F.col("payload")["region"].alias("region"), F.col("payload")["publisher"].alias("publisher"), "url",
                       F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("vec"))


@register("article_defaults", "SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(CASE WHEN p.page_id IS NOT NULL THEN "
          "nullif(regexp_extract(p.html, '(?s)<title>(.*?)</title>', 1), '') END, 'Title: ' || CAST(d.doc_id AS VARCHAR)) "
          "AS title, TRUE AS valid FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def article_defaults(spark, d):
    docs = TB.table(spark, d, "documents")
    pages = TB.table(spark, d, "pages").select("page_id", TB.page_title(F.col("html")).alias("title"))
    arts = docs.join(pages, docs.doc_id == pages.page_id, "left").select(
        F.col("doc_id").cast("string").alias("doc_id"), "title")
    return A.with_defaults(arts).select("doc_id", "title", "valid")


@register("trim_articles", "SELECT doc_id, n_chars FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 700) "
          "WHERE coalesce(length(text), 0) < 1000")
def trim_articles(spark, d):
    docs = TB.table(spark, d, "documents")
    return A.trim_articles(docs, "doc_id").select("doc_id", "n_chars")


@register("build_collection", "SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS doc_id, text, 64 AS dim FROM documents")
def build_collection(spark, d):
    """A2: hashed-bag-of-words vectors for every document, written (overwrite) and read back."""
    docs = TB.table(spark, d, "documents").select("doc_id", "text")
    coll = A.build_collection(docs, V.hash_encoder(64), spread=True)
    path = shared_path(spark, "collection")
    coll.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return back.select("id", "doc_id", "text", F.size("vector").alias("dim"))


@register("embed_hash")
def embed_hash(spark, d):
    """K2: the default encoder over the user turns of ``conversations`` (rows-only)."""
    q = TB.chat_questions(spark, d)
    enc = V.hash_encoder(64)
    return q.select("event_id", enc(F.col("user_query")).alias("qvec")) \
        .select("event_id", F.size("qvec").alias("dim"), F.round(V.norm(F.col("qvec")), 4).alias("norm"))


@register("embed_hash_entries", """WITH q AS (SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS event_id, text FROM conversations WHERE role = 'user'),
w AS (SELECT event_id, md5(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS h FROM q),
c AS (SELECT event_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS cell, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS s FROM w GROUP BY ALL),
n AS (SELECT event_id, sqrt(sum(s * s)) AS norm FROM c GROUP BY event_id)
SELECT event_id, CAST(cell AS INTEGER) AS cell, round(s / norm, 5) AS value FROM c JOIN n USING (event_id) WHERE s <> 0""")
def embed_hash_entries(spark, d):
    """K2: the entries of the default encoder's vectors that are not 0."""
    q = TB.chat_questions(spark, d)
    vec = q.select("event_id", V.hash_encoder(64)(F.col("user_query")).alias("qvec")).select("event_id", F.posexplode("qvec").alias("cell", "v"))
    return vec.where("v <> 0").select("event_id", "cell", F.round(F.col("v").cast("double"), 5).alias("value"))


@register("load_points", "SELECT e.vec_id AS id, e.label, d.lang, d.source, len(e.embedding) AS dim FROM embeddings e "
          "JOIN documents d ON d.doc_id = e.vec_id")
def load_points(spark, d):
    """A3: points (vector + payload) upserted by id; text dropped from the payload."""
    e = TB.table(spark, d, "embeddings")
    docs = TB.table(spark, d, "documents")
    pts = e.join(docs, e.vec_id == docs.doc_id).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", "lang", "source", "text",
        F.lit(0).alias("seq"))
    up = A.load_points(pts, "seq")
    return up.select("id", "label", "lang", "source", F.size("vector").alias("dim"))


_ARTICLES_SQL = ("WITH cur AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source AS created_by FROM documents), "
                 "lab AS (SELECT l.doc_id, l.quality, l.toxic, d.text, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id), "
                 "patch AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, '' AS text, 'moderation' AS created_by, 1 AS seq FROM lab WHERE toxic = 1 "
                 "UNION ALL SELECT CAST(doc_id AS VARCHAR), '[reviewed] ' || text, source, 2 FROM lab WHERE quality = 1 "
                 "UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), text, 'benchmark', 3 FROM benchmark), "
                 "last AS (SELECT * FROM patch QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1), "
                 "newv AS (SELECT * FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM last) "
                 "UNION ALL SELECT doc_id, text, created_by FROM last WHERE text IS NOT NULL AND text <> '')\n")


def _article_store(spark, d, name):
    store = A.ArticleStore(spark, shared_path(spark, name), buckets=16)
    store.append(A.articles_from_documents(TB.table(spark, d, "documents")))
    return store


def _patch(spark, d):
    return A.patch_from_labels(TB.table(spark, d, "documents"), TB.table(spark, d, "labels"), TB.table(spark, d, "benchmark"))


@register("patch_articles", _ARTICLES_SQL + "SELECT doc_id, text, created_by FROM newv")
def patch_articles(spark, d):
    """The patch as changes of a versioned store, merged on read."""
    store = _article_store(spark, d, "articles")
    store.apply(_patch(spark, d))
    return store.read().select("doc_id", "text", "created_by")


@register("compact_articles", _ARTICLES_SQL + """SELECT doc_id, text, created_by FROM newv WHERE NOT starts_with(doc_id, 'b')
UNION ALL SELECT doc_id, text || ' (again)', 'second' FROM newv WHERE starts_with(doc_id, 'b')""")
def compact_articles(spark, d):
    """Two patches, the second over the first (each new article is sent again), then compaction and removal of the old files."""
    store = _article_store(spark, d, "articles-compact")
    patch = _patch(spark, d)
    store.apply(patch)
    store.compact()
    again = patch.where(F.col("doc_id").startswith("b")).withColumn("text", F.concat("text", F.lit(" (again)"))).withColumn("created_by", F.lit("second"))
    store.apply(again)
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "text", "created_by")


@register("get_article", "SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.text, d.source AS created_by, "
          "CAST(NULL AS TIMESTAMP) AS created_date FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def get_article(spark, d):
    """Every labelled document fetched by id (a semi join, not a loop of lookups)."""
    cur = A.articles_from_documents(TB.table(spark, d, "documents"))
    ids = TB.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return A.get_articles(cur, ids)


_EVAL_SQL = (f"WITH rec AS (SELECT {_EVENT_ID_SQL} AS event_id, event_type, value, ts FROM events)\n")


def _eval_log(spark, d, name):
    log = EL.EvalLog(spark, shared_path(spark, name), buckets=2)
    log.append(EL.from_events(TB.table(spark, d, "events")))
    return log


def _metric():
    return TX.json_field(F.col("log"), "metric").alias("metric")


@register("eval_log_read", _EVAL_SQL + "SELECT event_id, event_type AS metric, value FROM rec")
def eval_log_read(spark, d):
    """Eval records (from ``events``) appended to the log and read back whole."""
    return _eval_log(spark, d, "evallog").read().select("event_id", _metric(), TX.json_field(F.col("log"), "value").cast("double").alias("value"))


@register("eval_log_delete", _EVAL_SQL + "SELECT event_id, event_type AS metric FROM rec WHERE event_type <> 'error'")
def eval_log_delete(spark, d):
    """A10: tombstones for every event of type ``error``, applied on read."""
    log = _eval_log(spark, d, "evallog-delete")
    log.delete(log.read().where(TX.json_field(F.col("log"), "metric") == "error"))
    return log.read().select("event_id", _metric())


@register("eval_log_lifecycle", _EVAL_SQL + """SELECT event_id, event_type AS metric, value FROM rec WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'late', value FROM rec WHERE event_type = 'error'""")
def eval_log_lifecycle(spark, d):
    """A batch is sent twice, deleted events are written again later, the log is compacted and the old files removed."""
    log = EL.EvalLog(spark, shared_path(spark, "evallog-life"), buckets=2)
    recs = EL.from_events(TB.table(spark, d, "events"))
    for _ in range(2):
        log.append(recs, batch="first")
    errors = recs.where(TX.json_field(F.col("log"), "metric") == "error")
    log.delete(errors)
    log.compact()
    log.append(errors.withColumn("log", F.to_json(F.struct(F.lit("late").alias("metric"), TX.json_field(F.col("log"), "value").cast("double").alias("value")))), batch="second")
    log.vacuum()
    return log.read().select("event_id", _metric(), TX.json_field(F.col("log"), "value").cast("double").alias("value"))


@register("eval_latest_of_day", _EVAL_SQL + "SELECT event_id, json_object('metric', event_type, 'value', value) AS log "
          "FROM rec WHERE event_id LIKE '%2024-01-01%' ORDER BY event_id DESC LIMIT 1")
def eval_latest_of_day(spark, d):
    name = "eval_records_view"
    _eval_log(spark, d, "evallog-day").of_day("2024-01-01").createOrReplaceTempView(name)
    return EL.latest_of_day(spark, name, "2024-01-01")


@register("eval_latest_by_ts", _EVAL_SQL + "SELECT event_id, event_type AS metric FROM rec "
          "WHERE CAST(ts AS DATE) = DATE '2024-01-01' ORDER BY ts DESC, event_id DESC LIMIT 1")
def eval_latest_by_ts(spark, d):
    recs = _eval_log(spark, d, "evallog-ts").of_day("2024-01-01")
    return EL.latest_by_ts(recs, "2024-01-01").select("event_id", _metric())


@register("validate_requests", "SELECT conv_id, turn, role = 'user' AS valid, CASE WHEN role = 'user' THEN text END AS user_query "
          "FROM conversations")
def validate_requests(spark, d):
    """Request JSON (user turns carry a string ``user_query``; other turns send a
    number) read with a schema; rows failing validation go to quarantine."""
    from ..sources.requests import validate_json_requests
    c = TB.table(spark, d, "conversations")
    body = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("user_query"))))\
        .otherwise(F.to_json(F.struct(F.col("turn").alias("user_query"))))
    lines = c.select("conv_id", "turn", body.alias("value"))
    v = validate_json_requests(lines)
    return v.select("conv_id", "turn", "valid", "user_query")


# ------------------------------------------------------------------------------ G2 and streams

def _digit_points(spark, d):
    docs = TB.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"),
                       TX.digit_encode(F.lpad(F.col("doc_id").cast("string"), 4, "0"), 4).alias("vector"),
                       F.col("doc_id").cast("string").alias("doc_id"), "text",
                       F.create_map().cast("map<string,string>").alias("payload"))


_DIGITS4 = ", ".join(f"CAST(substr({{x}}, {i}, 1) AS DOUBLE)" for i in range(1, 5))


@register("retrieve_error_fallback", f"""WITH pts AS (
  SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS sdoc, [{_DIGITS4.format(x="lpad(CAST(doc_id AS VARCHAR), 4, '0')")}] AS vec
  FROM documents),
req AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS uq
        FROM orders),
enc AS (SELECT event_id, CASE WHEN regexp_matches(substr(uq, 1, 4), '^[0-9]{{4}}$') THEN [{_DIGITS4.format(x="uq")}] END AS qv
        FROM req),
sc AS (SELECT e.event_id, p.id, p.sdoc, list_dot_product(e.qv, p.vec) AS score FROM enc e JOIN pts p ON e.qv IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, id ASC) AS rk FROM sc QUALIFY rk <= 2),
agg AS (SELECT event_id, string_agg(sdoc, ',' ORDER BY rk) AS ids FROM h GROUP BY event_id)
SELECT e.event_id, CASE WHEN e.qv IS NULL THEN '' ELSE coalesce(a.ids, '') END AS context_ids,
       CASE WHEN e.qv IS NULL THEN {O.lit(K.EMBED_ERROR_PREFIX + K.FALLBACK_TAIL)} END AS fallback,
       CASE WHEN e.qv IS NULL THEN {O.lit(K.EMBED_TIMEOUT_ERROR)} END AS error_type,
       CAST(CASE WHEN e.qv IS NULL THEN {K.GENERATE} END AS INTEGER) AS sentinel
FROM enc e LEFT JOIN agg a ON a.event_id = e.event_id""")
def retrieve_error_fallback(spark, d):
    """Order questions embedded by the digit encoder (4 leading digits); order keys
    below 1000 cannot be embedded -> "Sorry, something went wrong. " context, jump to GENERATE."""
    o = TB.table(spark, d, "orders")
    req = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("event_id"),
                   F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("user_query"))
    p = Pipeline(points=_digit_points(spark, d), encoder=lambda c: TX.digit_encode(c, 4), stages=["RETRIEVE"])
    s, _ = p.run(req)
    failed = F.exists("errors", lambda e: e["error_type"] == K.EMBED_TIMEOUT_ERROR)
    return s.select("event_id",
                    F.when(failed, F.lit("")).otherwise(F.array_join(F.transform("contexts", lambda c: c["doc_id"]), ","))
                    .alias("context_ids"),
                    F.when(failed, F.element_at("contexts", 1)["text"]).alias("fallback"),
                    F.when(failed, F.lit(K.EMBED_TIMEOUT_ERROR)).alias("error_type"), "sentinel")


@register("retrieve_bad_search_option", f"WITH {O.QUESTIONS.strip()}\n"
          f"SELECT event_id, {O.lit(K.OTHER_ERROR_PREFIX + K.FALLBACK_TAIL + chr(10))} AS context, "
          f"{O.lit(K.SEARCH_ARGUMENTS_ERROR)} AS error_types FROM questions")
def retrieve_bad_search_option(spark, d):
    """G2, other error: a search option the store does not take -> every question gets the
    "Sorry something went wrong. " context and goes on to the next stage (CONSOLIDATE formats it)."""
    cfg = PipelineConfig(retrieval=RetrievalConfig(search_params={"limit": 5}))
    p = Pipeline(points=_points(spark, d), config=cfg, filter_keys=["label"], stages=["RETRIEVE", "CONSOLIDATE"])
    s, _ = p.run(_questions(spark, d))
    return s.select("event_id", F.element_at("contexts", 1)["text"].alias("context"), _error_types().alias("error_types"))


@register("stream_answers", O.pipeline() + "\nSELECT event_id, generated_text FROM pipe")
def stream_answers(spark, d):
    """J1 + J2: questions arrive as JSON files; each micro-batch runs the pipeline and writes
    answers and eval records keyed by batch id; the answers equal the batch pipeline's."""
    from ..streaming.streams import answer_stream
    src = shared_path(spark, "requests-in")
    _questions(spark, d).repartition(4).write.json(src)
    out, ev, ck = shared_path(spark, "answers"), shared_path(spark, "stream-eval"), shared_path(spark, "stream-ck")
    q = answer_stream(spark, src, Pipeline(points=_points(spark, d), filter_keys=["label"]), out, ck, eval_path=ev)
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "generated_text")


@register("stream_eval_records", O.pipeline() + """,
emb AS (SELECT 'q' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS event_id, array_to_string(list_transform(embedding,
               lambda x: CAST(CAST(CAST(x AS DOUBLE) AS DECIMAL(18,6)) AS VARCHAR)), ',') AS v FROM embeddings)
SELECT p.event_id, m.metric, CASE m.metric WHEN 'cleaned_request' THEN cleaned_request WHEN 'user_query_embedding' THEN emb.v
       WHEN 'relevant_document_ids_scores' THEN relevant_document_ids_scores ELSE prompt END AS value
FROM pipe p JOIN emb ON emb.event_id = p.event_id, (VALUES ('cleaned_request'), ('user_query_embedding'), ('relevant_document_ids_scores'), ('prompt')) m(metric)""")
def stream_eval_records(spark, d):
    """The eval records of the answer stream; the stream runs twice from the start, its batches are written once."""
    from ..streaming.streams import answer_stream
    src = shared_path(spark, "records-in")
    _questions(spark, d).repartition(4).write.json(src)
    ev = shared_path(spark, "records-eval")
    p = Pipeline(points=_points(spark, d), filter_keys=["label"])
    for _ in range(2):
        answer_stream(spark, src, p, shared_path(spark, "records-out"), shared_path(spark, "records-ck"), eval_path=ev).awaitTermination()
    return EL.read(spark, ev).select("event_id", _metric(), TX.json_field(F.col("log"), "value").alias("value"))


_SENT_SQL = "TIMESTAMP '2024-05-01 08:00:00' + to_seconds(conv_id * 100 + turn)"


@register("stream_intake", "WITH req AS (SELECT conv_id, turn, role, text, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS event_id, "
          + _SENT_SQL + " AS ts FROM conversations)\n"
          f"SELECT {_EVENT_ID_SQL} AS event_id, role = 'user' AND text IS NOT NULL AS answered, CASE WHEN NOT (role = 'user' AND text IS NOT NULL) THEN "
          "CASE WHEN role = 'user' THEN 'user_query is required' ELSE 'user_query must be a string' END END AS reason, "
          "CASE WHEN role = 'user' AND text IS NOT NULL THEN CAST(ts AS DATE) END AS record_day FROM req")
def stream_intake(spark, d):
    """A13 + H11 + J1 + J2: all turns of ``conversations`` as request lines (turns that are not of the user send a number), each
    sent twice: answered once, the others are in the quarantine once, and the eval records have the time of their event id."""
    from ..streaming.streams import intake_stream
    c = TB.table(spark, d, "conversations")
    stamp = F.lit("2024-05-01 08:00:00").cast("timestamp_ntz") + F.make_interval(secs=(F.col("conv_id") * 100 + F.col("turn")).cast("double"))
    head = [F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("sent_at")]
    body = F.when(F.col("role") == "user", F.to_json(F.struct(*head, F.col("text").alias("user_query")))) \
        .otherwise(F.to_json(F.struct(*head, F.col("turn").alias("user_query"))))
    lines = c.select(body.alias("value"))
    src, out, bad = (shared_path(spark, x) for x in ("intake-in", "intake-out", "intake-bad"))
    ev = shared_path(spark, "intake-eval")
    p = Pipeline(points=_points(spark, d), encoder=V.hash_encoder(64))
    for _ in range(2):  # the second time, all lines are replays in new files
        lines.write.mode("append").text(src)
        intake_stream(spark, src, p, out, bad, src + "-checkpoint", eval_path=ev).awaitTermination()
    got = spark.read.parquet(out).select("event_id", F.lit(True).alias("answered"), F.lit(None).cast("string").alias("reason"))
    none = spark.read.parquet(bad).select("event_id", F.lit(False).alias("answered"), "reason")
    days = EL.read(spark, ev).where(_metric() == "prompt").select("event_id", F.to_date("ts").alias("record_day"))
    return got.unionByName(none).join(days, "event_id", "left")


@register("stream_patches", _ARTICLES_SQL + "SELECT doc_id, text, created_by FROM newv")
def stream_patches(spark, d):
    """The article patch feed as a stream into the store; the last version equals the batch patch result."""
    from ..streaming.streams import patch_stream
    store = _article_store(spark, d, "articles-stream")
    src = shared_path(spark, "patches-in")
    _patch(spark, d).withColumn("seq", F.col("seq").cast("long")).write.json(src)
    patch_stream(spark, src, store, shared_path(spark, "patch-ck")).awaitTermination()
    return store.read().select("doc_id", "text", "created_by")
