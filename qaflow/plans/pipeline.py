"""The question -> answer pipeline as a fold of gated DataFrame stages.

SECURITY -> (RCACHE) -> (REWRITE) -> RETRIEVE -> (RERANK) -> CONSOLIDATE -> GENERATE -> (WCACHE)

Shuffles: the similarity top-k (none when the collection is broadcast), the hit
payload join and the per-event context aggregate, and the join of contexts back
to the requests. Consolidation and prompt building are row-local
(higher-order functions on the bounded ``contexts`` array).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..config import PipelineConfig
from ..functions.text import SecurityServiceError, char_tokens, prompt_too_long, redact
from ..operators import cache as C
from ..operators import consolidate as CO
from ..operators import filters as FL
from ..operators import generate as G
from ..operators import rerank as RR
from ..operators import retrieve as R
from ..session import materialised
from .routing import GATE, Stage, append_error, gated, next_or_end, run_stages, start

VECTORS_TYPE = "array<array<double>>"
STATE_METRICS = ["m_cleaned_request", "m_user_query_embedding", "m_relevant_document_ids_scores",
                 "m_prompt", "m_response_text", "m_response_token_count"]


def security_stage(redaction_map: dict | None, patterns: dict[str, str] | None = None) -> Stage:
    """H1-H3 + B9: redact the query; a missing map or token raises here, before any job runs."""
    if not redaction_map or "Financial information" not in redaction_map:
        raise SecurityServiceError("no redaction token for financial information: nothing is passed on")
    redact(F.lit(""), redaction_map, patterns)

    def apply(state: DataFrame, nxt):
        null_text = F.col("user_query").isNull()
        cleaned = redact(F.col("user_query"), redaction_map, patterns)
        state = gated(state, {
            "user_query": cleaned,
            "m_cleaned_request": cleaned,
            # rows without text never go onward (quarantined with an error)
            "errors": append_error(F.col("errors"), null_text, K.SECURITY, K.SECURITY_ERROR,
                                   "request has no text"),
        }, F.when(null_text, F.lit(None).cast("int")).otherwise(next_or_end(nxt)))
        return state

    return Stage(K.SECURITY, apply)


def rewrite_stage(rewriter=None) -> Stage:
    """K5: Column -> Column rewriter, identity by default; next stage via links (Q6 fix)."""

    def apply(state: DataFrame, nxt):
        new = {"user_query": rewriter(F.col("user_query"))} if rewriter is not None else {}
        return gated(state, new, next_or_end(nxt))

    return Stage(K.REWRITE, apply)


def encoded(state: DataFrame, encoder) -> DataFrame:
    """``qvec`` filled for gated rows that lack it; the encoder sees null for all other rows and skips them.

    The vectors are used by the search and by the join that brings its results back, so the rows are
    written once behind the encoder: it runs once for a row."""
    if encoder is None:
        return state
    wanting = F.when(F.col(GATE) & F.col("qvec").isNull(), F.col("user_query"))
    return materialised(state.withColumn("qvec", F.coalesce("qvec", encoder(wanting))), "encoded")


def retrieve_stage(points: DataFrame, cfg, encoder=None, filter_keys=None, with_vectors: bool = False) -> Stage:
    """C1/E1/B3-B8/G1/G2/D2/D3 on gated rows; ``with_vectors`` keeps the contexts' vectors for a reranker."""

    def apply(state: DataFrame, nxt):
        gate = F.col(GATE)
        state = encoded(state, encoder)
        has_vec = F.col("qvec").isNotNull()
        metadata = "metadata" if cfg.filter_on_user_metadata else None
        info: dict = {}
        try:
            FL.search_options(cfg.search_params)
            bad_args = None
        except FL.SearchArgumentsError as e:
            bad_args = str(e)
        if bad_args is None:
            state = state.withColumn(R.SEARCH_KEY, R.state_key(gate & has_vec, R.search_key("qvec", metadata)))
            questions = state.where(gate & has_vec).select(R.SEARCH_KEY, "qvec", "metadata")
            ctx = R.retrieve_contexts(
                questions, points, cfg.top_k, key=R.SEARCH_KEY, metadata=metadata, info=info,
                filter_keys=filter_keys, search_params=cfg.search_params,
                must=cfg.search_filters.get("must", ()), should=cfg.search_filters.get("should", ()),
                max_broadcast_bytes=cfg.max_broadcast_bytes, block_bytes=cfg.block_bytes, metric=cfg.metric,
                with_vectors=with_vectors)
            ctx = ctx.select(R.SEARCH_KEY, F.col("contexts").alias("_r_ctx"), F.col("hit_log").alias("_r_log"),
                             F.col("bad_title").alias("_r_bad"), *([F.col("vectors").alias("_r_vec")] if with_vectors else []))
            state = state.join(ctx, R.SEARCH_KEY, "left").drop(R.SEARCH_KEY)
        else:
            state = state.withColumn("_r_ctx", F.lit(None).cast(R.CONTEXTS_TYPE)) \
                .withColumn("_r_log", F.lit(None).cast("string")).withColumn("_r_bad", F.lit(None).cast("boolean")) \
                .withColumn("_r_vec", F.lit(None).cast(VECTORS_TYPE))
        embed_failed = ~has_vec
        bad_size = F.size("qvec") != info["dim"] if "dim" in info else F.lit(False)
        args_failed = (F.lit(bad_args is not None) | bad_size) & has_vec
        no_hits = has_vec & ~args_failed & F.col("_r_ctx").isNull()
        bad_title = has_vec & F.coalesce(F.col("_r_bad"), F.lit(False))
        errors = F.col("errors")
        errors = append_error(errors, embed_failed, K.RETRIEVE, K.EMBED_TIMEOUT_ERROR, "query could not be embedded")
        errors = append_error(errors, args_failed, K.RETRIEVE, K.SEARCH_ARGUMENTS_ERROR,
                              bad_args or "the vector's size is not the collection's")
        errors = append_error(errors, no_hits, K.RETRIEVE, K.NO_DOCUMENTS_ERROR, "No relevant documents found")
        errors = append_error(errors, bad_title, K.RETRIEVE, "KeyError", "'title'")
        contexts = (F.when(embed_failed, R.fallback_context(K.EMBED_ERROR_PREFIX))
                    .when(args_failed, R.fallback_context(K.OTHER_ERROR_PREFIX))
                    .when(no_hits, R.fallback_context(K.NO_DOCUMENTS_PREFIX))
                    .when(bad_title, R.fallback_context(K.OTHER_ERROR_PREFIX))
                    .otherwise(F.col("_r_ctx")))
        sentinel = F.when(embed_failed | no_hits, F.lit(K.GENERATE)).otherwise(next_or_end(nxt))
        state = gated(state, {
            "contexts": contexts,
            "errors": errors,
            "m_user_query_embedding": F.when(has_vec, R.embedding_log(F.col("qvec"))),
            "m_relevant_document_ids_scores": F.when(has_vec & ~args_failed, F.coalesce(F.col("_r_log"), F.lit(""))),
            **({"context_vectors": F.col("_r_vec")} if with_vectors else {}),
        }, sentinel)
        return state.drop("_r_ctx", "_r_log", "_r_bad", "_r_vec")

    return Stage(K.RETRIEVE, apply)


def rerank_stage(cfg, scorer=None, weights: list[float] | None = None) -> Stage:
    """K6: reorder contexts by a per-context score column function, or by a ranking SVM's weights on their vectors; identity without either."""

    def apply(state: DataFrame, nxt):
        new = {}
        if weights is not None:
            ranked = RR.rerank_by_weights(F.col("contexts"), F.col("context_vectors"), weights, cfg.top_k)
            new["contexts"] = F.when(F.size("contexts") == F.size("context_vectors"), ranked).otherwise(F.col("contexts"))
        elif scorer is not None or cfg.top_k is not None:
            new["contexts"] = RR.rerank_array(F.col("contexts"), scorer, cfg.top_k)
        return gated(state, new, next_or_end(nxt))

    return Stage(K.RERANK, apply)


def consolidate_stage(cfg, token_counter=char_tokens) -> Stage:
    def apply(state: DataFrame, nxt):
        res = CO.consolidate_array(F.col("contexts"), cfg.strategy, cfg.token_limit, token_counter)
        state = state.withColumn("_c", F.when(F.col(GATE), res))
        return gated(state, {
            "contexts": F.col("_c.contexts"),
            "errors": append_error(F.col("errors"), F.col("_c.error").isNotNull(), K.CONSOLIDATE,
                                   K.CONTEXT_WINDOW_ERROR, F.col("_c.error")),
        }, next_or_end(nxt)).drop("_c")

    return Stage(K.CONSOLIDATE, apply)


def generate_stage(cfg) -> Stage:
    def apply(state: DataFrame, nxt):
        gate = F.col(GATE)
        prompt = G.prompt_for(F.col("user_query"), F.col("contexts"), cfg.prompt_template, cfg.eos_token)
        state = state.withColumn("_prompt", F.when(gate, prompt))
        state = G.call_model(state, cfg.model, prompt_col="_prompt", out_col="_llm")
        ok = F.col("_llm.error_type").isNull()
        state = gated(state, {
            "m_prompt": F.col("_prompt"),
            "prompt_too_long": prompt_too_long(F.col("_prompt"), cfg.max_length),
            "response": F.when(ok, F.col("_llm.text")).otherwise(
                G.fallback_answer(F.col("contexts"), cfg.no_llm_fallback_strategy)),
            "token_count": F.col("_llm.token_count"),
            "m_response_text": F.when(ok, F.col("_llm.text")),
            "m_response_token_count": F.when(ok, F.col("_llm.token_count").cast("string")),
            "errors": append_error(F.col("errors"), ~ok, K.GENERATE, F.col("_llm.error_type"),
                                   F.col("_llm.error_message")),
        }, next_or_end(nxt))
        return state.drop("_prompt", "_llm")

    return Stage(K.GENERATE, apply)


def cache_read_stage(cache: DataFrame | None, cfg, encoder=None) -> Stage:
    """C4 on gated rows: a hit within tolerance brings cached contexts and jumps to GENERATE.

    The rows are written once before the lookup, which reads them several times, and once with its hits, which the
    stages behind it read several times: neither the requests nor the lookup are made anew for each."""

    def apply(state: DataFrame, nxt):
        if cache is None:
            return gated(state, {}, next_or_end(nxt))
        asks = F.col(GATE) & F.col("qvec").isNotNull()
        state = materialised(state, "asked") if encoder is None else encoded(state, encoder)
        state = state.withColumn(R.SEARCH_KEY, R.state_key(asks, R.search_key("qvec", None)))
        q = state.where(asks).select(R.SEARCH_KEY, "qvec").dropDuplicates([R.SEARCH_KEY])
        hits = C.cache_lookup(q, cache, cfg, key=R.SEARCH_KEY).select(R.SEARCH_KEY, F.col("contexts").alias("_k_ctx"))
        state = state.join(hits, R.SEARCH_KEY, "left").drop(R.SEARCH_KEY)
        hit = F.col("_k_ctx").isNotNull()
        state = gated(state, {"contexts": F.when(hit, F.col("_k_ctx")).otherwise(F.col("contexts")),
                              "cache_hit": hit},
                      F.when(hit, F.lit(K.GENERATE)).otherwise(next_or_end(nxt)))
        return materialised(state.drop("_k_ctx"), "looked_up")

    return Stage(K.RCACHE, apply)


def cache_write_stage() -> Stage:
    """Where answered rows are marked to be cached; :meth:`Pipeline.run` writes them once the answers are there."""

    def apply(state: DataFrame, nxt):
        return gated(state, {}, next_or_end(nxt))

    return Stage(K.WCACHE, apply)


@dataclass
class Pipeline:
    points: DataFrame
    config: PipelineConfig = field(default_factory=PipelineConfig)
    encoder: object | None = None
    filter_keys: list | None = None
    cache: DataFrame | None = None
    # read by RCACHE and written by WCACHE; what a run writes, the next one reads
    cache_store: C.CacheStore | None = None
    rewriter: object | None = None
    rerank_scorer: object | None = None
    # weights of operators.rerank.fit_ranking_svm, applied to the contexts' vectors by the RERANK stage
    rerank_weights: list[float] | None = None
    stages: list[str] | None = None  # names; default = the shipped four

    def build(self) -> list[Stage]:
        cfg = self.config
        names = self.stages or ["SECURITY", "RETRIEVE", "CONSOLIDATE", "GENERATE"]
        make = {
            "SECURITY": lambda: security_stage(cfg.redaction.redaction_map, cfg.redaction.patterns),
            "RCACHE": lambda: cache_read_stage(self.cache if self.cache_store is None else self.cache_store.read(), cfg.cache, self.encoder),
            "REWRITE": lambda: rewrite_stage(self.rewriter),
            "RETRIEVE": lambda: retrieve_stage(self.points, cfg.retrieval, self.encoder, self.filter_keys,
                                               self.rerank_weights is not None),
            "RERANK": lambda: rerank_stage(cfg.rerank, self.rerank_scorer, self.rerank_weights),
            "CONSOLIDATE": lambda: consolidate_stage(cfg.consolidate),
            "GENERATE": lambda: generate_stage(cfg.generate),
            "WCACHE": cache_write_stage,
        }
        return [make[n]() for n in names]

    def initial_state(self, requests: DataFrame, first_stage: int) -> DataFrame:
        s = requests
        base = {"metadata": F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
                if "metadata" in s.columns else F.create_map().cast("map<string,string>")}
        if "qvec" not in s.columns:
            base["qvec"] = F.lit(None).cast("array<float>")
        s = s.withColumns(base)
        s = start(s, first_stage)
        extra = {
            "contexts": F.lit(None).cast(R.CONTEXTS_TYPE), "response": F.lit(None).cast("string"),
            "token_count": F.lit(None).cast("int"), "prompt_too_long": F.lit(None).cast("boolean"),
            "cache_hit": F.lit(False),
        }
        if self.rerank_weights is not None:
            extra["context_vectors"] = F.lit(None).cast(VECTORS_TYPE)
        extra.update({m: F.lit(None).cast("string") for m in STATE_METRICS})
        return s.withColumns(extra)

    def run(self, requests: DataFrame, timed: bool = False, batch: str | None = None) -> tuple[DataFrame, dict]:
        """Returns the final state and per-stage wall seconds (``timed`` checkpoints each stage).

        With WCACHE and a ``cache_store`` the state is computed, and the answers that no error or hit stands behind are
        added to the cache: once for each ``batch``, so a replay writes nothing anew."""
        stages = self.build()
        state = self.initial_state(requests, stages[0].stage)
        seconds: dict[str, float] = {}
        clock = [time.time()]

        def after(st: Stage, df: DataFrame) -> DataFrame:
            if not timed:
                return df
            df = df.checkpoint(eager=True)  # reliable checkpoint in spark.checkpoint.dir
            now = time.time()
            seconds[st.name] = now - clock[0]
            clock[0] = now
            return df

        state = run_stages(state, stages, linked=True, after_stage=after)
        if self.cache_store is not None and any(st.stage == K.WCACHE for st in stages):
            state = materialised(state, "answered")
            self.cache_store.keep(C.cache_entries(state), self.config.cache.size, batch)
        return state, seconds


def answers(state: DataFrame) -> DataFrame:
    """The response projection."""
    return state.select("event_id", F.col("response").alias("generated_text"))


def metric_rows(state: DataFrame, seconds: dict | None = None) -> DataFrame:
    """Long eval records ``(event_id, metric, value)``; a metric not reached is not emitted."""
    seconds = seconds or {}

    def secs(stage_name: str, cond: Column) -> Column:
        v = seconds.get(stage_name)
        return F.when(cond, F.lit(None if v is None else f"{v:.6f}").cast("string"))

    has = F.col
    values = {
        "clean_sensitive_info_seconds": secs("SECURITY", has("m_cleaned_request").isNotNull()),
        "cleaned_request": has("m_cleaned_request"),
        "embed_seconds": secs("RETRIEVE", has("m_user_query_embedding").isNotNull()),
        "user_query_embedding": has("m_user_query_embedding"),
        "retrieve_seconds": secs("RETRIEVE", has("m_relevant_document_ids_scores").isNotNull()),
        "relevant_document_ids_scores": has("m_relevant_document_ids_scores"),
        "prompt": has("m_prompt"),
        "query_llm_seconds": secs("GENERATE", has("m_response_text").isNotNull()),
        "response_text": has("m_response_text"),
        "response_token_count": has("m_response_token_count"),
    }
    entries = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(n).alias("metric"), v.alias("value"))
                        for i, (n, v) in enumerate(values.items())])
    return state.select("event_id", F.inline(entries)).where(F.col("value").isNotNull())
