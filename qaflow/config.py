"""Driver-side configuration, one dataclass per stage (defaults = shipped config)."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import constants as K


@dataclass(frozen=True)
class RedactionConfig:
    # kind of private information -> replacement token; None models a missing map
    redaction_map: dict | None = field(default_factory=lambda: dict(K.REDACTION_TOKENS))
    # further kinds: kind -> pattern that finds it; each needs a token in the map
    patterns: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 2
    filter_on_user_metadata: bool = True
    # extra search options: only "offset" and "score_threshold" are understood
    search_params: dict = field(default_factory=dict)
    # static filters applied to every question: {"must": [(key, value)], "should": [...]}
    search_filters: dict = field(default_factory=dict)
    # bytes of hits that are broadcast to fetch their texts
    max_broadcast_bytes: int = 64 << 20
    # bytes of vectors on either side of a cell of the similarity join
    block_bytes: int = 8 << 20
    metric: str = "dot"


@dataclass(frozen=True)
class ConsolidateConfig:
    strategy: str = "simple"  # simple | score_weighted | anything else = keep order
    token_limit: int = 1000


@dataclass(frozen=True)
class GenerateConfig:
    prompt_template: str = "basic"  # basic | anything else = "{user_query}{context}"
    eos_token: str = K.EOS_TOKEN
    max_length: int = 300
    no_llm_fallback_strategy: str = "references"  # references | documents
    # callable(pandas.Series[str]) -> (Series[str] text, Series[int] token_count); None = no model
    model: object | None = None


@dataclass(frozen=True)
class CacheConfig:
    metric: str = "cosine"
    # cosine-distance bound; the shipped 1000.0 would match every entry
    match_tolerance: float = 0.05
    size: int | None = None


@dataclass(frozen=True)
class RerankConfig:
    top_k: int | None = None


@dataclass(frozen=True)
class PipelineConfig:
    redaction: RedactionConfig = field(default_factory=RedactionConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    consolidate: ConsolidateConfig = field(default_factory=ConsolidateConfig)
    generate: GenerateConfig = field(default_factory=GenerateConfig)
    cache: CacheConfig = field(default_factory=CacheConfig)
    rerank: RerankConfig = field(default_factory=RerankConfig)
