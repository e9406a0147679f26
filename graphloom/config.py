"""Settings with the engine's defaults; environment variables of the same name override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    embedding_batch_size: int = 32
    embedding_concurrency: int = 8
    llm_temperature: float = 0.1
    llm_max_tokens: int = 2048
    llm_chunks_per_batch: int = 4
    llm_concurrency: int = 8
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_length: int = 50
    bm25_language: str = "en"
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    top_k: int = 10
    fusion_alpha: float = 0.5
    rrf_k: int = 60
    dedup_threshold: float = 0.85
    dedup_enabled: bool = True
    direct_chunk_window: int = 3
    max_community_size: int = 50
    max_entities_per_chunk: int = 20
    max_relationships_per_chunk: int = 25
    max_repetition: float = 0.4
    min_entropy: float = 3.0
    max_entropy: float = 7.0
    max_malformed: float = 0.05
    max_whitespace: float = 0.30
    min_quality: float = 0.75
    outlier_threshold: float = 0.50
    min_chunks_for_outlier: int = 300
    max_hops: int = 3

    @classmethod
    def from_env(cls, prefix: str = "GRAPHLOOM_") -> Settings:
        """Defaults, overridden by variables such as GRAPHLOOM_TOP_K; unknown ones are ignored."""
        own = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                own[f.name] = raw.lower() in ("1", "true", "yes") if f.type == "bool" else {"int": int, "float": float, "str": str}[f.type](raw)
        return cls(**own)


DEFAULTS = Settings()

# Entity types, and their rank when mentions of one name disagree.
ENTITY_TYPES = ["PERSON", "ORGANIZATION", "CONCEPT", "LOCATION", "EVENT", "PRODUCT", "TECHNOLOGY"]
TYPE_PRIORITY = {"CONCEPT": 1, "TECHNOLOGY": 2, "ORGANIZATION": 3, "PRODUCT": 4, "LOCATION": 5, "EVENT": 6, "PERSON": 7}
OTHER_PRIORITY = 99

# The steps of a document through the pipeline.
STATUSES = ["pending", "chunked", "embedded", "extracted", "complete"]
