"""The tool interface for agents: three functions, JSON in, compact JSON out."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from graphloom.functions.jsontools import compact
from graphloom.operators.stats import corpus_counts
from graphloom.plans.search import Engine
from graphloom.sources.store import Store


def tools(engine: Engine, store: Store | None = None) -> dict[str, Callable[..., str]]:
    def search(query: str, mode: str = "entity_connections", topK: int = 10) -> str:  # noqa: N803
        return compact(engine.search(query, mode, topK or 10).to_dict(topK or 10, for_agent=True))

    def explore_entity_graph(entityName: str, hops: int = 1) -> str:  # noqa: N803
        return compact(engine.explore(entityName, hops))

    def get_corpus_stats() -> str:
        t = engine.t
        known = {"chunks": t.chunks, "entities": t.entities, "relationships": t.relationships}
        if t.community_summaries is not None:
            known["community_summaries"] = t.community_summaries
        if store is not None:
            known["source_documents"] = store.read("source_documents")
        return compact(corpus_counts(known).first().asDict())

    return {"search": search, "explore_entity_graph": explore_entity_graph, "get_corpus_stats": get_corpus_stats}


def call(own: dict[str, Callable[..., str]], command: str) -> str:
    """Runs ``name({...json arguments...})``; what fails comes back as an error."""
    name, _, rest = command.partition("(")
    try:
        args: Any = json.loads(rest.rstrip().removesuffix(")") or "{}")
        return own[name.strip()](**args)
    except Exception as e:
        return compact({"error": f"{type(e).__name__}: {e}"})
