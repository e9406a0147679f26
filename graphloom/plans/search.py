"""Searches over a store's tables, and their results in output form."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings
from graphloom.operators import blocks, bm25, fusion, graph, lookup
from graphloom.operators.vector_index import indexed_hits
from graphloom.operators.vectors import cosine
from graphloom.session import stage
from graphloom.sources.providers import EmbeddingProvider
from graphloom.sources.store import Store

log = logging.getLogger(__name__)

# Names of the search types, and of the modes of the tool.
CONNECTIONS, THEMATIC, KEYWORD = "find_connections", "explore_thematic", "keyword_search"
COMMUNITIES = "communities"
MODES = {"entity_connections": CONNECTIONS, "thematic_overview": THEMATIC, "keyword_lookup": KEYWORD, "connections": CONNECTIONS, "thematic": THEMATIC, "keyword": KEYWORD}

FEW_PAIRS = 1_000_000  # vectors compared by expressions; more are worth a shuffle


@dataclass
class Tables:
    chunks: DataFrame
    embeddings: DataFrame
    entities: DataFrame
    relationships: DataFrame
    community_summaries: DataFrame | None = None
    postings: DataFrame | None = None
    vector_leaves: DataFrame | None = None
    vector_index: DataFrame | None = None

    @classmethod
    def of(cls, store: Store) -> Tables:
        """The tables of a store, its indexes among them where they were made."""
        read = lambda t: store.read(t)
        made = lambda t: read(t) if store.has(t) else None
        return cls(*(read(t) for t in ("chunks", "embeddings", "entities", "relationships", "community_summaries")), *(made(t) for t in ("postings", "vector_leaves", "vector_index")))


@dataclass
class Result:
    """Lazy results; :meth:`to_dict` collects the few rows of one answer."""

    query: str
    search_type: str
    chunks: DataFrame
    entities: DataFrame | None = None
    direct: DataFrame | None = None
    extended: DataFrame | None = None
    metadata: dict[str, Any] = field(default_factory=dict)

    def to_dict(self, k: int = DEFAULTS.top_k, for_agent: bool = False) -> dict:
        """Limits: k entities, 3k direct edges (at most 30, 20 on the command line), some extended ones."""
        direct, extended = (min(3 * k, 30), max(k // 2, 5)) if for_agent else (min(3 * k, 20), max(k // 2, 2))
        rows = lambda df, n: [] if df is None else [r.asDict(True) for r in df.limit(n).collect()]
        chunks = [r.asDict(True) for r in self.chunks.orderBy("rank").limit(k).collect()]
        own, near, far = rows(self.entities, k), rows(self.direct, direct), rows(self.extended, extended)
        for c in chunks:
            c.pop("rank"), c.pop("query_id")
        if for_agent:
            for c in chunks:
                c.pop("chunkId")
            own = [{k_: e[k_] for k_ in ("name", "type")} for e in own]
            near, far = ([{k_: v for k_, v in r.items() if k_ not in ("id", "source", "target", "weight")} for r in x] for x in (near, far))
        return {
            "query": self.query, "searchType": self.search_type, "chunks": chunks, "entities": own, "relationships": near + far, "evidence": {"directRelationships": near, "extendedRelationships": far},
            "metadata": self.metadata | {"chunkCount": len(chunks), "entityCount": len(own), "relationshipCount": len(near) + len(far)}, "summary": None,
        }


class Engine:
    def __init__(self, tables: Tables, provider: EmbeddingProvider | None = None, settings: Settings = DEFAULTS, stopwords: list[str] | None = None, strict: bool = True):
        self.t, self.provider, self.s, self.stopwords, self.strict = tables, provider, settings, stopwords, strict

    def text_hits(self, queries: DataFrame, k: int) -> DataFrame:
        """From the stored postings where there are any, else from the texts."""
        if self.t.postings is None:
            return bm25.search(self.t.chunks, "chunk_id", "text", queries, "query_id", "text", k, self.s, self.stopwords)
        return bm25.search_stored(self.t.postings.withColumnRenamed("chunk_id", "id"), self.t.chunks, queries, "query_id", "text", k, self.s, self.stopwords)

    def vector_hits(self, queries: DataFrame, k: int) -> DataFrame:
        """From the nearest leaves of the stored index where there is one, else by a scan of all vectors."""
        if self.t.vector_index is None or self.t.vector_leaves is None:
            return vector_hits_all(self.t.embeddings, queries, k)
        return indexed_hits(self.t.vector_index, self.t.vector_leaves, queries, k)

    def hybrid(self, queries: DataFrame, k: int | None = None, alpha: float | None = None) -> DataFrame:
        """Fused hits of (query_id, text, vector) rows, three times k from each side; without a vector column by text alone.

        Unless the engine is ``strict``, a side that fails finds nothing and the other one answers.
        """
        k = k or self.s.top_k
        text_hits = self._leg(lambda: self.text_hits(queries, 3 * k))
        if "vector" not in queries.columns:
            return fusion.text_only(text_hits, k)
        return fusion.fuse(self._leg(lambda: self.vector_hits(queries, 3 * k)), text_hits, k, alpha, s=self.s)

    def _leg(self, find: Callable[[], DataFrame]) -> DataFrame:
        if self.strict:
            return find()
        try:
            return stage(find())
        except Exception as e:
            log.error("one side of the search failed: %s", e)
            return self.t.chunks.sparkSession.createDataFrame([], "query_id string, id string, score double")

    def _asked(self, query: str) -> DataFrame:
        spark = self.t.chunks.sparkSession
        if self.provider is None:
            return spark.createDataFrame([("q", query)], "query_id string, text string")
        try:
            vector = [float(x) for x in self.provider.embed([query])[0]]
        except Exception as e:
            if self.strict:
                raise
            log.error("the query was not embedded: %s", e)
            return spark.createDataFrame([("q", query)], "query_id string, text string")
        return spark.createDataFrame([("q", query, vector)], "query_id string, text string, vector array<float>")

    def keyword(self, query: str, k: int | None = None, alpha: float | None = None) -> Result:
        """Fused hits only."""
        hits = self.hybrid(self._asked(query), k, alpha)
        return Result(query, KEYWORD, lookup.chunk_records(lookup.enrich(hits, self.t.chunks)))

    def connections(self, query: str, k: int | None = None, alpha: float | None = None, label: str = CONNECTIONS) -> Result:
        """Hits without near-copies, the entities met in them, and their edges by closeness."""
        hits = stage(self.hybrid(self._asked(query), k, alpha))  # at most k rows, read by every part of the answer
        own, edges = graph.entity_context(hits, self.t.entities, self.t.relationships)
        kept = fusion.drop_near_copies(hits.join(self.t.embeddings.withColumnRenamed("chunk_id", "id"), "id", "left"), "embedding", s=self.s)
        flagged = lookup.relationship_records
        told = graph.evidence(kept, own, graph.with_names(edges, self.t.entities), self.s)
        chunks = lookup.chunk_records(lookup.enrich(kept.drop("embedding"), self.t.chunks))
        return Result(query, label, chunks, lookup.entity_records(own.orderBy("entity_id")), flagged(told.where("direct").orderBy("relationship_id")), flagged(told.where("not direct").orderBy("relationship_id")))

    def search(self, query: str, search_type: str = CONNECTIONS, k: int | None = None, alpha: float | None = None) -> Result:
        """By type or mode, whatever its case; unknown types search connections. Thematic searches do too, under their own label."""
        kind = MODES.get(search_type.lower(), search_type.lower())
        if kind == KEYWORD:
            return self.keyword(query, k, alpha)
        return self.connections(query, k, alpha, THEMATIC if kind == THEMATIC else CONNECTIONS)

    def thematic_communities(self, query: str, k: int | None = None) -> DataFrame:
        """Community summaries by their words, and by their vectors where they have some: (query_id, id, ..., rank)."""
        if self.t.community_summaries is None:
            raise ValueError("there are no community summaries")
        k, asked = k or self.s.top_k, self._asked(query)
        by_words = bm25.search(self.t.community_summaries, "community_id", "summary", asked, "query_id", "text", 3 * k, self.s, self.stopwords)
        if "vector" not in asked.columns:
            return fusion.text_only(by_words, k)
        vectors = self.t.community_summaries.select(F.col("community_id").alias("chunk_id"), F.col("summary_embedding").alias("embedding"))
        return fusion.fuse(vector_hits_all(vectors, asked, 3 * k), by_words, k, s=self.s)

    def overview(self, query: str, k: int | None = None) -> dict:
        """The communities that suit a query best, with their summaries."""
        found = self.thematic_communities(query, k).join(self.t.community_summaries.select(F.col("community_id").alias("id"), "level", "entity_ids", "summary"), "id")
        rows = found.orderBy("rank").select("id", "level", "summary", F.size("entity_ids").alias("entityCount"), F.round("fused_score", 4).alias("score")).collect()  # k rows
        return {"query": query, "searchType": COMMUNITIES, "communities": [r.asDict() for r in rows]}

    def explore(self, name: str, hops: int = 1) -> dict:
        """The neighbourhood of the entity of a name, as records."""
        start = stage(lookup.entity_by_name(self.t.entities, name))
        if start.isEmpty():
            return {"error": f"Entity '{name}' not found"}
        nodes, met = graph.neighbourhood(self.t.relationships, start, hops, self.s)
        own = lookup.entity_records(self.t.entities.join(nodes.select("entity_id"), "entity_id", "left_semi").orderBy("entity_id"))
        edges = lookup.relationship_records(graph.with_names(self.t.relationships.join(met.select("relationship_id").distinct(), "relationship_id", "left_semi"), self.t.entities).orderBy("relationship_id"))
        k = self.s.top_k
        return {"entity": name, "hops": min(hops, self.s.max_hops), "entities": [r.asDict(True) for r in own.limit(k).collect()], "relationships": [r.asDict(True) for r in edges.limit(min(3 * k, 30) + max(k // 2, 5)).collect()]}


def vector_hits(embeddings: DataFrame, queries: DataFrame, k: int, most_queries: int = 1000) -> DataFrame:
    """(query_id, id, score): the k nearest vectors of every query, by a scan of all vectors.

    The queries are broadcast; more than ``most_queries`` are refused here, as
    pairs would grow with both sides: :func:`vector_hits_all` takes any number.
    """
    asked = queries.select("query_id", "vector")
    if asked.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} vector queries at once; use vector_hits_all")
    pairs = embeddings.select(F.col("chunk_id").alias("id"), "embedding").join(F.broadcast(asked))
    scored = pairs.select("query_id", "id", cosine(F.col("embedding"), F.col("vector")).alias("score")).where("score is not null")
    return bm25.top_k(scored, k).drop("rank")


def vector_hits_all(embeddings: DataFrame, queries: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """:func:`vector_hits` for any number of queries: up to ``block`` by one scan if the pairs are few, else block against block."""
    asked = queries.select("query_id", "vector")
    n, records = asked.count(), embeddings.count()
    if n <= block and n * records <= FEW_PAIRS:
        return vector_hits(embeddings, asked, k, block)
    known = embeddings.select(F.col("chunk_id").alias("id"), "embedding")
    return bm25.top_k(blocks.exploded(blocks.vector_lists(known, asked, records, n, k)), k).drop("rank")
