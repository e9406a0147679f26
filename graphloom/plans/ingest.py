"""From source documents to the tables of a store, resumable at every step.

A step works on what is missing, found by anti-joins between the tables, so
running it again changes nothing and a broken run is simply continued. What is
new is appended; only the entities, which new mentions change, are rewritten.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings
from graphloom.operators import bm25, communities, graph, lookup, vector_index
from graphloom.operators.chunking import chunk_documents
from graphloom.operators.entities import consolidate, merge_entities, resolve_endpoints
from graphloom.operators.extraction import embed_chunks, extract_rows, failed_documents, graph_rows, score_chunks
from graphloom.operators.pruning import prune
from graphloom.operators.quality import judge
from graphloom.session import cut, stage, staging
from graphloom.sources.providers import EmbeddingProvider, Extractor, TextProvider
from graphloom.sources.store import Store


@dataclass
class Stats:
    documents: int = 0
    chunks: int = 0
    rejected: int = 0
    entities: int = 0
    relationships: int = 0
    pruned: int = 0
    seconds: float = 0.0
    steps: list[str] = field(default_factory=list)


def _status(store: Store, was: str, now: str) -> None:
    store.set_status(store.statuses().where(F.col("pipeline_status") == was).select("id"), now)


def add_documents(store: Store, docs: DataFrame) -> int:
    """New documents are stored as pending; known ones (by id) are left alone.

    A document whose folder and file name are those of a known one, which is not
    among the documents given, is that one at a new place: its path is changed.
    """
    known = store.statuses()
    with staging():
        new = stage(docs.join(known.select("id"), "id", "left_anti"))
        tail = lookup.tail_of_path(F.col("source_path"))
        gone = known.join(docs.select("source_path"), "source_path", "left_anti").groupBy(tail.alias("tail")).agg(F.min("id").alias("was"))
        moved = stage(new.groupBy(tail.alias("tail")).agg(F.min_by("id", "source_path").alias("id"), F.min("source_path").alias("source_path")).join(gone, "tail"))
        if not moved.isEmpty():
            store.move_documents(moved.select(F.col("was").alias("id"), "source_path"))
        store.upsert_documents(new.join(moved.select("id"), "id", "left_anti").join(known.select("source_path"), "source_path", "left_anti"))
    return store.statuses().where("pipeline_status = 'pending'").count()


def chunk_step(store: Store, s: Settings = DEFAULTS) -> None:
    pending = store.read("source_documents").where("pipeline_status = 'pending'")
    judged = cut(judge(chunk_documents(pending, s), "text", s))
    store.upsert("chunks", judged.where("reason is null").drop("reason"))
    store.upsert("rejected_chunks", judged.where("reason is not null").select("chunk_id", "reason", "text", "metadata"))
    _status(store, "pending", "chunked")


def embed_step(store: Store, provider: EmbeddingProvider) -> None:
    missing = _unfinished(store).join(store.read("embeddings").select("chunk_id"), "chunk_id", "left_anti")
    store.upsert("embeddings", embed_chunks(missing, provider))
    _status(store, "chunked", "embedded")


def index_step(store: Store, stopwords: list[str] | None = None) -> None:
    """Postings of the chunks that have none; statistics are always derived from them."""
    missing = _unfinished(store).join(store.read("postings").select("chunk_id").distinct(), "chunk_id", "left_anti")
    new = bm25.postings(missing, "chunk_id", "text", stopwords).withColumnRenamed("id", "chunk_id")
    with staging():
        if not (new := stage(new)).isEmpty():
            store.append("postings", new)


def _unfinished(store: Store) -> DataFrame:
    """The chunks of documents that are not complete."""
    waiting = lookup.incomplete(store.statuses().withColumn("created_at", F.lit(None))).select(F.col("id").alias("source_document_id"))
    return store.read("chunks").join(waiting, "source_document_id", "left_semi")


def vector_step(store: Store, grown: float = 4.0) -> None:
    """Vectors that are in no leaf yet are put into one; the leaves are fitted anew when there are ``grown`` times as many vectors."""
    leaves, index = store.read("vector_leaves"), store.read("vector_index")
    vectors, placed, centroids = store.read("embeddings"), index.count(), leaves.count()
    total = vectors.count()
    if total and (not centroids or total > grown * max(placed, centroids**2)):
        store.write("vector_leaves", vector_index.fit_leaves(vectors))
        store.write("vector_index", vector_index.in_leaves(vectors, store.read("vector_leaves")))
    elif total > placed:
        with staging():
            missing = stage(vector_index.in_leaves(vectors.join(index.select("chunk_id"), "chunk_id", "left_anti"), leaves))
            if not missing.isEmpty():
                store.append("vector_index", missing)


def extract_step(store: Store, extractor: Extractor | None, s: Settings = DEFAULTS) -> None:
    """Entities and relationships of embedded documents.

    Without an extractor their status stays, as does that of a document with a
    chunk whose extraction failed: it is tried again by the next run, and what
    was found in it is kept by then, as ids follow from names.
    """
    if extractor is None:
        return
    with staging():
        _extract(store, extractor)


def _extract(store: Store, extractor: Extractor) -> None:
    waiting = stage(store.statuses().where("pipeline_status = 'embedded'").select(F.col("id").alias("source_document_id")))
    found = stage(extract_rows(store.read("chunks").join(waiting, "source_document_id", "left_semi"), extractor))
    mentions, rels = (stage(x) for x in graph_rows(found))
    batch = consolidate(mentions, "seen", F.lower("name"))
    store.write("entities", merge_entities(store.read("entities"), batch))
    store.upsert_relationships(resolve_endpoints(rels, mentions.select("entity_id", "name"), store.read("entities")))
    entities = store.read("entities")
    store.write("entities", graph.connected(entities, store.read("relationships")))
    done = stage(waiting.join(failed_documents(found), "source_document_id", "left_anti"))
    for status in ("extracted", "complete"):
        store.set_status(done, status, "source_document_id")


def prune_step(store: Store, scorer: TextProvider | None = None, s: Settings = DEFAULTS) -> int:
    """Noise out of the store; with a scorer by its judgement as well. Returns how many chunks went."""
    replies = None if scorer is None else score_chunks(store.read("chunks"), scorer)
    found = prune(store.read("chunks"), store.read("embeddings"), store.read("entities"), store.read("relationships"), replies, s)
    removed = cut(found.removed)
    kept = cut(found.entities)
    texts = store.read("chunks").join(removed.select(F.col("id").alias("chunk_id"), "reason"), "chunk_id")
    store.upsert("rejected_chunks", texts.select("chunk_id", "reason", "text", "metadata"))
    store.delete_chunks(removed.select("id"))
    store.write("entities", kept)
    return removed.count()


def community_step(store: Store, s: Settings = DEFAULTS, model: TextProvider | None = None, embedding: EmbeddingProvider | None = None) -> None:
    """Communities of the graph as it is now, summarised by the model if there is one; they replace the ones before."""
    with staging():
        found = communities.communities(graph.simple_graph(store.read("relationships")), s=s)
        prompts = communities.community_prompts(found, store.read("entities"))
        store.write("community_summaries", communities.model_summaries(prompts, model, embedding, s=s))


def run(store: Store, docs: DataFrame, provider: EmbeddingProvider, extractor: Extractor | None = None, pruning: bool = False, scorer: TextProvider | None = None, s: Settings = DEFAULTS, stopwords: list[str] | None = None) -> Stats:
    """All steps; a scorer implies pruning."""
    began, stats = time.time(), Stats()
    stats.documents = add_documents(store, docs)
    for name, step in (("chunk", lambda: chunk_step(store, s)), ("embed", lambda: embed_step(store, provider)), ("index", lambda: index_step(store, stopwords)), ("vectors", lambda: vector_step(store)), ("extract", lambda: extract_step(store, extractor, s))):
        step()
        stats.steps.append(name)
    if pruning or scorer is not None:
        stats.pruned = prune_step(store, scorer, s)
        stats.steps.append("prune")
    for name, table in (("chunks", "chunks"), ("rejected", "rejected_chunks"), ("entities", "entities"), ("relationships", "relationships")):
        setattr(stats, name, store.read(table).count())
    store.vacuum()
    stats.seconds = time.time() - began
    return stats
