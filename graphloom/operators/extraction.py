"""Embeddings and entities of chunks, from providers, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.entities import match_mentions
from graphloom.sources.providers import EmbeddingProvider, Extractor, TextProvider


def embed_chunks(chunks: DataFrame, provider: EmbeddingProvider, id_col: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk_id, embedding) of the chunks with a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["id"], "embedding": provider.embed(b["text"].tolist())})

    return chunks.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null").mapInPandas(run, "chunk_id string, embedding array<float>")


def score_chunks(chunks: DataFrame, provider: TextProvider, prompt: str = "Rate the quality of this text from 0 to 1:\n\n") -> DataFrame:
    """(chunk_id, reply) of a text model asked for the quality; the reply is null where it failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "reply": [provider.complete(prompt + t)[0] for t in b["text"]]})

    return chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "chunk_id string, reply string")


def extract_rows(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """What the extractor found in each chunk, as rows of kind e (entity), r (relationship) or x (it failed; the description says why)."""
    schema = "chunk_id string, source_document_id string, kind string, position int, name string, type string, description string, target string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["chunk_id", "source_document_id", "kind", "position", "name", "type", "description", "target"]
        for b in batches:
            rows = []
            for c, d, found in zip(b["chunk_id"], b["source_document_id"], extractor.extract(b["text"].tolist())):
                rows += [(c, d, "e", i, e["name"], e["type"], e["description"], None) for i, e in enumerate(found["entities"])]
                rows += [(c, d, "r", i, r["source"], r["type"], r["description"], r["target"]) for i, r in enumerate(found["relationships"])]
                if found.get("error"):
                    rows.append((c, d, "x", 0, None, None, found["error"], None))
            yield pd.DataFrame(rows, columns=cols)

    return chunks.select("chunk_id", "source_document_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


def failed_documents(found: DataFrame) -> DataFrame:
    """(source_document_id, error) of the documents with a chunk whose extraction failed."""
    return found.where("kind = 'x'").groupBy("source_document_id").agg(F.min("description").alias("error"))


def extract_graph(chunks: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame]:
    """:func:`graph_rows` of the chunks."""
    return graph_rows(extract_rows(chunks, extractor))


def graph_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity mentions and relationships of extracted rows, with ids that follow from names.

    The ends of a relationship are matched to the entities of the same chunk.
    """
    mentions = found.where("kind = 'e'").select(
        F.sha2(F.concat_ws("\x01", "chunk_id", "name"), 256).alias("entity_id"), "name", F.col("name").alias("canonical_name"), F.col("type").alias("entity_type"), "description",
        F.array("source_document_id").alias("source_document_ids"), F.array("chunk_id").alias("source_chunk_ids"), "chunk_id", "position", F.concat_ws("#", "chunk_id", F.lpad(F.col("position").cast("string"), 6, "0")).alias("seen"),
    )
    raw = found.where("kind = 'r'")
    ends = raw.select("chunk_id", F.explode(F.array("name", "target")).alias("mention"))
    matched = match_mentions(ends, mentions.select("chunk_id", "entity_id", "name", "position"), "chunk_id")
    side = lambda m, e: matched.select("chunk_id", F.col("mention").alias(m), F.col("entity_id").alias(e))
    rels = raw.join(side("name", "source_entity_id"), ["chunk_id", "name"]).join(side("target", "target_entity_id"), ["chunk_id", "target"])
    return mentions, rels.select(
        F.sha2(F.concat_ws("\x01", "chunk_id", "kind", F.col("position").cast("string")), 256).alias("relationship_id"), "source_entity_id", "target_entity_id", F.col("type").alias("relationship_type"), "description", F.lit(1.0).cast("float").alias("weight")
    )
