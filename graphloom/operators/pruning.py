"""Removing noise: outliers, low scores, and what is stranded afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings
from graphloom.operators.graph import stranded
from graphloom.operators.quality import quality_score
from graphloom.operators.vectors import outliers


@dataclass
class Pruned:
    chunks: DataFrame
    embeddings: DataFrame
    entities: DataFrame
    removed: DataFrame
    stranded: DataFrame


def low_scored(replies: DataFrame, id_col: str, reply: str, s: Settings = DEFAULTS) -> DataFrame:
    """(id, reason) of chunks whose scorer's reply is below the limit; no usable reply keeps the chunk."""
    scored = replies.select(F.col(id_col).alias("id"), quality_score(F.col(reply)).alias("q"))
    return scored.where(F.col("q") < s.min_quality).select("id", F.format_string("Quality too low: %.2f", "q").alias("reason"))


def prune(chunks: DataFrame, embeddings: DataFrame, entities: DataFrame, rels: DataFrame, replies: DataFrame | None = None, s: Settings = DEFAULTS) -> Pruned:
    """Chunks without noise, and entities without stranded ones.

    Low-scored chunks go first; outliers are sought among what remains, but the
    centroid covers all stored chunks of the document.
    """
    low = None if replies is None else low_scored(replies, "chunk_id", "reply", s)
    placed = chunks.join(embeddings, "chunk_id").select("chunk_id", "source_document_id", "embedding")
    far = outliers(placed, "source_document_id", "chunk_id", "embedding", s).select("id", F.format_string("Outlier: %.2f", "similarity").alias("reason"))
    removed = far if low is None else low.unionByName(far.join(low.select("id"), "id", "left_anti"))
    gone = removed.select(F.col("id").alias("chunk_id"))
    alone = stranded(entities, rels)
    return Pruned(chunks.join(gone, "chunk_id", "left_anti"), embeddings.join(gone, "chunk_id", "left_anti"), entities.join(alone.select("entity_id"), "entity_id", "left_anti"), removed, alone)
