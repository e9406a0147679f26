"""Point lookups and projections to output records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_value(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def tail_of_path(path: Column, parts: int = 2) -> Column:
    """The last parts of a path, whatever its separators."""
    return F.substring_index(F.regexp_replace(path, "\\\\", "/"), "/", -parts)


def by_portable_path(docs: DataFrame, path: str) -> DataFrame:
    """The document with the same folder and file name; of several, the one with the least id."""
    wanted = "/".join(path.replace("\\", "/").split("/")[-2:])
    return docs.where(tail_of_path(F.col("source_path")) == wanted).orderBy("id").limit(1)


def incomplete(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("pipeline_status").eqNullSafe("complete")).orderBy("created_at", "id")


def with_status(docs: DataFrame, status: str) -> DataFrame:
    return docs.where(F.col("pipeline_status") == status)


def chunks_in_order(chunks: DataFrame, document: str | None = None) -> DataFrame:
    own = chunks if document is None else chunks.where(F.col("source_document_id") == document)
    return own.orderBy("source_document_id", "chunk_index", "chunk_id")


def entity_by_name(entities: DataFrame, name: str) -> DataFrame:
    """The entity of that name or cleaned name, whatever its case; of several, the least id."""
    n = F.lower(F.lit(name))
    return entities.where((F.lower("name") == n) | (F.lower("canonical_name") == n)).orderBy("entity_id").limit(1)


def entities_by_names(entities: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Entities whose name is in a list, whatever the case."""
    wanted = names.select(F.lower(column).alias("_n")).distinct()
    return entities.join(wanted, F.lower(entities["name"]) == F.col("_n"), "left_semi")


def names_by_ids(entities: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    return entities.join(ids.select(F.col(column).alias("entity_id")).distinct(), "entity_id", "left_semi").select("entity_id", "name", "entity_type")


def file_name(source: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(source, "\\\\", "/"), "([^/]+)/*$", 1)
    return F.when(name != "", name).otherwise("Unknown")


def enrich(hits: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", columns: tuple[str, ...] = ("text", "metadata")) -> DataFrame:
    """Hits with the columns of their chunks; joined after the cut to k, so only those rows are read out."""
    return hits.join(chunks.select(F.col(id_col).alias("id"), *columns), "id", "left")


def chunk_records(hits: DataFrame) -> DataFrame:
    """Output records of enriched hits."""
    source = F.coalesce(file_name(F.element_at("metadata", "source")), F.lit("Unknown"))
    rounded = [F.round(F.coalesce(c, F.lit(0.0)), 4).alias(n) for c, n in (("vector_score", "vectorScore"), ("bm25_score", "bm25Score"), ("fused_score", "fusedScore"))]
    return hits.select("query_id", F.col("id").alias("chunkId"), "text", source.alias("source"), *rounded, F.col("vector_rank").alias("vectorRank"), F.col("bm25_rank").alias("bm25Rank"), "rank")


def entity_records(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("entity_id").alias("id"), "name", F.col("entity_type").alias("type"), "description", F.col("source_chunk_ids").alias("sourceChunks"))


def relationship_records(rels: DataFrame) -> DataFrame:
    """Output records; names and types are there if the rows were enriched."""
    extra = [F.col(c).alias(n) for c, n in (("source_name", "sourceName"), ("source_type", "sourceType"), ("target_name", "targetName"), ("target_type", "targetType")) if c in rels.columns]
    return rels.select(F.col("relationship_id").alias("id"), F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target"), F.col("relationship_type").alias("type"), "description", "weight", *extra)
