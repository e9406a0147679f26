"""The queries p2_ with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.references import Reference, Target, orphan_counts, orphan_references
from graphloom.sources.tables import read_table

REFERENCES = [
    Reference("chunks", "chunk_id", "source_document_id", "ingested_at", "source_documents"),
    Reference("relationships", "relationship_id", "source_entity_id", "ingested_at", "entities"),
    Reference("relationships", "relationship_id", "target_entity_id", "ingested_at", "entities"),
    Reference("entities", "entity_id", "source_chunk_ids", "ingested_at", "chunks", is_array=True),
]
TARGETS = [
    Target("source_documents", "id", "created_at", "source_document"),
    Target("entities", "entity_id", "ingested_at", "entity"),
    Target("chunks", "chunk_id", "ingested_at", "chunk"),
]


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: read_table(spark, d, n) for n in ("chunks", "relationships", "entities", "source_documents")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_tables(spark, d), REFERENCES, TARGETS, read_table(spark, d, "deleted_records"))


def p2_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_tables(spark, d), REFERENCES, TARGETS, read_table(spark, d, "deleted_records"))


_TRIM = "lower(trim({0}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)))"


def _k(c: str) -> str:
    return _TRIM.format(c)


_ORPHANS = f"""
with gone as (select record_kind kind, {_k('record_id')} k, max(deleted_at) d from deleted_records group by 1, 2),
rows_ as (select 'source_document' kind, {_k('id')} k, created_at t from source_documents
  union all select 'entity', {_k('entity_id')}, ingested_at from entities
  union all select 'chunk', {_k('chunk_id')}, ingested_at from chunks),
living as (select r.kind, r.k from (select kind, k, max(t) t from rows_ where k <> '' group by 1, 2) r
  left join gone g on g.kind = r.kind and g.k = r.k where g.d is null or r.t > g.d),
refs as (
  select 'chunks' ref_table, chunk_id ref_id, 'source_document_id' ref_field, 'source_document' kind, {_k('source_document_id')} k, min(ingested_at) over (partition by chunk_id) t from chunks
  union all select 'relationships', relationship_id, 'source_entity_id', 'entity', {_k('source_entity_id')}, min(ingested_at) over (partition by relationship_id) from relationships
  union all select 'relationships', relationship_id, 'target_entity_id', 'entity', {_k('target_entity_id')}, min(ingested_at) over (partition by relationship_id) from relationships
  union all select 'entities', entity_id, 'source_chunk_ids', 'chunk', {_k('u.c')}, t from
    (select entity_id, source_chunk_ids, min(ingested_at) over (partition by entity_id) t from entities) e, unnest(e.source_chunk_ids) as u(c)),
lost as (select distinct ref_table, ref_id, ref_field, k missing_key, strftime(t, '%Y-%m') "period" from refs r
  where k <> '' and not exists (select 1 from living l where l.kind = r.kind and l.k = r.k))
"""

QUERIES = {"p2_found": p2_found, "p2_orphan_counts": p2_orphan_counts}

ORACLES = {
    "p2_found": _ORPHANS + "select * from lost",
    "p2_orphan_counts": _ORPHANS + 'select ref_table, ref_field, "period", count(*) orphan_refs, count(distinct missing_key) orphan_keys from lost group by 1, 2, 3',
}
