from datetime import datetime

from graphloom.operators.references import orphan_counts, orphan_references
from graphloom.plans.data_quality import REFERENCES, TARGETS

T = lambda d: datetime(2024, 1, d)
CH = "chunk_id string, source_document_id string, ingested_at timestamp, extra string"
RE = "relationship_id string, source_entity_id string, target_entity_id string, ingested_at timestamp"
EN = "entity_id string, source_chunk_ids array<string>, ingested_at timestamp"
SO = "id string, created_at timestamp"
DE = "record_kind string, record_id string, deleted_at timestamp"


def tables(spark, chunks=(), relationships=(), entities=(), documents=()):
    return {
        "chunks": spark.createDataFrame(list(chunks), CH),
        "relationships": spark.createDataFrame(list(relationships), RE),
        "entities": spark.createDataFrame(list(entities), EN),
        "source_documents": spark.createDataFrame(list(documents), SO),
    }


def test_orphans_skewed_deleted_and_dirty_keys(spark):
    hot = [(f"r{i}", "HOT ", "e1", T(2)) for i in range(50)]
    t = tables(
        spark,
        chunks=[("c1", " D1 ", T(3), "x"), ("c1", " D1 ", T(5), "x"), ("c2", None, T(1), None), ("c3", " ", T(1), None), ("c4", "gone", T(1), None), (None, "d9", T(1), None)],
        relationships=[*hot, ("q", "e1", "e1", T(2))],
        entities=[("E1", ["c1", None, "", "nope", "nope "], T(9)), ("e2", None, T(1))],
        documents=[("d1", T(1)), ("gone", T(1)), ("back", T(9))],
    )
    gone = spark.createDataFrame([("source_document", "GONE", T(4)), ("source_document", "back", T(4)), ("chunk", "unknown", T(1)), ("chunk", None, None)], DE)
    for share in (0.001, 0.9):
        got = {tuple(r) for r in orphan_references(t, REFERENCES, TARGETS, gone, share).collect()}
        want = {("relationships", f"r{i}", "source_entity_id", "hot", "2024-01") for i in range(50)}
        want |= {("chunks", "c4", "source_document_id", "gone", "2024-01"), ("chunks", None, "source_document_id", "d9", "2024-01"), ("entities", "E1", "source_chunk_ids", "nope", "2024-01")}
        assert got == want
    n = {(r.ref_table, r.ref_field): (r.orphan_refs, r.orphan_keys) for r in orphan_counts(t, REFERENCES, TARGETS, gone).collect()}
    assert n["relationships", "source_entity_id"] == (50, 1)


def test_orphans_of_empty_tables(spark):
    gone = spark.createDataFrame([], DE)
    assert orphan_references(tables(spark), REFERENCES, TARGETS, gone).count() == 0
