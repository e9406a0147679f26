"""Schemas of the stored tables."""

SOURCE_DOCUMENTS = "id string, source_path string, raw_content string, pipeline_status string, created_at timestamp"
CHUNKS = "chunk_id string, source_document_id string, text string, chunk_index int, metadata map<string,string>"
EMBEDDINGS = "chunk_id string, embedding array<float>"
ENTITIES = "entity_id string, name string, canonical_name string, entity_type string, description string, source_document_ids array<string>, source_chunk_ids array<string>"
RELATIONSHIPS = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, description string, weight float"
COMMUNITY_SUMMARIES = "community_id string, level int, entity_ids array<string>, summary string, summary_embedding array<float>"
POSTINGS = "chunk_id string, term string, tf int, length int"
# What changes of a document while it is processed; its content is not rewritten for that.
DOCUMENT_STATUS = "id string, pipeline_status string, source_path string"
VECTOR_LEAVES = "leaf int, centroid array<float>, probes int"
VECTOR_INDEX = "leaf int, chunk_id string, embedding array<float>"

TABLES = {
    "source_documents": SOURCE_DOCUMENTS,
    "chunks": CHUNKS,
    "embeddings": EMBEDDINGS,
    "entities": ENTITIES,
    "relationships": RELATIONSHIPS,
    "community_summaries": COMMUNITY_SUMMARIES,
    "postings": POSTINGS,
    "document_status": DOCUMENT_STATUS,
    "vector_leaves": VECTOR_LEAVES,
    "vector_index": VECTOR_INDEX,
    "rejected_chunks": "chunk_id string, reason string, text string, metadata map<string,string>",
}
# How the rows of a table lie in its files, for reading little of them.
SORTED = {"postings": "term", "vector_index": "leaf"}
KEYS = {"source_documents": "id", "document_status": "id", "chunks": "chunk_id", "embeddings": "chunk_id", "entities": "entity_id", "relationships": "relationship_id", "community_summaries": "community_id", "rejected_chunks": "chunk_id"}
