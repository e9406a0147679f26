"""Queries of the engine's own operators over the test tables, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, TYPE_PRIORITY
from graphloom.functions.text import STOPWORDS, header_sections, normalize_text, tokenize
from graphloom.operators import bm25, communities, entities, fusion, graph, lookup, quality, vectors
from graphloom.operators.chunking import chunk_documents
from graphloom.operators.stats import corpus_counts, table_counts
from graphloom.plans.search import Engine, Tables, vector_hits_all
from graphloom.session import cut, ensure_checkpoint_dir, stage, staging
from graphloom.sources.store import Store, merged
from graphloom.sources.tables import read_table

RELATION = ["source_entity_id", "target_entity_id", "relationship_type", "description", "weight"]


def _once(spark: SparkSession, d: str, name: str, key: str, time: str = "ingested_at", columns: list[str] | None = None) -> DataFrame:
    """The latest row of every key that is not null; of its columns only those named, if any are."""
    df = read_table(spark, d, name).where(F.col(key).isNotNull())
    row = F.struct(*[c for c in df.columns if c != key and (columns is None or c in columns)])
    return df.groupBy(key).agg(F.max_by(row, time).alias("_r")).select(key, "_r.*")


# ------------------------------------------------------------ text


def tokenize_terms(spark, d):
    return bm25.postings(read_table(spark, d, "documents", spread=True), "doc_id", "text").select(F.col("id").alias("doc_id"), "term", "tf", "length")


def bm25_doc_freq(spark, d):
    return bm25.doc_frequency(bm25.postings(read_table(spark, d, "documents", spread=True), "doc_id", "text"))


def bm25_corpus_stats(spark, d):
    return bm25.corpus_stats(read_table(spark, d, "documents", spread=True), "text").select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark, d):
    found = bm25.search(read_table(spark, d, "documents", spread=True), "doc_id", "text", read_table(spark, d, "search_queries"), "query_id", "query_text", 10)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_match_counts(spark, d):
    docs, q = read_table(spark, d, "documents", spread=True), read_table(spark, d, "search_queries")
    return bm25.match_counts(docs, "doc_id", "text", q, "query_id", "query_text").select("query_id", "hits", F.round("best", 6).alias("best"))


def quality_metrics(spark, d):
    m = quality.quality_metrics(read_table(spark, d, "documents", spread=True), "text")
    return m.select("doc_id", *[F.round(c, 6).alias(c) for c in ("repetition", "entropy", "malformed", "whitespace")])


def quality_verdict(spark, d):
    return quality.judge(read_table(spark, d, "documents", spread=True), "text").select("doc_id", "reason")


def normalized_texts(spark, d):
    return read_table(spark, d, "chunks").select("chunk_id", normalize_text(F.col("text")).alias("text")).distinct()


def header_section_counts(spark, d):
    docs = read_table(spark, d, "source_documents")
    parts = docs.select("id", F.posexplode(header_sections(F.col("raw_content"))).alias("section", "body"))
    return parts.select("id", "section", F.md5("body").alias("body_md5")).distinct()


def chunked_documents(spark, d):
    return chunk_documents(read_table(spark, d, "source_documents", spread=True)).drop("metadata").distinct()


def chunked_texts(spark, d):
    docs = read_table(spark, d, "documents", spread=True).select(F.col("doc_id").cast("string").alias("id"), "source_path", F.col("text").alias("raw_content"))
    return chunk_documents(docs).drop("metadata")


# ------------------------------------------------------------ vectors


def _query_vector(spark, d) -> list[float]:
    return read_table(spark, d, "embeddings").where("vec_id = 0").first().embedding


def vector_topk(spark, d):
    near = vectors.nearest(read_table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 10)
    return near.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def label_centroids(spark, d):
    c = vectors.centroids(read_table(spark, d, "embeddings"), ["label"], "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def embedding_outliers(spark, d):
    s = replace(DEFAULTS, min_chunks_for_outlier=2, outlier_threshold=0.1)
    far = vectors.outliers(read_table(spark, d, "embeddings"), "label", "vec_id", "embedding", s)
    return far.select("label", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def corpus_outliers(spark, d):
    s = replace(DEFAULTS, outlier_threshold=0.1)
    return vectors.corpus_outliers(read_table(spark, d, "embeddings"), "vec_id", "embedding", s).select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def near_copies_dropped(spark, d):
    e = read_table(spark, d, "embeddings")
    near = vectors.nearest(e, "vec_id", "embedding", _query_vector(spark, d), 10)
    ranked = near.withColumns({"query_id": F.lit("q"), "rank": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("similarity"), "id"))})
    hits = ranked.join(e.select(F.col("vec_id").alias("id"), "embedding"), "id")
    return fusion.drop_near_copies(hits, "embedding", 0.3).select(F.col("id").alias("vec_id"), "rank")


def _near_all(spark, d):
    """The ten vectors nearest to each whose id is divisible by 50."""
    e = read_table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_hits_all(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), q, 10)


def vector_topk_all(spark, d):
    return _near_all(spark, d).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("similarity"))


def near_copies_dropped_all(spark, d):
    e = read_table(spark, d, "embeddings")
    hits = bm25.top_k(_near_all(spark, d), 10).join(e.select(F.col("vec_id").alias("id"), "embedding"), "id")
    return fusion.drop_near_copies(hits, "embedding", 0.3).select("query_id", F.col("id").alias("vec_id"), "rank")


# ------------------------------------------------------------ fusion


def _hit_lists(spark, d):
    rows = read_table(spark, d, "retrieval_results").groupBy("query_id", F.col("chunk_id").alias("id")).agg(*[F.max(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("vector_score", "bm25_score")])
    return tuple(rows.where(F.col(c).isNotNull()).select("query_id", "id", F.col(c).alias("score")) for c in ("vector_score", "bm25_score"))


def _fused(use_alpha: bool, use_rrf: bool):
    def query(spark, d):
        v, t = _hit_lists(spark, d)
        f = fusion.fuse(v, t, 10, use_alpha=use_alpha, use_rrf=use_rrf)
        return f.select("query_id", F.col("id").alias("chunk_id"), "vector_rank", "bm25_rank", F.round("fused_score", 6).alias("fused_score"), "rank")

    return query


def _summaries(spark, d):
    rows = _once(spark, d, "community_summaries", "community_id")
    return rows.select(F.col("community_id").alias("query_id"), F.col("summary").alias("text"), F.col("summary_embedding").alias("vector"))


def _engine(spark, d, stored: bool) -> Engine:
    """The engine over the test tables, with stored postings or without."""
    texts, vectors_ = (_once(spark, d, "chunks", "chunk_id", columns=[c]) for c in ("text", "embedding"))
    t = Tables(texts, vectors_, _once(spark, d, "entities", "entity_id"), _relations(spark, d))
    if stored:
        t.postings = stage(bm25.postings(t.chunks, "chunk_id", "text").withColumnRenamed("id", "chunk_id"))
    return Engine(t)


def hybrid_search_all(spark, d):
    """Both sides of the search, fused: for every community summary the chunks that suit its words and its vector."""
    hits = _engine(spark, d, False).hybrid(_summaries(spark, d), 10)
    return hits.select("query_id", F.col("id").alias("chunk_id"), "vector_rank", "bm25_rank", F.round("fused_score", 6).alias("fused_score"), "rank")


def stored_postings_search(spark, d):
    """Three times top_k chunks for every search query, from postings."""
    queries = read_table(spark, d, "search_queries").select("query_id", F.col("query_text").alias("text"))
    return _engine(spark, d, True).text_hits(queries, 3 * DEFAULTS.top_k).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


def text_only_ranking(spark, d):
    return fusion.text_only(_hit_lists(spark, d)[1], 5).select("query_id", F.col("id").alias("chunk_id"), F.round("fused_score", 6).alias("fused_score"), "bm25_rank")


def vector_search_all(spark, d):
    """The nearest chunks of the first chunks' vectors: several vector queries in one scan."""
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    q = read_table(spark, d, "embeddings").where("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_hits_all(e, q, 3).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("similarity"))


# ------------------------------------------------------------ lookups


def documents_incomplete(spark, d):
    return lookup.incomplete(_once(spark, d, "source_documents", "id", "created_at")).select("id", "source_path", "pipeline_status")


def documents_by_status(spark, d):
    return lookup.with_status(_once(spark, d, "source_documents", "id", "created_at"), "complete").select("id")


def documents_by_portable_path(spark, d):
    docs = _once(spark, d, "source_documents", "id", "created_at")
    tails = docs.groupBy(lookup.tail_of_path(F.col("source_path")).alias("tail")).agg(F.min("id").alias("id"), F.count("*").alias("documents"))
    return tails.where("tail is not null")


def chunk_outputs(spark, d):
    hits = read_table(spark, d, "retrieval_results").withColumnRenamed("chunk_id", "id").withColumn("rank", F.lit(1))
    out = lookup.chunk_records(hits.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("vector_score", "bm25_score", "fused_score")}))
    return out.select("query_id", "chunkId", "source", "vectorScore", "bm25Score", "fusedScore", "vectorRank", "bm25Rank").distinct()


def chunks_of_documents(spark, d):
    c = _once(spark, d, "chunks", "chunk_id")
    return lookup.chunks_in_order(c).groupBy("source_document_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"))


def entities_by_search_names(spark, d):
    names = _once(spark, d, "entities", "entity_id").select(F.upper("canonical_name").alias("name"))
    return lookup.entities_by_names(_once(spark, d, "entities", "entity_id"), names).select("entity_id", "name")


def names_of_sources(spark, d):
    ids = read_table(spark, d, "relationships").select(F.col("source_entity_id").alias("entity_id"))
    return lookup.names_by_ids(_once(spark, d, "entities", "entity_id"), ids)


# ------------------------------------------------------------ entities and graph


def entity_merge(spark, d):
    e = _once(spark, d, "entities", "entity_id").withColumn("seen", F.concat_ws("|", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "entity_id"))
    m = entities.consolidate(e.where("name is not null"), "seen", F.lower(F.trim("name")))
    joined = lambda c: F.array_join(F.array_sort(F.array_compact(c)), ",").alias(c)
    return m.select("entity_id", "entity_type", F.coalesce("description", F.lit("")).alias("description"), joined("source_document_ids"), joined("source_chunk_ids"))


def entity_upsert(spark, d):
    """Entities of one half merged into those of the other half."""
    e = _once(spark, d, "entities", "entity_id").where("name is not null")
    seen = e.withColumn("seen", F.col("entity_id"))
    halves = [entities.consolidate(seen.where(c), "seen", F.lower("name")) for c in ("entity_type = 'PERSON' or entity_type is null", "entity_type <> 'PERSON'")]
    m = entities.merge_entities(*halves)
    return m.select("entity_id", "name", "entity_type")


def stranded_entities(spark, d):
    return graph.stranded(_once(spark, d, "entities", "entity_id"), read_table(spark, d, "relationships")).select("entity_id")


RELATION_TYPES = ("RELATED_TO", "SUPPLIES", "MEMBER_OF", "LOCATED_IN", "CITES", "PART_OF", "USES", "OWNS")


def stranded_by_type(spark, d):
    """For each type of relationship the entities that none of that type names."""
    e, r = _once(spark, d, "entities", "entity_id"), read_table(spark, d, "relationships")
    out = None
    for t in RELATION_TYPES:
        own = graph.stranded(e, r.where(F.col("relationship_type") == t)).select(F.lit(t).alias("relationship_type"), "entity_id")
        out = own if out is None else out.unionByName(own)
    return out


def connected_entities(spark, d):
    return graph.connected(_once(spark, d, "entities", "entity_id"), read_table(spark, d, "relationships")).select("entity_id")


def _relations(spark, d):
    return _once(spark, d, "relationships", "relationship_id")


def relationship_enrich(spark, d):
    return graph.with_names(_relations(spark, d), _once(spark, d, "entities", "entity_id")).select("relationship_id", "source_name", "source_type", "target_name", "target_type")


def simple_graph(spark, d):
    return graph.simple_graph(_relations(spark, d)).select("a", "b", F.round("weight", 6).alias("weight"))


def _start(spark, d):
    """The known entity with the least id that is the source of an edge."""
    known = _once(spark, d, "entities", "entity_id").select("entity_id")
    return known.join(_relations(spark, d).select(F.col("source_entity_id").alias("entity_id")), "entity_id", "left_semi").orderBy("entity_id").limit(1)


def entity_neighborhood_2hop(spark, d):
    return graph.neighbourhood(_relations(spark, d), _start(spark, d), 2)[0]


def neighborhood_edges_2hop(spark, d):
    return graph.neighbourhood(_relations(spark, d), _start(spark, d), 2)[1].groupBy("relationship_id", "hop").agg(F.count("*").alias("times"))


def incident_relationships(spark, d):
    few = _once(spark, d, "entities", "entity_id").where("entity_type = 'LOCATION'")
    return graph.incident(_relations(spark, d), few).select("relationship_id")


def _ten_hits(rows: DataFrame) -> DataFrame:
    scored = rows.groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.max(F.coalesce(F.when(~F.isnan("fused_score"), F.col("fused_score")), F.lit(0.0))).alias("score"))
    return bm25.top_k(scored, 10)


def _first_hits(spark, d):
    rows = read_table(spark, d, "retrieval_results")
    return _ten_hits(rows.join(rows.agg(F.min("query_id").alias("query_id")), "query_id", "left_semi"))


def _all_hits(spark, d):
    return _ten_hits(read_table(spark, d, "retrieval_results").where("query_id is not null"))


def entity_context(spark, d):
    own, edges = graph.entity_context(_first_hits(spark, d), _once(spark, d, "entities", "entity_id"), _relations(spark, d))
    return own.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id")).unionByName(edges.select(F.lit("relationship").alias("kind"), F.col("relationship_id").alias("id")))


def evidence_split(spark, d):
    hits = _first_hits(spark, d)
    own, edges = graph.entity_context(hits, _once(spark, d, "entities", "entity_id"), _relations(spark, d))
    return graph.evidence(hits, own, edges).select("relationship_id", "direct")


def entity_context_all(spark, d):
    """The context of every query's hits."""
    own, edges = graph.entity_context(_all_hits(spark, d), _once(spark, d, "entities", "entity_id"), _relations(spark, d))
    return own.select("query_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("id")).unionByName(edges.select("query_id", F.lit("relationship").alias("kind"), F.col("relationship_id").alias("id")))


def evidence_split_all(spark, d):
    """The evidence of every query's hits."""
    hits = _all_hits(spark, d)
    own, edges = graph.entity_context(hits, _once(spark, d, "entities", "entity_id"), _relations(spark, d))
    return graph.evidence(hits, own, edges).select("query_id", "relationship_id", "direct")


def resolve_relationship_ids(spark, d):
    e = _once(spark, d, "entities", "entity_id").where("name is not null")
    stored = e.groupBy(F.lower("name").alias("name")).agg(F.max("entity_id").alias("entity_id"))
    out = entities.resolve_endpoints(_relations(spark, d), e.select("entity_id", "name"), stored)
    return out.select("relationship_id", "source_entity_id", "target_entity_id")


def mention_matches(spark, d):
    """Cleaned names matched to the entities of the same first source document."""
    e = _once(spark, d, "entities", "entity_id").where("name is not null").withColumn("grp", F.get(F.filter("source_document_ids", lambda x: F.length(x) > 0), 0)).where("grp is not null")
    named = e.select("grp", "entity_id", "name", F.col("entity_id").alias("position"))
    asked = e.where("canonical_name is not null").select("grp", F.substring_index("canonical_name", " ", 2).alias("mention"))
    return entities.match_mentions(asked, named, "grp").select("grp", "mention", "entity_id")


def label_propagation_2(spark, d):
    return communities.label_propagation(graph.simple_graph(_relations(spark, d)), 2)


def community_levels(spark, d):
    return communities.communities(graph.simple_graph(_relations(spark, d)))


def community_summaries_made(spark, d):
    found = communities.communities(graph.simple_graph(_relations(spark, d)))
    return communities.extractive_summaries(communities.community_prompts(found, _once(spark, d, "entities", "entity_id"))).drop("summary_embedding")


# ------------------------------------------------------------ counts and storage


def corpus_stats(spark, d):
    return corpus_counts({n: read_table(spark, d, n) for n in ("source_documents", "chunks", "entities", "relationships", "community_summaries")})


def table_stats(spark, d):
    return table_counts({n: read_table(spark, d, n) for n in ("chunks", "entities", "relationships", "documents", "retrieval_results", "deleted_records")})


def upsert_idempotent(spark, d):
    new = _once(spark, d, "source_documents", "id", "created_at")
    once = merged(new.limit(0), new, "id")
    twice = merged(once, new, "id", ("pipeline_status", "created_at"))
    return twice.select("id", "source_path", "pipeline_status", F.md5("raw_content").alias("content_md5"))


def stored_lifecycle(spark, d):
    """Documents through a store: added, some moved, some deleted, the status set for the rest."""
    docs = _once(spark, d, "source_documents", "id", "created_at")
    home = ensure_checkpoint_dir(spark)
    store = Store(spark, f"{home}/store-{uuid.uuid4().hex}")
    gone = read_table(spark, d, "deleted_records").where("record_kind = 'source_document'").select(F.col("record_id").alias("id")).distinct()
    try:
        with staging():
            store.upsert_documents(docs)
            store.move_documents(docs.where("pipeline_status is null and source_path is not null").select("id", F.concat(F.lit("/moved"), "source_path").alias("source_path")))
            store.set_status(docs.where("pipeline_status = 'pending'").select("id"), "chunked")
            store.delete("source_documents", gone)
            store.upsert_documents(docs.where("pipeline_status = 'complete'").withColumn("raw_content", F.lit("new")))
            out = store.read("source_documents").select("id", "source_path", "pipeline_status", F.md5("raw_content").alias("content_md5"))
            return cut(out)
    finally:
        store.reset()


def documents_without_chunks(spark, d):
    docs = _once(spark, d, "source_documents", "id", "created_at")
    return docs.join(read_table(spark, d, "chunks").select(F.col("source_document_id").alias("id")).distinct(), "id", "left_anti").select("id")


def token_arrays(spark, d):
    return read_table(spark, d, "eval_items").select("item_id", tokenize(F.col("text")).alias("tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, bm25_doc_freq, bm25_corpus_stats, bm25_topk, bm25_match_counts, quality_metrics, quality_verdict, normalized_texts, header_section_counts, chunked_documents, chunked_texts, token_arrays,
        vector_topk, vector_topk_all, vector_search_all, label_centroids, embedding_outliers, corpus_outliers, near_copies_dropped, near_copies_dropped_all, text_only_ranking, hybrid_search_all, stored_postings_search,
        documents_incomplete, documents_by_status, documents_by_portable_path, documents_without_chunks, chunk_outputs, chunks_of_documents, entities_by_search_names, names_of_sources,
        entity_merge, entity_upsert, stranded_entities, stranded_by_type, connected_entities, relationship_enrich, simple_graph, entity_neighborhood_2hop, neighborhood_edges_2hop, incident_relationships, entity_context, entity_context_all, evidence_split, evidence_split_all, resolve_relationship_ids, mention_matches,
        label_propagation_2, community_levels, community_summaries_made, corpus_stats, table_stats, upsert_idempotent, stored_lifecycle,
    )
} | {"hybrid_fusion_topk": _fused(True, True), "fusion_alpha_only": _fused(True, False), "fusion_rrf_only": _fused(False, True)}

# ------------------------------------------------------------ SQL

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_CJK = "一-鿿぀-ヿ가-힯"


def _tok(text: str) -> str:
    return f"coalesce(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+|[{_CJK}]'), lambda x: (length(x) > 1 or regexp_matches(x, '[{_CJK}]')) and x not in ({_STOP})), [])"


_DOCS = f"""
t as (select doc_id, {_tok('text')} t from documents),
p as (select doc_id, term, count(*)::int tf, length::int length from (select doc_id, len(t) length, unnest(t) term from t) group by all),
"""
_SCORES = f"""with {_DOCS}
f as (select term, count(*) df from p group by 1),
st as (select count(*)::double n, avg(len(t)) avgdl from t),
q as (select query_id, term, count(*) times from (select query_id, unnest({_tok('query_text')}) term from search_queries) group by all),
sc as (select query_id, doc_id, sum(times * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) score
  from q join f using (term) join p using (term), st group by 1, 2)
"""
_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
_RE_WS = "[\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_QUALITY = f"""with c as (select doc_id, coalesce(text, '') t from documents),
h as (select doc_id, ch, count(*) n from (select doc_id, unnest(string_split(t, '')) ch from c where t <> '') group by all),
e as (select doc_id, sum(n) total, -sum(n * log2(n)) nl from h group by 1),
w as (select doc_id, max(n) most, sum(n) bare from h where not contains({_WS}, ch) group by 1),
m as (select c.doc_id, coalesce(most / bare, 0.0) repetition, case when total is null then 0.0 else abs(log2(total) + nl / total) end entropy,
  coalesce((len(regexp_extract_all(t, 'f{_RE_WS}+i')) + len(regexp_extract_all(t, 'f{_RE_WS}+l')) + len(regexp_extract_all(t, 'f{_RE_WS}+f'))) / nullif(len(list_filter(regexp_split_to_array(t, '{_RE_WS}+'), lambda x: x <> '')), 0)::double, 0.0) malformed,
  case when total is null then 0.0 else (total - coalesce(bare, 0)) / total end whitespace
  from c left join e using (doc_id) left join w using (doc_id))
"""
_ENT = "ent as (select * from (select *, row_number() over (partition by entity_id order by ingested_at desc) rn from entities where entity_id is not null) where rn = 1)"
_REL = "rel as (select * from (select *, row_number() over (partition by relationship_id order by ingested_at desc) rn from relationships where relationship_id is not null) where rn = 1)"
_SRC = "src as (select * from (select *, row_number() over (partition by id order by created_at desc) rn from source_documents where id is not null) where rn = 1)"
_ADJ = "adj as (select source_entity_id node, target_entity_id other, relationship_id from rel where source_entity_id is not null union all select target_entity_id, source_entity_id, relationship_id from rel where source_entity_id <> target_entity_id)"
_START = "s0 as (select min(entity_id) node from ent where entity_id in (select source_entity_id from rel))"
_COS = "list_cosine_similarity({0}::double[], {1}::double[])"
_SIMPLE = """g as (select a, b, max_by(w, relationship_id) weight from (select least(source_entity_id, target_entity_id) a, greatest(source_entity_id, target_entity_id) b, relationship_id, coalesce(nullif(weight, 0), 1)::double w
  from rel where source_entity_id is not null and target_entity_id is not null) group by 1, 2)"""
_HITS = """hv as (select query_id, chunk_id, max(case when isnan(vector_score) then null else vector_score end) v, max(case when isnan(bm25_score) then null else bm25_score end) b from retrieval_results group by 1, 2),
v as (select query_id, chunk_id, v, row_number() over (partition by query_id order by v desc, chunk_id) vr, case when max(v) over w = min(v) over w then 0.5 else (v - min(v) over w) / (max(v) over w - min(v) over w) end vn from hv where v is not null window w as (partition by query_id)),
b as (select query_id, chunk_id, b, row_number() over (partition by query_id order by b desc, chunk_id) br, case when max(b) over w = min(b) over w then 0.5 else (b - min(b) over w) / (max(b) over w - min(b) over w) end bn from hv where b is not null window w as (partition by query_id)),
j as (select query_id, chunk_id, coalesce(vr, coalesce(max(vr) over w, 0) + 1) vector_rank, coalesce(br, coalesce(max(br) over w, 0) + 1) bm25_rank, coalesce(vn, 0) vn, coalesce(bn, 0) bn from v full join b using (query_id, chunk_id) window w as (partition by query_id))
"""


def _fusion_sql(score: str) -> str:
    return f"with {_HITS} select query_id, chunk_id, vector_rank, bm25_rank, round(f, 6) fused_score, rank from (select *, row_number() over (partition by query_id order by f desc, chunk_id) rank from (select *, {score} f from j)) where rank <= 10"


_ALPHA, _RRF = "0.5 * vn + 0.5 * bn", "1.0::double / (60 + vector_rank) + 1.0::double / (60 + bm25_rank)"
_FIRST = "hits as (select chunk_id id, row_number() over (order by s desc, chunk_id) rank from (select chunk_id, max(coalesce(case when isnan(fused_score) then null else fused_score end, 0)) s from retrieval_results where query_id = (select min(query_id) from retrieval_results) group by 1) qualify rank <= 10)"
_CONTEXT = f"""with {_ENT}, {_REL}, {_FIRST},
met as (select distinct entity_id, rank from (select entity_id, unnest(source_chunk_ids) c from ent) join hits on id = c),
own as (select distinct entity_id from met where entity_id in (select source_entity_id from rel union select target_entity_id from rel)),
edges as (select relationship_id, source_entity_id s, target_entity_id t from rel where source_entity_id in (select entity_id from own) or target_entity_id in (select entity_id from own))
"""
_CONTEXT_ALL = f"""with {_ENT}, {_REL}, hits as (select query_id, chunk_id id, row_number() over (partition by query_id order by s desc, chunk_id) rank from (select query_id, chunk_id, max(coalesce(case when isnan(fused_score) then null else fused_score end, 0)) s from retrieval_results where query_id is not null group by 1, 2) qualify rank <= 10),
met as (select distinct query_id, entity_id, rank from (select entity_id, unnest(source_chunk_ids) c from ent) join hits on id = c),
own as (select distinct query_id, entity_id from met where entity_id in (select source_entity_id from rel union select target_entity_id from rel)),
edges as (select query_id, relationship_id, source_entity_id s, target_entity_id t from rel join own on source_entity_id = entity_id union select query_id, relationship_id, source_entity_id, target_entity_id from rel join own on target_entity_id = entity_id)
"""
_FUSED_HITS = _HITS[_HITS.index("\nv as (select") :]
_CHU = "chu as (select * from (select *, row_number() over (partition by chunk_id order by ingested_at desc) rn from chunks where chunk_id is not null) where rn = 1)"


def _chunk_scores(queries: str, keep: int) -> str:
    """BM25 of the chunks for queries (query_id, text), the best ones per query, as hs."""
    return f"""t as (select chunk_id, {_tok('text')} t from chu),
p as (select chunk_id, term, count(*)::int tf, length::int length from (select chunk_id, len(t) length, unnest(t) term from t) group by all),
f as (select term, count(*) df from p group by 1),
st as (select count(*)::double n, avg(len(t)) avgdl from t),
q as (select query_id, term, count(*) times from (select query_id, unnest({_tok('text')}) term from {queries}) group by all),
sc as (select query_id, chunk_id, round(sum(times * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 12) score from q join f using (term) join p using (term), st group by 1, 2),
hs as (select query_id, chunk_id, score from sc where score > 0 qualify row_number() over (partition by query_id order by score desc, chunk_id) <= {keep})"""


_GOOD = "len({0}) = 64 and len(list_filter({0}, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_sum(list_transform({0}, lambda x: abs(x))) > 0"
_HYBRID = f"""with {_CHU}, sums as (select community_id query_id, summary as text, summary_embedding vec from (select *, row_number() over (partition by community_id order by ingested_at desc) rn from community_summaries where community_id is not null) where rn = 1),
{_chunk_scores('sums', 30)},
vs as (select query_id, chunk_id, {_COS.format('embedding', 'vec')} score from (select * from chu where {_GOOD.format('embedding')}) c, (select * from sums where {_GOOD.format('vec')}) s qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 30),
hv as (select query_id, chunk_id, vs.score v, hs.score b from vs full join hs using (query_id, chunk_id)),
{_FUSED_HITS}"""
# A text cut at headings, the parts normalised and stripped; long ones in windows that end at the best mark of their second half.
_CHUNKED = f"""with recursive src(id, path, raw) as ({{0}}),
nrm as (select id, path, regexp_replace(regexp_replace(regexp_replace(raw, '\\[\\[Page [0-9]+ STAT\\. [0-9]+\\]\\]', '', 'g'), '\\n{{{{3,}}}}', chr(10)||chr(10), 'g'), ' {{{{5,}}}}', '    ', 'g') raw from src),
l as (select *, unnest(string_split(raw, chr(10))) line, generate_subscripts(string_split(raw, chr(10)), 1) i from (select *, row_number() over () rn from nrm)),
s as (select *, sum(case when i > 1 and regexp_matches(ltrim(line, {_WS}), '^#{{{{1,6}}}} ') then 1 else 0 end) over (partition by rn order by i) section from l),
part as (select rn, any_value(id) id, any_value(path) path, section, trim(string_agg(line, chr(10) order by i), {_WS}) body from s group by rn, section),
long as (select *, length(body) n from part where length(body) > 1000),
win(rn, section, body, n, a, z) as (
  select rn, section, body, n, a, {{1}} from (select rn, section, body, n, 0::bigint a from long)
  union all
  select rn, section, body, n, a, {{1}} from (select rn, section, body, n, case when z - 200 > a then z - 200 else z end a from win) where a < n),
piece as (select rn, section, a, trim(substring(body, a + 1, z - a), {_WS}) as text from win union all select rn, section, 0, body from part where length(body) <= 1000),
kept as (select p.*, id, path, row_number() over (partition by p.rn order by p.section, a) - 1 k from piece p join part using (rn, section) where length(p.text) >= 50)
select distinct sha256(coalesce(path, '') || chr(1) || id || '/' || k) chunk_id, id source_document_id, text, k::int chunk_index from kept"""
_MARKS = ("chr(10)||chr(10)", "'. '", "'? '", "'! '", "chr(10)", "' '")
_WINDOW_END = "case when n <= a + 1000 then n " + " ".join(f"when contains(substring(body, a + 501, 500), {m}) then a + 1001 - strpos(reverse(substring(body, a + 501, 500)), reverse({m}))" for m in _MARKS) + " else a + 1000 end"
_PRIO = "case upper(entity_type) " + " ".join(f"when '{k}' then {v}" for k, v in TYPE_PRIORITY.items()) + " else 99 end"

ORACLES = {
    "tokenize_terms": f"with {_DOCS} x as (select 1) select * from p",
    "chunked_texts": _CHUNKED.format("select doc_id::varchar, source_path, coalesce(text, '') from documents", _WINDOW_END),
    "chunked_documents": _CHUNKED.format("select id, source_path, coalesce(raw_content, '') from source_documents", _WINDOW_END),
    "hybrid_search_all": _HYBRID + f" select query_id, chunk_id, vector_rank, bm25_rank, round(f, 6) fused_score, rank from (select *, row_number() over (partition by query_id order by f desc, chunk_id) rank from (select *, (({_ALPHA}) + ({_RRF})) / 2 f from j)) where rank <= 10",
    "stored_postings_search": f"with {_CHU}, sq as (select query_id, query_text as text from search_queries), {_chunk_scores('sq', 30)} select query_id, chunk_id, round(score, 6) score from hs",
    "stranded_by_type": f"with {_ENT}, ty as (select unnest([{', '.join(repr(t) for t in RELATION_TYPES)}]) relationship_type), ends as (select relationship_type, source_entity_id entity_id from relationships union select relationship_type, target_entity_id from relationships) select relationship_type, entity_id from ty, ent where not exists (select 1 from ends where ends.relationship_type = ty.relationship_type and ends.entity_id = ent.entity_id)",
    "stored_lifecycle": f"with {_SRC}, gone as (select record_id from deleted_records where record_kind = 'source_document') select id, case when pipeline_status is null and (id not in (select record_id from gone where record_id is not null)) then '/moved' || source_path else source_path end source_path, case when pipeline_status = 'pending' then 'chunked' else pipeline_status end pipeline_status, case when pipeline_status = 'complete' then md5('new') else md5(raw_content) end content_md5 from src where pipeline_status = 'complete' or id not in (select record_id from gone where record_id is not null)",
    "bm25_doc_freq": f"with {_DOCS} x as (select 1) select term, count(*) df from p group by 1",
    "bm25_corpus_stats": f"with {_DOCS} x as (select 1) select count(*) n, round(avg(len(t)), 6) avgdl from t",
    "bm25_topk": _SCORES + "select query_id, doc_id, round(score, 6) score from sc where score > 0 qualify row_number() over (partition by query_id order by score desc, doc_id) <= 10",
    "bm25_match_counts": _SCORES + "select query_id, count(*) hits, round(max(score), 6) best from sc where score > 0 group by 1",
    "quality_metrics": _QUALITY + "select doc_id, round(repetition, 6) repetition, round(entropy, 6) entropy, round(malformed, 6) malformed, round(whitespace, 6) whitespace from m",
    "quality_verdict": _QUALITY
    + """select doc_id, case when repetition > 0.4 then format('Repetition too high: {:.2f} > 0.4', repetition) when entropy < 3 then format('Entropy too low: {:.2f} < 3.0', entropy)
 when entropy > 7 then format('Entropy too high: {:.2f} > 7.0', entropy) when malformed > 0.05 then format('Malformed text: {:.2f} > 0.05', malformed) when whitespace > 0.3 then format('Whitespace too dense: {:.2f} > 0.3', whitespace) end reason from m""",
    "normalized_texts": "select distinct chunk_id, regexp_replace(regexp_replace(regexp_replace(text, '\\[\\[Page [0-9]+ STAT\\. [0-9]+\\]\\]', '', 'g'), '\\n{3,}', chr(10)||chr(10), 'g'), ' {5,}', '    ', 'g') as text from chunks",
    "header_section_counts": f"""with l as (select id, rn, unnest(string_split(raw_content, chr(10))) line, generate_subscripts(string_split(raw_content, chr(10)), 1) i from (select *, row_number() over () rn from source_documents where raw_content is not null)),
 s as (select *, sum(case when i > 1 and regexp_matches(ltrim(line, {_WS}), '^#{{1,6}} ') then 1 else 0 end) over (partition by rn order by i) section from l)
 select distinct id, section::int section, md5(body) body_md5 from (select rn, any_value(id) id, section, string_agg(line, chr(10) order by i) body from s group by rn, section)""",
    "token_arrays": f"select item_id, {_tok('text')} tokens from eval_items",
    "vector_topk": f"select vec_id, round({_COS.format('embedding', '(select embedding from embeddings where vec_id = 0)')}, 6) similarity from embeddings order by {_COS.format('embedding', '(select embedding from embeddings where vec_id = 0)')} desc, vec_id limit 10",
    "vector_search_all": f"select query_id, vec_id, round(s, 6) similarity from (select q.vec_id query_id, e.vec_id::varchar vec_id, {_COS.format('e.embedding', 'q.embedding')} s from embeddings e, embeddings q where q.label = 0) qualify row_number() over (partition by query_id order by s desc, vec_id) <= 3",
    "label_centroids": "select label, (i - 1)::int pos, round(avg(x::double), 6) x from (select label, unnest(embedding) x, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2",
    "embedding_outliers": f"with c as (select label, list(x order by i) c from (select label, i, avg(x::double) x from (select label, unnest(embedding) x, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2) group by 1), n as (select label from embeddings group by 1 having count(*) >= 2) select label, vec_id, round(s, 6) similarity from (select label, vec_id, {_COS.format('embedding', 'c')} s from embeddings join c using (label) join n using (label)) where s < 0.1",
    "corpus_outliers": f"with c as (select list(x order by i) c from (select i, avg(x::double) x from (select unnest(embedding) x, generate_subscripts(embedding, 1) i from embeddings) group by 1)) select vec_id, round(s, 6) similarity from (select vec_id, {_COS.format('embedding', 'c')} s from embeddings, c) where s < 0.1",
    "near_copies_dropped": f"""with recursive near as (select vec_id, embedding v, row_number() over (order by {_COS.format('embedding', '(select embedding from embeddings where vec_id = 0)')} desc, vec_id) r from embeddings qualify r <= 10),
 fold as (select 0::bigint r, []::bigint[] kept union all select n.r, case when list_bool_or([false] || list_transform(f.kept, lambda k: {_COS.format('n.v', '(m.m)[k]')} >= 0.3)) then f.kept else list_append(f.kept, n.vec_id) end from fold f join near n on n.r = f.r + 1, (select map_from_entries(list((vec_id, v))) m from near) m)
 select vec_id, r::int rank from near where list_contains((select kept from fold order by r desc limit 1), vec_id)""",
    "hybrid_fusion_topk": _fusion_sql(f"(({_ALPHA}) + ({_RRF})) / 2"),
    "fusion_alpha_only": _fusion_sql(_ALPHA),
    "fusion_rrf_only": _fusion_sql(_RRF),
    "text_only_ranking": f"with {_HITS} select query_id, chunk_id, round(b, 6) fused_score, br::int bm25_rank from b where br <= 5",
    "documents_incomplete": f"with {_SRC} select id, source_path, pipeline_status from src where pipeline_status is null or pipeline_status <> 'complete'",
    "documents_by_status": f"with {_SRC} select id from src where pipeline_status = 'complete'",
    "documents_by_portable_path": f"with {_SRC} select array_to_string(list_reverse(list_reverse(string_split(replace(source_path, chr(92), '/'), '/'))[1:2]), '/') tail, min(id) id, count(*) documents from src where source_path is not null group by 1",
    "documents_without_chunks": f"with {_SRC} select id from src where id not in (select source_document_id from chunks where source_document_id is not null)",
    "chunk_outputs": """with x as (select *, regexp_extract(replace(coalesce(metadata['source'], ''), chr(92), '/'), '([^/]+)/*$', 1) f from retrieval_results)
 select distinct query_id, chunk_id "chunkId", case when f <> '' then f else 'Unknown' end "source", """
    + ", ".join(f"round(coalesce(case when isnan({c}) then null else {c} end, 0)::varchar::decimal(38, 15), 4)::double \"{n}\"" for c, n in (("vector_score", "vectorScore"), ("bm25_score", "bm25Score"), ("fused_score", "fusedScore")))
    + ', vector_rank "vectorRank", bm25_rank "bm25Rank" from x',
    "chunks_of_documents": "select source_document_id, count(*) chunks, max(chunk_index) last_index from (select *, row_number() over (partition by chunk_id order by ingested_at desc) rn from chunks where chunk_id is not null) where rn = 1 group by 1",
    "entities_by_search_names": f"with {_ENT} select entity_id, name from ent where lower(name) in (select lower(canonical_name) from ent where canonical_name is not null)",
    "names_of_sources": f"with {_ENT} select entity_id, name, entity_type from ent where entity_id in (select source_entity_id from relationships)",
    "entity_merge": f"""with {_ENT}, k as (select *, lower(trim(name)) k, strftime(ingested_at, '%Y-%m-%d %H:%M:%S.%f') || '|' || entity_id seen from ent where name is not null)
 select min_by(entity_id, seen) entity_id, min_by(coalesce(entity_type, chr(0)), ({_PRIO}, seen)) entity_type,
 list_reduce(list_prepend('', list(coalesce(description, '') order by seen)), lambda acc, x: case when x = '' then acc when acc = '' then x when contains(acc, x) then acc else acc || ' | ' || x end) description,
 array_to_string(list_sort(list_distinct(flatten(list(coalesce(source_document_ids, []))))), ',') source_document_ids, array_to_string(list_sort(list_distinct(flatten(list(coalesce(source_chunk_ids, []))))), ',') source_chunk_ids from k group by k""".replace(f"min_by(coalesce(entity_type, chr(0)), ({_PRIO}, seen)) entity_type", f"nullif(min_by(coalesce(entity_type, chr(0)), ({_PRIO}, seen)), chr(0)) entity_type"),
    "entity_upsert": f"""with {_ENT}, n as (select *, lower(name) k, {_PRIO} p, coalesce(entity_type = 'PERSON', true) mine from ent where name is not null),
 h as (select k, mine, min(entity_id) id, min_by(name, entity_id) name, min(p) p, nullif(min_by(coalesce(entity_type, chr(0)), (p, entity_id)), chr(0)) t from n group by 1, 2)
 select coalesce(a.id, b.id) entity_id, coalesce(a.name, b.name) name, case when a.k is null or b.p < a.p then b.t else a.t end entity_type
 from (select * from h where mine) a full join (select * from h where not mine) b using (k)""",
    "stranded_entities": f"with {_ENT} select entity_id from ent where not exists (select 1 from relationships where source_entity_id = entity_id) and not exists (select 1 from relationships where target_entity_id = entity_id)",
    "connected_entities": f"with {_ENT} select entity_id from ent where exists (select 1 from relationships where source_entity_id = entity_id) or exists (select 1 from relationships where target_entity_id = entity_id)",
    "relationship_enrich": f"with {_ENT}, {_REL} select relationship_id, a.name source_name, a.entity_type source_type, b.name target_name, b.entity_type target_type from rel left join ent a on a.entity_id = source_entity_id left join ent b on b.entity_id = target_entity_id",
    "simple_graph": f"with {_REL}, {_SIMPLE} select a, b, round(weight, 6) weight from g",
    "entity_neighborhood_2hop": f"with {_ENT}, {_REL}, {_ADJ}, {_START}, s1 as (select distinct other node from adj join s0 using (node) where other is not null), s2 as (select distinct other node from adj join s1 using (node) where other is not null) select node entity_id, min(depth) depth from (select node, 0 depth from s0 union all select node, 1 from s1 union all select node, 2 from s2) group by 1",
    "neighborhood_edges_2hop": f"with {_ENT}, {_REL}, {_ADJ}, {_START}, s1 as (select distinct other node from adj join s0 using (node) where other is not null and other <> (select node from s0)) select relationship_id, hop, count(*) times from (select relationship_id, 1 hop from adj join s0 using (node) union all select relationship_id, 2 from adj join s1 using (node)) group by 1, 2",
    "incident_relationships": f"with {_ENT}, {_REL}, l as (select entity_id from ent where entity_type = 'LOCATION') select relationship_id from rel where source_entity_id in (select entity_id from l) or target_entity_id in (select entity_id from l)",
    "entity_context": _CONTEXT + "select 'entity' kind, entity_id id from own union all select 'relationship', relationship_id from edges",
    "evidence_split": _CONTEXT + ", d as (select entity_id from own where entity_id in (select entity_id from met where rank <= 3)) select relationship_id, coalesce(s in (select entity_id from d), false) or coalesce(t in (select entity_id from d), false) direct from edges",
    "entity_context_all": _CONTEXT_ALL + "select query_id, 'entity' kind, entity_id id from own union all select query_id, 'relationship', relationship_id from edges",
    "evidence_split_all": _CONTEXT_ALL + ", d as (select distinct o.query_id, o.entity_id from own o join met m on m.query_id = o.query_id and m.entity_id = o.entity_id where m.rank <= 3) select e.query_id, relationship_id, a.entity_id is not null or b.entity_id is not null direct from edges e left join d a on a.query_id = e.query_id and a.entity_id = s left join d b on b.query_id = e.query_id and b.entity_id = t",
    "vector_topk_all": f"select query_id, vec_id, round(s, 6) similarity from (select q.vec_id query_id, e.vec_id, {_COS.format('e.embedding', 'q.embedding')} s from embeddings e, embeddings q where q.vec_id % 50 = 0) qualify row_number() over (partition by query_id order by s desc, vec_id) <= 10",
    "resolve_relationship_ids": f"""with {_ENT}, {_REL}, st as (select lower(name) n, max(entity_id) i from ent where name is not null group by 1), m as (select entity_id f, i from ent join st on n = lower(name))
 select relationship_id, coalesce(a.i, source_entity_id) source_entity_id, coalesce(b.i, target_entity_id) target_entity_id from rel left join m a on a.f = source_entity_id left join m b on b.f = target_entity_id where coalesce(a.i, source_entity_id) in (select i from st) and coalesce(b.i, target_entity_id) in (select i from st)""",
    "mention_matches": f"""with {_ENT}, e as (select list_filter(source_document_ids, lambda x: length(x) > 0)[1] grp, entity_id, lower(trim(name)) n, canonical_name from ent where name is not null),
 m as (select distinct grp, case when len(string_split(canonical_name, ' ')) > 2 then array_to_string(string_split(canonical_name, ' ')[1:2], ' ') else canonical_name end mention from e where canonical_name is not null and grp is not null),
 x as (select m.grp, mention, min(entity_id) entity_id from m join e on e.grp = m.grp and n = lower(trim(mention)) where trim(mention) <> '' and n <> '' group by 1, 2)
 select * from x union all select m.grp, mention, min(entity_id) from m join e on e.grp = m.grp where trim(mention) <> '' and n <> '' and (contains(n, lower(trim(mention))) or contains(lower(trim(mention)), n)) and not exists (select 1 from x where x.grp = m.grp and x.mention = m.mention) group by 1, 2""",
    "label_propagation_2": f"""with {_REL}, {_SIMPLE}, e as (select a node, b other, weight from g where a <> b union all select b, a, weight from g where a <> b), l0 as (select a node, a label from g union select b, b from g),
"""
    + ",".join(
        f"""h{i} as (select e.node, label, round(sum(weight), 9) w from e join l{i - 1} l on l.node = other group by 1, 2), b{i} as (select node, min_by(label, (-w, label)) best, max(w) w from h{i} group by 1),
 l{i} as (select l.node, case when best is null or coalesce(o.w, -1) >= b.w then l.label else best end label from l{i - 1} l left join b{i} b on b.node = l.node left join h{i} o on o.node = l.node and o.label = l.label)"""
        for i in (1, 2)
    )
    + " select node, label from l2",
    "corpus_stats": 'select (select count(*) from source_documents) "documentCount", (select count(*) from chunks) "chunkCount", (select count(*) from entities) "entityCount", (select count(*) from relationships) "relationshipCount", (select count(*) from community_summaries) "communityCount"',
    "table_stats": " union all ".join(f"select '{t}' \"table\", count(*) \"rows\" from {t}" for t in ("chunks", "entities", "relationships", "documents", "retrieval_results", "deleted_records")),
    "upsert_idempotent": f"with {_SRC} select id, source_path, pipeline_status, md5(raw_content) content_md5 from src",
}
