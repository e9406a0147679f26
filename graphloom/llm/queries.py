"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.encoding import encode_texts
from graphloom.llm.leakage import contaminated, leaked_spans, removed_spans, without_leaks
from graphloom.llm.names import identities, name_pairs
from graphloom.llm.nearcopies import similar_groups, similar_pairs, text_rows
from graphloom.llm.neighbours import nearest_neighbours, neighbour_pairs
from graphloom.llm.ranking import fuse_rankings, strong_everywhere
from graphloom.llm.spans import MIN_CHARS, shared_spans, shared_amount
from graphloom.llm.template import clean_pages, equivalence_classes, page_elements
from graphloom.llm.terms import characteristic_terms, residual_idf
from graphloom.sources.tables import read_table


COLLECTIONS = [("chunks", "chunk_id", "embedding"), ("community_summaries", "community_id", "summary_embedding")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key, vector in COLLECTIONS:
        near = nearest_neighbours(read_table(spark, d, name), key, vector, 64)
        own = neighbour_pairs(near).select(F.lit(name).alias("collection"), "id_a", "id_b")
        out = own if out is None else out.unionByName(own)
    return out


def _identities(spark: SparkSession, d: str) -> DataFrame:
    return identities(read_table(spark, d, "entities"), read_table(spark, d, "nicknames"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(_identities(spark, d))


def p3_identities(spark: SparkSession, d: str) -> DataFrame:
    return _identities(spark, d).select(F.col("id").alias("entity_id"), "identity", "kind", "score")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scored = residual_idf(read_table(spark, d, "chunks"), "chunk_id", "text", letters=9)
    return characteristic_terms(scored).select(F.col("id").alias("chunk_id"), "term")


def p4_term_weights(spark: SparkSession, d: str) -> DataFrame:
    scored = residual_idf(read_table(spark, d, "chunks"), "chunk_id", "text", letters=9)
    return scored.select(F.col("id").alias("chunk_id"), "term", "tf", "df", "cf", F.round("ridf", 6).alias("ridf"))


def _scoped_texts(spark: SparkSession, d: str) -> DataFrame:
    chunks = text_rows(read_table(spark, d, "chunks", spread=True), F.lit("chunks"), "chunk_id", "text", 20)
    return chunks.unionByName(text_rows(read_table(spark, d, "retrieval_results", spread=True), F.col("query_id"), "chunk_id", "text", 20))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_scoped_texts(spark, d), 3, 0.5)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return similar_groups(_scoped_texts(spark, d), 3, 0.5).select("scope", F.col("key").alias("chunk_id"), F.col("class_id"), "copies", "links")


_PAGE = ("id", "source_path", "raw_content")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return page_elements(read_table(spark, d, "source_documents", spread=True), *_PAGE).distinct()


def p6_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return clean_pages(read_table(spark, d, "source_documents", spread=True), *_PAGE)


def p6_template_classes(spark: SparkSession, d: str) -> DataFrame:
    return equivalence_classes(read_table(spark, d, "source_documents", spread=True), *_PAGE)


SCORES = ["vector_score", "bm25_score", "fused_score"]


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fuse_rankings(read_table(spark, d, "retrieval_results"), "query_id", "chunk_id", SCORES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return strong_everywhere(_fused(spark, d), SCORES).select("query_id", "chunk_id")


def p7_fused_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", *[f"{s}_pos" for s in SCORES], "rrf", "rank")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(read_table(spark, d, "documents", spread=True), "doc_id", "text")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(read_table(spark, d, "documents", spread=True), read_table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "item_id").distinct()


def p9_removed_documents(spark: SparkSession, d: str) -> DataFrame:
    return contaminated(_spans(spark, d)).select("doc_id", "longest_run", F.round("share", 6).alias("share"))


def p9_removed_spans(spark: SparkSession, d: str) -> DataFrame:
    return removed_spans(_spans(spark, d)).select("doc_id", "start_word", "end_word", "whole").distinct()


def p9_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", spread=True)
    return without_leaks(docs, _spans(spark, d)).select("doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_amount(read_table(spark, d, "documents", spread=True), "doc_id", "text", MIN_CHARS).select("doc_id", "shared_chars")


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(read_table(spark, d, "documents", spread=True), "doc_id", "text", MIN_CHARS)


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_identities": p3_identities,
    "p4_found": p4_found,
    "p4_term_weights": p4_term_weights,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_clean_text": p6_clean_text,
    "p6_template_classes": p6_template_classes,
    "p7_found": p7_found,
    "p7_fused_ranking": p7_fused_ranking,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_removed_documents": p9_removed_documents,
    "p9_removed_spans": p9_removed_spans,
    "p9_clean_documents": p9_clean_documents,
    "p10_found": p10_found,
    "p10_spans": p10_spans,
}

_TERMS = """
with once as (select chunk_id, max(regexp_extract_all(lower(text), '[a-z]{9,}')) t from chunks where chunk_id is not null group by 1),
counts as (select chunk_id, term, count(*) tf from (select chunk_id, unnest(t) term from once) group by 1, 2),
stats as (select term, count(*) df, sum(tf)::bigint cf from counts group by 1),
n as (select count(*)::double n from once)
"""

_POS = """
with once as (select query_id, chunk_id, max(case when isnan(vector_score) then null else vector_score end) vector_score,
  max(case when isnan(bm25_score) then null else bm25_score end) bm25_score,
  max(case when isnan(fused_score) then null else fused_score end) fused_score from retrieval_results group by 1, 2),
pos as (select query_id, chunk_id, """ + ", ".join(
    f"case when {s} is not null then rank() over (partition by query_id order by {s} desc nulls last) end {s}_pos, count({s}) over (partition by query_id) {s}_n" for s in SCORES
) + " from once)"

_LEAKS = """
with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents where text is not null),
g as (select distinct doc_id, i, len(w) n, array_to_string(w[i:i+9], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 8)) i from w)),
v as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from eval_items),
h as (select distinct item_id, j, array_to_string(w[j:j+9], ' ') g from (select item_id, w, unnest(range(1, len(w) - 8)) j from v)),
hit as (select doc_id, n, item_id, i, i - j d from g join h using (g)),
run as (select doc_id, item_id, d, min(i) lo, max(i) + 10 hi, max(i) - min(i) + 10 r from (select *, i - row_number() over (partition by doc_id, item_id, d order by i) grp from hit) group by doc_id, item_id, d, grp),
pos as (select distinct doc_id, n, i from hit),
isle as (select doc_id, n, min(i) lo, max(i) + 10 hi from (select *, sum(fresh) over (partition by doc_id order by i) grp from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 10 then 0 else 1 end fresh from pos)) group by doc_id, n, grp),
span as (select i.doc_id, n, i.lo, i.hi, (select max(r) from run where run.doc_id = i.doc_id and run.lo >= i.lo and run.hi <= i.hi) longest from isle i),
share as (select doc_id, max(longest)::int longest_run, sum(hi - lo)::double / max(n) share from span group by 1)
"""

ORACLES = {
    "p7_found": _POS + " select query_id, chunk_id from pos where vector_score_n + bm25_score_n + fused_score_n > 0 and " + " and ".join(f"({s}_n = 0 or coalesce({s}_pos <= ceil({s}_n / 4.0), false))" for s in SCORES),
    "p7_fused_ranking": _POS + " select *, rank() over (partition by query_id order by rrf desc) \"rank\" from (select query_id, chunk_id, " + ", ".join(f"{s}_pos" for s in SCORES) + ", round(" + " + ".join(f"coalesce(1.0::double / (60 + {s}_pos), 0.0)" for s in SCORES) + ", 9) rrf from pos)",
    "p9_removed_documents": _LEAKS + "select doc_id, longest_run, round(share, 6) share from share where longest_run >= 25 or share > 0.3",
    "p9_removed_spans": _LEAKS + "select doc_id, (lo - 1)::int start_word, (hi - 1)::int end_word, share > 0.3 whole from span join share using (doc_id) where longest >= 25 or share > 0.3",
    "p4_found": _TERMS + "select chunk_id, term from counts join stats using (term) where tf >= 3 and df <= 5",
    "p4_term_weights": _TERMS + "select chunk_id, term, tf, df, cf, round(-log2(df / n) + log2(1 - exp(-cf / n)), 6) ridf from counts join stats using (term), n",
    "p5_found": """
with t as (select 'chunks' scope, chunk_id k, text from chunks union select query_id, chunk_id, text from retrieval_results),
w as (select distinct scope, k, regexp_extract_all(lower(text), '[a-z0-9]+') w from t where text is not null),
x as (select row_number() over () id, scope, k, w from w where len(w) >= 20),
s as (select distinct id, scope, k, array_to_string(w[i:i+2], ' ') s from (select id, scope, k, w, unnest(range(1, len(w) - 1)) i from x)),
n as (select id, count(*) n from s group by 1),
p as (select a.scope, a.id ia, b.id ib, a.k key_a, b.k key_b, count(*) c from s a join s b on a.scope = b.scope and a.s = b.s and a.k < b.k group by all)
select distinct scope, key_a, key_b from p join n na on na.id = ia join n nb on nb.id = ib where c >= 0.5 * (na.n + nb.n - c)""",
    "p10_found": """
with w as (select doc_id, i, substring(text, i, 200) s from (select doc_id, text, unnest(range(1, length(text) - 198)) i from documents where length(text) >= 200)),
m as (select s from w group by s having count(distinct doc_id) > 1),
c as (select distinct doc_id, i from w join m using (s))
select doc_id, sum(n)::bigint shared_chars from (select doc_id, least(200, coalesce(lead(i) over (partition by doc_id order by i) - i, 200)) n from c) group by 1""",
    "p9_found": """
with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents where text is not null),
g as (select distinct doc_id, array_to_string(w[i:i+9], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 8)) i from w)),
v as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from eval_items),
h as (select distinct item_id, array_to_string(w[i:i+9], ' ') g from (select item_id, w, unnest(range(1, len(w) - 8)) i from v))
select distinct doc_id, item_id from g join h using (g)""",
}
