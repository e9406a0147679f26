"""Inverted index and BM25 ranking. Statistics are always derived from the postings, never kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings
from graphloom.functions.text import tokenize
from graphloom.operators import blocks
from graphloom.session import stage

MOST_WORDS = 200_000  # query words that are sent to all workers, some 10 MB; more are joined by a shuffle


def postings(df: DataFrame, id_col: str, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """(id, term, tf, length): term counts, with the number of tokens of the text."""
    rows = df.select(F.col(id_col).alias("id"), tokenize(F.col(text), stopwords).alias("t"))
    terms = rows.select("id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return terms.groupBy("id", "length", "term").agg(F.count("*").cast("int").alias("tf")).select("id", "term", "tf", "length")


def doc_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(df: DataFrame, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """One row (n, avgdl); texts without tokens count as texts."""
    return df.select(F.size(tokenize(F.col(text), stopwords)).alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def matching(df: DataFrame, id_col: str, text: str, terms: DataFrame, stopwords: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The postings of query words only, and :func:`corpus_stats`, from one reading of the texts.

    Words that no query has are dropped before the shuffle. Each text leaves one
    row without a word as well, which stands for its length.
    """
    rows = df.select(F.col(id_col).alias("id"), tokenize(F.col(text), stopwords).alias("t"))
    every = F.concat("t", F.array(F.lit(None).cast("string")))
    exploded = rows.select("id", F.size("t").alias("length"), F.explode(every).alias("term"))
    wanted = exploded.join(terms.select("term", F.lit(True).alias("_asked")).distinct(), "term", "left").where("_asked or term is null")
    found = stage(wanted.groupBy("id", "length", "term").agg(F.count("*").cast("int").alias("tf")))
    stats = found.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("length").cast("long") * F.col("tf")) / F.sum("tf"), F.lit(0.0)).alias("avgdl"))
    return found.where("term is not null").select("id", "term", "tf", "length"), stats


def stored_stats(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """:func:`corpus_stats` from stored postings: the lengths are the sums of the term counts."""
    total = index.agg(F.coalesce(F.sum(F.col("tf").cast("long")), F.lit(0)).alias("words"))
    return chunks.agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("n", F.coalesce(F.try_divide("words", "n"), F.lit(0.0)).alias("avgdl"))  # one row each


def query_terms(queries: DataFrame, query_id: str, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """(query_id, term, times): a repeated query word counts as often as it stands there."""
    rows = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(text), stopwords)).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def scores(index: DataFrame, stats: DataFrame, terms: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, id, score) of every text that shares a term with a query, score > 0.

    Only postings of query words are touched: the words of the queries reduce
    the index before anything is counted or joined. Scores are rounded to twelve
    decimals, so that the order in which the parts are added up settles no tie.
    """
    wanted = index.join(terms.select("term").distinct(), "term", "left_semi")
    frequency = doc_frequency(wanted)
    weighted = terms.join(frequency, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    weighted = weighted.select("query_id", "term", "avgdl", (F.col("times") * idf).alias("weight"))
    part = F.when(F.col("avgdl") > 0, F.col("weight") * F.col("tf") * (s.bm25_k1 + 1) / (F.col("tf") + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("length") / F.col("avgdl")))).otherwise(0.0)
    return wanted.join(weighted, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 12).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The best k rows per query with rank 1..k; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(packed: DataFrame, stats: DataFrame, n: int, terms: DataFrame, k: int, s: Settings) -> DataFrame:
    """:func:`blocks.word_hits` of packed postings over n blocks."""
    frequency = packed.where("term is not null").groupBy("term").agg(F.sum(F.size("texts")).alias("df"))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    weighted = terms.join(frequency, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("times") * idf).alias("weight"), "avgdl")  # stats is one row
    return blocks.word_hits(packed, weighted, n, terms.select("query_id").distinct().count(), k, s.bm25_k1, s.bm25_b)


def best_in_blocks(df: DataFrame, id_col: str, text: str, terms: DataFrame, k: int, s: Settings = DEFAULTS, stopwords: list[str] | None = None) -> DataFrame:
    """(query_id, matched, hits): for every query and block of texts the number of matching texts and the best k.

    The scores are those of :func:`scores`, of every text that shares a word with the query.
    """
    n = blocks.block_count(df.count(), df.sparkSession.sparkContext.defaultParallelism)
    texts = df.select(F.col(id_col).alias("id"), tokenize(F.col(text), stopwords).alias("tokens"))
    packed = stage(blocks.pack_texts(texts, terms.select("term").distinct(), n))
    rows = packed.where("term is null").select(F.explode(F.arrays_zip("texts", "tf")).alias("x")).select(F.col("x.texts").cast("long").alias("length"), F.col("x.tf").alias("rows"))
    stats = rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("length") * F.col("rows")) / F.sum("rows"), F.lit(0.0)).alias("avgdl"))
    return _best(packed, stats, n, terms, k, s)


def match_counts(df: DataFrame, id_col: str, text: str, queries: DataFrame, query_id: str, query_text: str, s: Settings = DEFAULTS, stopwords: list[str] | None = None) -> DataFrame:
    """(query_id, hits, best): the number of texts that share a word with the query, and the best score; of queries with a hit."""
    found = best_in_blocks(df, id_col, text, query_terms(queries, query_id, query_text, stopwords), 1, s, stopwords)
    return found.groupBy("query_id").agg(F.sum("matched").alias("hits"), F.round(F.max(F.col("hits")[0]["score"]), 12).alias("best"))


def search(df: DataFrame, id_col: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int, s: Settings = DEFAULTS, stopwords: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank)."""
    return _ranked(best_in_blocks(df, id_col, text, query_terms(queries, query_id, query_text, stopwords), k, s, stopwords), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    hits = blocks.exploded(found).select("query_id", "id", F.round("score", 12).alias("score"))
    return top_k(hits.where("score > 0"), k)


def search_stored(index: DataFrame, chunks: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int, s: Settings = DEFAULTS, stopwords: list[str] | None = None) -> DataFrame:
    """:func:`search` over stored postings (id, term, tf, length); of the chunks only the number is read.

    The postings of the query words are all that is read where these lie sorted by word.
    """
    terms = stage(query_terms(queries, query_id, query_text, stopwords))
    words = stage(terms.select("term").distinct())
    if words.count() <= MOST_WORDS:
        words = F.broadcast(words)
    stats = stage(stored_stats(index, chunks))
    n = blocks.block_count(stats.first().n, index.sparkSession.sparkContext.defaultParallelism)
    packed = stage(blocks.pack_postings(index.join(words, "term", "left_semi"), n))
    return _ranked(_best(packed, stats, n, terms, k, s), k)
