"""How distinctive a term is per record, by residual inverse document frequency.

A term with collection frequency cf over n records is expected, if scattered by
chance (Poisson), in n * (1 - exp(-cf / n)) records. Residual idf is the
observed idf minus the idf of that expectation: it is high for terms that are
concentrated in few records. A term's weight in a record is its frequency there
times its residual idf.

Counts cover all records. Each record id counts once: of repeated rows the one
with the greatest list of terms is taken. Null ids are dropped, null and empty texts
have no terms but count as records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_terms(text: Column, letters: int) -> Column:
    """Maximal runs of a-z of the given length or more in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{letters},}})"), 1)


def term_counts(df: DataFrame, id_col: str, text_col: str, letters: int) -> DataFrame:
    """(id, term, tf), one row per record and term."""
    # Only the terms of a text are shuffled, and a record's terms lie together afterwards.
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), long_terms(F.col(text_col), letters).alias("terms"))
    terms = rows.groupBy("id").agg(F.max("terms").alias("terms")).select("id", F.explode("terms").alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def residual_idf(df: DataFrame, id_col: str, text_col: str, letters: int = 1) -> DataFrame:
    """(id, term, tf, df, cf, n, ridf, weight) of every term of every record; n is the number of records."""
    counts = term_counts(df, id_col, text_col, letters)
    n = df.where(F.col(id_col).isNotNull()).agg(F.countDistinct(id_col).alias("n"))
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    by_chance = 1 - F.exp(-F.col("cf") / F.col("n"))
    ridf = -F.log2(F.col("df") / F.col("n")) + F.log2(by_chance)
    scored = stats.crossJoin(F.broadcast(n)).select("term", "df", "cf", "n", ridf.alias("ridf"))  # n is one row
    return counts.join(scored, "term").withColumn("weight", F.col("tf") * F.col("ridf"))


def least_weight(min_tf: int, max_df: int) -> Column:
    """The least weight of a term that a record repeats min_tf times and at most max_df records have.

    Such a term has cf >= df + min_tf - 1. Its residual idf is least for df = max_df,
    since n (1 - exp(-cf / n)) is concave in cf.
    """
    n = F.col("n")
    return min_tf * F.log2(n * (1 - F.exp(-(max_df + min_tf - 1) / n)) / max_df)


def characteristic_terms(scored: DataFrame, min_tf: int = 3, max_df: int = 5) -> DataFrame:
    """Terms whose weight reaches that of ``min_tf`` occurrences in a record, shared by ``max_df`` records.

    The weight alone also lets in terms that more records have and repeat still more
    often; the two limits are checked after it.
    """
    heavy = scored.where(F.col("weight") >= least_weight(min_tf, max_df) - 1e-9)
    return heavy.where((F.col("tf") >= min_tf) & (F.col("df") <= max_df))
