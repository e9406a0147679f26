"""Counts of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The output names of the corpus counts.
CORPUS = {"source_documents": "documentCount", "chunks": "chunkCount", "entities": "entityCount", "relationships": "relationshipCount", "community_summaries": "communityCount"}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows), one count per table."""
    out = None
    for name, df in tables.items():
        own = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = own if out is None else out.unionByName(own)
    return out


def corpus_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with a column per table, 0 for a table that is not there."""
    counts = table_counts({k: v for k, v in tables.items() if k in CORPUS})
    return counts.agg(*[F.coalesce(F.sum(F.when(F.col("table") == t, F.col("rows"))), F.lit(0)).alias(n) for t, n in CORPUS.items()])
