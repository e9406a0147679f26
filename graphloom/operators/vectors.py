"""Cosine similarity, nearest vectors, centroids and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, zero, not finite, or the widths differ."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(value) & (F.abs(value) <= 2), value)


def nearest(df: DataFrame, id_col: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(id, similarity), best first; an empty query finds nothing. An exact scan with a top-k per task."""
    if not query:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("similarity")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    found = df.select(F.col(id_col).alias("id"), cosine(F.col(vector), q).alias("similarity")).where("similarity is not null")
    return found.orderBy(F.desc("similarity"), "id").limit(k)


def centroids(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """The mean vector of each group (of all rows if ``group`` is empty), null vectors left out."""
    parts = df.where(F.col(vector).isNotNull()).select(*group, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(*group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))  # partial sums before the shuffle
    whole = means.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return whole.select(*group, F.transform("v", lambda p: p.x).alias("centroid"))


def outliers(df: DataFrame, group: str, id_col: str, vector: str, s: Settings = DEFAULTS) -> DataFrame:
    """(group, id, similarity) of vectors far from the centroid of their large-enough group."""
    large = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= s.min_chunks_for_outlier).select(group)
    rows = df.join(large, group, "left_semi")
    near = rows.join(centroids(rows, [group], vector), group).select(group, F.col(id_col).alias("id"), cosine(F.col(vector), F.col("centroid")).alias("similarity"))
    return near.where(F.col("similarity") < s.outlier_threshold)


def corpus_outliers(df: DataFrame, id_col: str, vector: str, s: Settings = DEFAULTS) -> DataFrame:
    """(id, similarity) of vectors far from the centroid of all."""
    near = df.crossJoin(F.broadcast(centroids(df, [], vector))).select(F.col(id_col).alias("id"), cosine(F.col(vector), F.col("centroid")).alias("similarity"))
    return near.where(F.col("similarity") < s.outlier_threshold)
