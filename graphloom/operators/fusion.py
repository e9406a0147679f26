"""Vector and text hits fused into one ranking, and near-duplicates dropped from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings
from graphloom.operators.vectors import cosine


def _ranked(hits: DataFrame, score: str, rank: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return hits.withColumn(rank, F.row_number().over(order))


def min_max(score: Column, over) -> Column:
    """Scores of one query stretched to 0..1; 0.5 if all are equal."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high == low, F.lit(0.5)).otherwise((score - low) / (high - low))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, alpha: float | None = None, use_alpha: bool = True, use_rrf: bool = True, s: Settings = DEFAULTS) -> DataFrame:
    """The best k of (query_id, id, score) hit lists of the same queries.

    A hit missing in one list has score and stretched score 0 there and the rank
    after its last hit. With both parts the fused score is their mean.
    """
    a = s.fusion_alpha if alpha is None else alpha
    over = Window.partitionBy("query_id")
    v = _ranked(vector_hits.select("query_id", "id", F.col("score").alias("vector_score")), "vector_score", "vector_rank").withColumn("v_norm", min_max(F.col("vector_score"), over))
    t = _ranked(text_hits.select("query_id", "id", F.col("score").alias("bm25_score")), "bm25_score", "bm25_rank").withColumn("b_norm", min_max(F.col("bm25_score"), over))
    both = v.join(t, ["query_id", "id"], "full_outer")
    last = lambda c: F.coalesce(F.max(c).over(over), F.lit(0)) + 1
    both = both.withColumns({"vector_rank": F.coalesce("vector_rank", last("vector_rank")), "bm25_rank": F.coalesce("bm25_rank", last("bm25_rank"))})
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("vector_score", "bm25_score", "v_norm", "b_norm")}
    both = both.withColumns(zero)
    weighted = a * F.col("v_norm") + (1 - a) * F.col("b_norm")
    rrf = 1.0 / (s.rrf_k + F.col("vector_rank")) + 1.0 / (s.rrf_k + F.col("bm25_rank"))
    fused = (weighted + rrf) / 2 if use_alpha and use_rrf else weighted if use_alpha else rrf if use_rrf else F.lit(0.0)
    both = both.withColumn("fused_score", fused)
    return _ranked(both, "fused_score", "rank").where(F.col("rank") <= k).select("query_id", "id", "vector_score", "bm25_score", "fused_score", "vector_rank", "bm25_rank", "rank")


def text_only(text_hits: DataFrame, k: int) -> DataFrame:
    """Without vectors the text score is the fused score."""
    hits = text_hits.select("query_id", "id", F.lit(0.0).alias("vector_score"), F.col("score").alias("bm25_score"), F.col("score").alias("fused_score"))
    return _ranked(hits, "fused_score", "rank").where(F.col("rank") <= k).select("*", F.lit(None).cast("int").alias("vector_rank"), F.col("rank").alias("bm25_rank"))


def drop_near_copies(hits: DataFrame, vector: str, threshold: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Hits in rank order, without those that resemble a hit already kept.

    The result of a query is at most top-k rows, so the order-dependent choice
    is a fold over one small array per query. Hits without a vector are kept.
    """
    limit = s.dedup_threshold if threshold is None else threshold
    if not s.dedup_enabled:
        return hits
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col(vector).cast("array<double>").alias("v")))).alias("h"))
    none = F.array().cast("array<struct<rank:int,id:string,v:array<double>>>")
    typed = F.transform("h", lambda x: F.struct(x["rank"].cast("int").alias("rank"), x["id"].cast("string").alias("id"), x["v"].alias("v")))
    kept = F.aggregate(typed, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.coalesce(cosine(y["v"], x["v"]) >= limit, F.lit(False))), acc).otherwise(F.concat(acc, F.array(x))))
    ids = rows.select("query_id", F.explode(kept).alias("x")).select("query_id", F.col("x.id").alias("_id"))
    return hits.join(ids, (hits["query_id"] == ids["query_id"]) & (hits["id"].cast("string") == ids["_id"]), "left_semi")
