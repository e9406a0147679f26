"""A stored index of vectors: k-means leaves, of which a query reads the nearest.

Leaf centroids are fitted on a bounded sample (``SAMPLE`` vectors, by a hash of
the id); every vector that has a direction lies in the leaf of its nearest
centroid, and what comes later is added to the leaves there are. How many leaves
a query visits is the least number at which ``CALIBRATION`` vectors, searched by
brute force over all vectors, find ``TARGET`` of their neighbours. Vectors that
are null, zero, not finite or of another width are in no leaf and match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.bm25 import top_k
from graphloom.operators.vectors import cosine

SAMPLE, CALIBRATION, TARGET, MOST_LEAVES = 20_000, 100, 0.97, 4_096


def _whole(c: Column) -> Column:
    """Whether a vector has a direction."""
    return F.coalesce(cosine(c, c).isNotNull(), F.lit(False))


def _units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, "f8") for v in vectors]).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_leaves(embeddings: DataFrame, k: int = 10, target: float = TARGET, id_col: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(leaf, centroid, probes); empty without vectors. The width most vectors have is taken."""
    spark = embeddings.sparkSession
    schema = "leaf int, centroid array<float>, probes int"
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where(_whole(F.col(vector)))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    width, total = widths[0]
    rows = rows.where(F.size("v") == width)
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    part = lambda n: math.ceil(min(1.0, n / total) * (1 << 40))
    x = _units([r.v for r in rows.where(mark < part(SAMPLE)).orderBy("id").collect()])
    asked = rows.where(mark >= (1 << 40) - part(CALIBRATION)).orderBy("id").limit(2 * CALIBRATION).collect()
    leaves = min(MOST_LEAVES, max(1, round(math.sqrt(total))), len(x))
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), leaves, replace=False)]
    for _ in range(10):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 0
        c[full] = sums[full] / np.linalg.norm(sums[full], axis=1, keepdims=True)
    probes = leaves
    if asked and leaves > 1:
        queries = spark.createDataFrame([(str(i), [float(v) for v in r.v]) for i, r in enumerate(asked)], "query_id string, vector array<double>")
        pairs = rows.join(F.broadcast(queries)).select("query_id", "id", F.col("v"), cosine(F.col("v"), F.col("vector")).alias("score"))  # 2 * CALIBRATION queries at most
        best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k).collect()
        place = (-(_units([r.v for r in asked]) @ c.T)).argsort(1).argsort(1)
        ranks = sorted(int(place[int(r.query_id), (_units([r.v]) @ c.T).argmax()]) for r in best)
        probes = ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)] + 1
    return spark.createDataFrame([(i, [float(v) for v in row], probes) for i, row in enumerate(c)], schema)


def _centroids(leaves: DataFrame) -> tuple[np.ndarray, int]:
    rows = leaves.orderBy("leaf").collect()  # MOST_LEAVES rows
    return np.array([r.centroid for r in rows], "f8"), rows[0].probes if rows else 0


def in_leaves(embeddings: DataFrame, leaves: DataFrame, id_col: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(leaf, chunk_id, embedding) of the vectors that have a place."""
    c, _ = _centroids(leaves)
    held = embeddings.sparkSession.sparkContext.broadcast(c)
    width = c.shape[1] if len(c) else -1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["leaf"] = (_units(b["embedding"].tolist()) @ held.value.T).argmax(1).astype("i4") if len(b) else pd.Series([], dtype="i4")
            yield b[["leaf", "chunk_id", "embedding"]]

    rows = embeddings.select(F.col(id_col).alias("chunk_id"), F.col(vector).cast("array<float>").alias("embedding"))
    return rows.where((F.size("embedding") == width) & _whole(F.col("embedding"))).mapInPandas(run, "leaf int, chunk_id string, embedding array<float>")


def indexed_hits(index: DataFrame, leaves: DataFrame, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, id, score): the k nearest vectors of every query among those in its nearest leaves."""
    c, calibrated = _centroids(leaves)
    held = index.sparkSession.sparkContext.broadcast(c)
    most = min(probes or calibrated, len(c))
    id_type = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = np.argsort(-(_units(b["vector"].tolist()) @ held.value.T), axis=1)[:, :most] if len(b) else np.zeros((0, 0), "i8")
            yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), near.shape[1]), "vector": [v for v in b["vector"] for _ in range(near.shape[1])], "leaf": near.ravel().astype("i4")})

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where((F.size("vector") == (c.shape[1] if len(c) else -1)) & _whole(F.col("vector")))
    visits = asked.mapInPandas(run, f"query_id {id_type}, vector array<double>, leaf int")
    scored = index.join(visits, "leaf").select("query_id", F.col("chunk_id").alias("id"), cosine(F.col("embedding"), F.col("vector")).alias("score")).where("score is not null")
    return top_k(scored, k).drop("rank")
