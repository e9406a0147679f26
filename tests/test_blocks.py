"""Searches block against block: the same hits as pair by pair, whatever the blocks."""

import random

import pytest
from graphloom.operators import blocks, bm25, vectors
from graphloom.plans import search
from pyspark.sql import functions as F

WORDS = "harbour survey ledger canal ridge view steep relay orchard plateau 漢".split()


@pytest.fixture(params=[(1 << 16, 1 << 15), (8, 3)], ids=["one block", "many blocks"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", request.param[0])
    monkeypatch.setattr(blocks, "ASKED", request.param[1])


def texts(spark):
    """Texts with repeated ids of one and of several lengths, a null id, null and empty texts, and copies."""
    rng = random.Random(5)
    rows = [(f"t{i:02d}", " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))) for i in range(40)]
    rows += [("t03", rows[3][1]), ("t04", "canal canal view"), ("t05", "ledger"), (None, "harbour view"), ("e1", None), ("e2", ""), ("e3", "the of"), ("z1", rows[7][1]), ("z2", rows[7][1])]
    return spark.createDataFrame(rows, "id string, text string")


def asked(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(WORDS + ["absent"], k=rng.randint(1, 4)))) for i in range(12)]
    return spark.createDataFrame(rows + [(20, "absent"), (21, None), (22, "view view canal")], "qid int, text string")


def by_pairs(df, q):
    terms = bm25.query_terms(q, "qid", "text")
    return bm25.scores(bm25.postings(df, "id", "text"), bm25.corpus_stats(df, "text"), terms)


def test_match_counts_without_pairs(spark, sizes):
    df, q = texts(spark), asked(spark)
    want = {r.query_id: (r.n, round(r.s, 10)) for r in by_pairs(df, q).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("s")).collect()}
    assert {r.query_id: (r.hits, round(r.best, 10)) for r in bm25.match_counts(df, "id", "text", q, "qid", "text").collect()} == want and len(want) > 10
    n = blocks.block_count(df.count(), spark.sparkContext.defaultParallelism)
    rows = bm25.best_in_blocks(df, "id", "text", bm25.query_terms(q, "qid", "text"), 1).collect()
    assert len(rows) <= n * len(want) and all(len(r.hits) == 1 for r in rows)


def ranked(rows):
    return sorted((r.query_id, r["rank"], r.id or "", round(r.score, 10)) for r in rows.collect())


def test_search_without_pairs(spark, sizes):
    df, q = texts(spark), asked(spark)
    for k in (1, 4):
        found = bm25.search(df, "id", "text", q, "qid", "text", k)
        assert ranked(found) == ranked(bm25.top_k(by_pairs(df, q), k)) and found.count() > 10 * k
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_search_of_stored_postings_without_pairs(spark, sizes):
    df, q = texts(spark), asked(spark)
    found = bm25.search_stored(bm25.postings(df, "id", "text"), df, q, "qid", "text", 3)
    index = bm25.postings(df, "id", "text")
    want = bm25.top_k(bm25.scores(index, bm25.stored_stats(index, df), bm25.query_terms(q, "qid", "text")), 3)
    assert ranked(found) == ranked(want) and found.count() > 30
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_vectors_without_pairs(spark, sizes, monkeypatch):
    """Copies, vectors without a cosine, of other widths and of extreme size, query ids with several vectors."""
    monkeypatch.setattr(search, "FEW_PAIRS", 0)
    rng = random.Random(7)
    some = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(30)]
    odd = [None, [0.0] * 5, [], [1.0, 2.0], [float("nan")] * 5, [1.0, None, 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0, 1.0]]
    for huge in ([], [[1e150] * 5, [1e-150, 0.0, 0.0, 0.0, 0.0]]):
        e = spark.createDataFrame([(f"v{i:02d}", v) for i, v in enumerate(some + odd + some[:9] + huge)], "chunk_id string, embedding array<double>")
        q = spark.createDataFrame([(i % 14, v) for i, v in enumerate(some[:15] + odd + huge + [[3.0, 1.0]])], "query_id int, vector array<double>")
        pairs = e.select(F.col("chunk_id").alias("id"), "embedding").crossJoin(q).select("query_id", "id", vectors.cosine(F.col("embedding"), F.col("vector")).alias("score")).where("score is not null")
        found = search.vector_hits_all(e, q, 4)
        assert sorted(map(tuple, found.collect())) == sorted((r.query_id, r.id, r.score) for r in bm25.top_k(pairs, 4).collect())
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
