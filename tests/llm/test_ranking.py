import random

from pyspark.sql import functions as F

from graphloom.llm.queries import SCORES
from graphloom.llm.ranking import fuse_rankings, strong_everywhere


def model(rows):
    out = set()
    groups = {}
    for q, c, *s in rows:
        groups.setdefault(q, {})[c] = [x if x is not None and x == x else None for x in s]
    for q, items in groups.items():
        for c, s in items.items():
            ok, some = True, False
            for j in range(3):
                col = [v[j] for v in items.values() if v[j] is not None]
                if not col:
                    continue
                some = True
                ok = ok and s[j] is not None and 1 + sum(x > s[j] for x in col) <= -(-len(col) // 4)
            if ok and some:
                out.add((q, c))
    return out


def test_fused_ranking_normal_and_hot_paths(spark):
    rng = random.Random(3)
    pick = lambda: rng.choice([None, float("nan"), *[rng.randint(0, 9) * 1.0] * 6])
    rows = [(q, f"c{i}", pick(), pick(), None if q == "b" else pick()) for q in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, vector_score double, bm25_score double, fused_score double").withColumn("vector_score_pos2", F.lit(1))
    want = model(rows)
    plain = fuse_rankings(df, "query_id", "chunk_id", SCORES)
    hot = fuse_rankings(df, "query_id", "chunk_id", SCORES, hot_rows=10, bands=4)
    assert {tuple(r) for r in strong_everywhere(plain, SCORES).select("query_id", "chunk_id").collect()} == want
    assert sorted(map(str, plain.collect())) == sorted(map(str, hot.select(*plain.columns).collect()))
    assert {tuple(r) for r in strong_everywhere(hot, SCORES).select("query_id", "chunk_id").collect()} == want
    for r in (sums := plain.collect()):
        assert r["rank"] == 1 + sum(o.rrf > r.rrf for o in sums if o.query_id == r.query_id)
    assert fuse_rankings(df.limit(0), "query_id", "chunk_id", SCORES).count() == 0
