"""Operators do the whole job, whatever the number of queries or the size of a community."""

import random
from collections import Counter
from dataclasses import replace

from graphloom.config import DEFAULTS
from graphloom.operators import communities, graph, vectors
from graphloom.plans.search import vector_hits_all
from pyspark.sql import functions as F


def test_more_vector_queries_than_a_block(spark):
    rng = random.Random(3)
    e = spark.createDataFrame([(f"v{i:02d}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1203)], "query_id int, vector array<float>").repartition(3)
    got = {(r.query_id, r.id) for r in vector_hits_all(e, q, 2).collect()}
    pairs = q.crossJoin(e).select("query_id", "chunk_id", vectors.cosine(F.col("embedding"), F.col("vector")).alias("s")).collect()
    best: dict = {}
    for r in pairs:
        best.setdefault(r.query_id, []).append((-r.s, r.chunk_id))
    assert got == {(i, c) for i, x in best.items() for _, c in sorted(x)[:2]} and len(got) == 2406
    small = {(r.query_id, r.id) for r in vector_hits_all(e, q.where("query_id < 20"), 2, block=3).collect()}
    assert small == {x for x in got if x[0] < 20}


def test_no_community_stays_above_the_limit(spark):
    clique = [(f"c{a:02d}", f"c{b:02d}", 1.0) for a in range(26) for b in range(a)]
    star = [("hub", f"leaf{i:02d}", 1.0) for i in range(25)]
    path = [(f"p{i:02d}", f"p{i + 1:02d}", 1.0) for i in range(39)]
    parts = Counter()
    rows = communities.bounded_parts(spark.createDataFrame(clique + star + path, "a string, b string, weight double"), 10).collect()
    label = {r.node: r.label for r in rows}
    assert len(label) == len(rows) == 26 + 26 + 40
    parts.update(label.values())
    assert max(parts.values()) <= 10 and parts[label["hub"]] == 10
    # Nothing is torn out of a part: whatever has an edge to another part does not fit with it.
    assert all(label[a] == label[b] or parts[label[a]] + parts[label[b]] > 10 for a, b, _ in clique + star + path)
    found = communities.communities(spark.createDataFrame(clique, "a string, b string, weight double"), s=replace(DEFAULTS, max_community_size=10)).collect()
    last = Counter(r.cluster for r in found if r.level == 1)
    assert sum(last.values()) == 26 and max(last.values()) <= 10 and min(last.values()) > 1


def test_context_and_evidence_of_several_queries(spark):
    e = spark.createDataFrame([("A", ["c1"]), ("B", ["c2"]), ("C", ["c3"])], "entity_id string, source_chunk_ids array<string>")
    r = spark.createDataFrame([("e1", "A", "B"), ("e2", "C", "X")], "relationship_id string, source_entity_id string, target_entity_id string")
    hits = spark.createDataFrame([("p", "c1", 1), ("q", "c3", 1), ("q", "c2", 4)], "query_id string, id string, rank int")
    own, edges = graph.entity_context(hits, e, r)
    assert {(x.query_id, x.entity_id) for x in own.collect()} == {("p", "A"), ("q", "B"), ("q", "C")}
    assert {(x.query_id, x.relationship_id, x.direct) for x in graph.evidence(hits, own, edges).collect()} == {("p", "e1", True), ("q", "e1", False), ("q", "e2", True)}
