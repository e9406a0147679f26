import json
import math
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.config import DEFAULTS, Settings
from graphloom.operators import communities, entities, fusion, graph, lookup, pruning, vectors
from graphloom.operators.extraction import extract_graph
from graphloom.plans import ingest, tools
from graphloom.plans.search import Engine, Tables, vector_hits
from graphloom.sources.files import read_documents
from graphloom.sources.providers import HashEmbedding, ModelExtractor, RuleExtractor, clean_relationship
from graphloom.sources.registry import Registry
from graphloom.sources.rejects import reject_name, write_rejects, write_viewer
from graphloom.sources.store import Store
from graphloom.streaming.ingest import follow_folder

HITS = "query_id string, id string, score double"
FUSED = {
    (True, False): [("B", 0.75), ("A", 0.5), ("C", 0.0), ("D", 0.0)],
    (False, True): [("B", 0.032522), ("A", 0.032266), ("D", 0.031754), ("C", 0.031746)],
    (True, True): [("B", 0.391261), ("A", 0.266133), ("D", 0.015877), ("C", 0.015873)],
}


@pytest.mark.parametrize("parts", FUSED)
def test_fusion_goldens(spark, parts):
    v = spark.createDataFrame([("q", "A", 0.9), ("q", "B", 0.5), ("q", "C", 0.1)], HITS)
    t = spark.createDataFrame([("q", "B", 4.0), ("q", "D", 2.0)], HITS)
    got = fusion.fuse(v, t, 10, use_alpha=parts[0], use_rrf=parts[1]).orderBy("rank").collect()
    assert [(r.id, round(r.fused_score, 6)) for r in got] == FUSED[parts]
    ranks = {r.id: (r.vector_rank, r.bm25_rank) for r in got}
    assert ranks["C"] == (3, 3) and ranks["D"] == (4, 2)


def test_fusion_edges(spark):
    v = spark.createDataFrame([("q", "A", 0.3)], HITS)
    none = v.limit(0)
    r = fusion.fuse(v, none, 5).first()
    assert (r.vector_rank, r.bm25_rank) == (1, 1) and round(r.fused_score, 6) == round((0.5 * 0.5 + 2 / 61) / 2, 6)
    assert fusion.fuse(none, none, 5).count() == 0 and fusion.fuse(v, none, 5, use_alpha=False, use_rrf=False).first().fused_score == 0
    assert fusion.text_only(v, 5).first().fused_score == 0.3


def angle(d):
    return [math.cos(math.radians(d)), math.sin(math.radians(d))]


def test_near_copies_follow_rank_order(spark):
    rows = [("q", "a", 1, angle(0)), ("q", "b", 2, angle(25)), ("q", "c", 3, angle(50)), ("q", "d", 4, None), ("p", "b", 1, angle(25))]
    df = spark.createDataFrame(rows, "query_id string, id string, rank int, v array<double>")
    assert {(r.query_id, r.id) for r in fusion.drop_near_copies(df, "v").collect()} == {("q", "a"), ("q", "c"), ("q", "d"), ("p", "b")}
    assert fusion.drop_near_copies(df, "v", s=replace(DEFAULTS, dedup_enabled=False)).count() == 5


def test_vectors(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [0.0, 2.0]), ("c", 1, [0.0, 0.0]), ("d", 2, None), ("e", 2, [1.0]), ("f", 2, [float("nan"), 1.0]), ("g", 1, [-3.0, 0.0])], "id string, g int, v array<float>")
    near = vectors.nearest(df, "id", "v", [1.0, 1.0], 9).collect()
    assert [(r.id, round(r.similarity, 6)) for r in near] == [("a", 0.707107), ("b", 0.707107), ("g", -0.707107)]
    assert vectors.nearest(df, "id", "v", [], 9).count() == 0
    c = {r.g: r.centroid for r in vectors.centroids(df.where("id <> 'f'"), ["g"], "v").collect()}
    assert c[1] == [-0.5, 0.5] and c[2] == [1.0]
    s = replace(DEFAULTS, min_chunks_for_outlier=3)
    assert {r.id for r in vectors.outliers(df.where("g = 1"), "g", "id", "v", s).collect()} == {"a"}
    with pytest.raises(ValueError):
        vector_hits(df.select(F.col("id").alias("chunk_id"), F.col("v").alias("embedding")), df.select(F.col("id").alias("query_id"), F.col("v").alias("vector")), 1, most_queries=2)


ENT = "entity_id string, name string, canonical_name string, entity_type string, description string, source_document_ids array<string>, source_chunk_ids array<string>"
REL = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, description string, weight float"


def test_consolidation_and_merge(spark):
    m = spark.createDataFrame([("1", "Acme", "Acme", "PERSON", "a", ["d"], ["c1"], 1), ("2", "Acme", "Acme", "CONCEPT", "b", None, ["c2"], 2), ("3", "Acme", None, "PRODUCT", "a", ["d"], ["c1", "c3"], 3), ("4", "Other", None, None, None, None, None, 4)], ENT + ", pos int")
    got = {r.name: r for r in entities.consolidate(m, "pos").collect()}
    a = got["Acme"]
    assert (a.entity_id, a.entity_type, a.description, a.source_document_ids, a.source_chunk_ids) == ("1", "CONCEPT", "a | b", ["d"], ["c1", "c2", "c3"])
    stored = spark.createDataFrame([("s", "ACME", "Acme", "EVENT", "old", ["x"], None)], ENT)
    one = {r.name: r for r in entities.merge_entities(stored, entities.consolidate(m, "pos")).collect()}
    assert (one["ACME"].entity_id, one["ACME"].entity_type, one["ACME"].description, one["ACME"].source_document_ids) == ("s", "CONCEPT", "old | a | b", ["d", "x"])
    assert one["Other"].entity_id == "4"
    assert {r.entity_type for r in entities.merge_entities(stored, entities.consolidate(m, "pos"), keep_type=True).where("entity_id = 's'").collect()} == {"EVENT"}


def graph_tables(spark):
    e = spark.createDataFrame([(x, f"N{x}", None, "CONCEPT", None, None, [f"c{x}"]) for x in "ABCDS"], ENT)
    r = spark.createDataFrame([("e1", "A", "B", "T", None, 1.0), ("e2", "B", "C", "T", None, None), ("e3", "A", "A", "T", None, 0.0), ("e4", "C", "X", "T", None, 2.0), ("e5", "B", "A", "T", None, 5.0), ("e6", None, "S", "T", None, 1.0)], REL)
    return e, r


def bfs(rels, start, hops):
    seen, frontier, met = {start}, {start}, []
    for hop in range(1, hops + 1):
        new = set()
        for n in frontier:
            for i, a, b in rels:
                if n in (a, b):
                    met.append((i, hop))
                    new |= {x for x in (a, b) if x not in seen}
        seen |= new
        frontier = new
    return seen, sorted(met)


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_neighbourhood_against_a_model(spark, hops):
    rng = random.Random(hops)
    rels = [(f"r{i}", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for i in range(24)] + [("e3", "n0", "n0")]
    df = spark.createDataFrame([(i, a, b, "T", None, 1.0) for i, a, b in rels], REL)
    nodes, met = graph.neighbourhood(df, spark.createDataFrame([("n0",)], "entity_id string"), hops)
    want = bfs(rels, "n0", hops)
    assert ({r.entity_id for r in nodes.collect()}, sorted((r.relationship_id, r.hop) for r in met.collect())) == want


def test_graph_operators(spark):
    e, r = graph_tables(spark)
    assert [x.entity_id for x in graph.stranded(e, r).collect()] == ["D"]
    assert {x.entity_id for x in graph.connected(e, r).collect()} == set("ABCS")
    g = {(x.a, x.b): x.weight for x in graph.simple_graph(r).collect()}
    assert g == {("A", "B"): 5.0, ("B", "C"): 1.0, ("A", "A"): 1.0, ("C", "X"): 2.0}
    named = {x.relationship_id: (x.source_name, x.target_name) for x in graph.with_names(r, e).collect()}
    assert named["e4"] == ("NC", None) and named["e6"] == (None, "NS") and len(named) == 6
    hits = spark.createDataFrame([("q", "cA", 1), ("q", "cD", 2), ("q", "x", 3), ("q", "cC", 4)], "query_id string, id string, rank int")
    own, edges = graph.entity_context(hits, e, r)
    assert {x.entity_id for x in own.collect()} == {"A", "C"} and {x.relationship_id for x in edges.collect()} == {"e1", "e2", "e3", "e4", "e5"}
    assert {x.relationship_id: x.direct for x in graph.evidence(hits, own, edges).collect()} == {"e1": True, "e3": True, "e5": True, "e2": False, "e4": False}
    assert lookup.entity_by_name(e, "nb").first().entity_id == "B"


def test_mentions_and_endpoints(spark):
    e = spark.createDataFrame([("c", "1", "Acme Corp", 0), ("c", "2", "Acme", 1), ("k", "3", "Acme", 0), ("c", "4", "", 2)], "g string, entity_id string, name string, position int")
    m = spark.createDataFrame([("c", "acme"), ("c", "Acme Corporation"), ("c", ""), ("c", None), ("c", "Zed"), ("k", "the acme group")], "g string, mention string")
    got = {(r.g, r.mention): r.entity_id for r in entities.match_mentions(m, e, "g").collect()}
    assert got == {("c", "acme"): "2", ("c", "Acme Corporation"): "1", ("k", "the acme group"): "3"}
    stored = spark.createDataFrame([("S1", "ACME"), ("S2", "Bee")], "entity_id string, name string")
    extracted = spark.createDataFrame([("x1", "Acme"), ("x2", "bee"), ("x3", "gone")], "entity_id string, name string")
    rels = spark.createDataFrame([("r1", "x1", "x2", "T", None, 1.0), ("r2", "S2", "x1", "T", None, 1.0), ("r3", "x1", "x3", "T", None, 1.0)], REL)
    assert {(r.relationship_id, r.source_entity_id, r.target_entity_id) for r in entities.resolve_endpoints(rels, extracted, stored).collect()} == {("r1", "S1", "S2"), ("r2", "S2", "S1")}


def test_communities_nest_and_cover(spark):
    rng = random.Random(5)
    rows = [(f"n{g}_{a}", f"n{g}_{b}", 1.0) for g in range(4) for a in range(12) for b in range(a) if rng.random() < 0.6] + [("n0_0", "n1_0", 0.1), ("n2_0", "n3_0", 0.1)]
    df = spark.createDataFrame(rows, "a string, b string, weight double")
    found = communities.communities(df, rounds=4, levels=2, s=replace(DEFAULTS, max_community_size=10)).collect()
    top = {r.node: r.cluster for r in found if r.level == 0}
    assert len(top) == len({x for a, b, _ in rows for x in (a, b)}) == sum(r.level == 0 for r in found)
    assert len({top[n] for n in top if n.startswith("n2_")}) == 1 and sorted(set(top.values())) == list(range(len(set(top.values()))))
    inner = {}
    for r in found:
        if r.level == 1:
            inner.setdefault(r.cluster, set()).add(top[r.node])
    assert all(len(v) == 1 for v in inner.values())
    members = {r.community_id: r.entity_ids for r in communities.community_members(spark.createDataFrame(found)).collect()}
    assert members["L0_C0"] == sorted(n for n, c in top.items() if c == 0)


def test_extraction_with_a_model(spark):
    class FakeModel:
        def complete(self, prompt):
            if "relationships" in prompt:
                return '```{"relationships": [{"source": "Acme", "target": "bee", "type": "uses"}, {"source": "", "target": "Bee"}]}```', None
            return ('{"entities": [{"name": "Acme", "type": "Organization"}, {"name": "Bee", "type": "odd"}', None) if "Acme" in prompt else (None, "down")

    chunks = spark.createDataFrame([("c1", "d", "Acme and Bee"), ("c2", "d", "nothing"), ("c3", "d", None)], "chunk_id string, source_document_id string, text string")
    mentions, rels = extract_graph(chunks, ModelExtractor(FakeModel()))
    assert {(r.chunk_id, r.name, r.entity_type) for r in mentions.collect()} == {("c1", "Acme", "ORGANIZATION"), ("c1", "Bee", "CONCEPT")}
    assert [(r.relationship_type, r.weight) for r in rels.collect()] == [("USES", 1.0)] and clean_relationship({"source": "a"}) is None


def test_pruning(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", "t", i, None) for i in range(5)], "chunk_id string, source_document_id string, text string, chunk_index int, metadata map<string,string>")
    vecs = spark.createDataFrame([(f"c{i}", angle(0) if i < 4 else angle(120)) for i in range(5)], "chunk_id string, embedding array<double>")
    e, r = graph_tables(spark)
    replies = spark.createDataFrame([("c0", "0.2"), ("c1", "0.9"), ("c2", None)], "chunk_id string, reply string")
    got = pruning.prune(chunks, vecs, e, r, replies, replace(DEFAULTS, min_chunks_for_outlier=5))
    assert {x.id for x in got.removed.collect()} == {"c0", "c4"}
    assert {x.chunk_id for x in got.chunks.collect()} == {"c1", "c2", "c3"} and {x.entity_id for x in got.entities.collect()} == set("ABCS")


WORDS = "graph engine retrieval community evidence vector ranking passage archive survey station bridge harbour ledger compass".split()


def write_files(folder):
    rng = random.Random(9)
    os.makedirs(f"{folder}/sub dir+x")
    for i in range(4):
        body = " ".join(rng.choice(WORDS) for _ in range(40))
        with open(f"{folder}/sub dir+x/doc{i}.md", "w") as f:
            f.write(f"# Title {i}\n\nAlpha Works met Beta Labs near Gamma Park. {body}.\n\n## Part\n{body} Beta Labs joined Delta Union today.\n")
    open(f"{folder}/empty.txt", "w").close()
    with open(f"{folder}/noise.txt", "w") as f:
        f.write("=" * 80 + " contents")
    with open(f"{folder}/skip.pdf", "w") as f:
        f.write("x" * 100)


def snapshot(store):
    return {t: sorted(map(str, store.read(t).drop("created_at").collect())) for t in ("source_documents", "chunks", "embeddings", "postings", "entities", "relationships", "rejected_chunks")}


def test_ingest_search_and_store(spark, tmp_path):
    write_files(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/store")
    docs = read_documents(spark, f"{tmp_path}/in")
    assert docs.count() == 5 and any("sub dir+x/doc0.md" in r.source_path for r in docs.collect())
    assert read_documents(spark, f"{tmp_path}/none").count() == 0
    stats = ingest.run(store, docs, HashEmbedding(), RuleExtractor())
    assert stats.documents == 5 and stats.chunks == 8 and stats.rejected == 1 and stats.entities == 4 and stats.relationships > 0
    before = snapshot(store)
    ingest.run(store, docs, HashEmbedding(), RuleExtractor())
    assert snapshot(store) == before
    assert {r.pipeline_status for r in store.read("source_documents").collect()} == {"complete"}

    ingest.community_step(store)
    t = Tables(*(store.read(x) for x in ("chunks", "embeddings", "entities", "relationships", "community_summaries")))
    engine = Engine(t, HashEmbedding())
    out = engine.search("bridge harbour compass", "connections", 3).to_dict(3)
    assert 1 <= len(out["chunks"]) <= 3 and out["chunks"][0]["source"].endswith(".md") and out["entities"] and out["evidence"]["directRelationships"]
    assert engine.search("bridge", "KEYWORD_SEARCH", 2).to_dict(2)["entities"] == [] and engine.search("bridge", "explore_thematic").search_type == "explore_thematic"
    assert Engine(t).search("bridge", "keyword").to_dict(2)["chunks"] and engine.search("the", "keyword").to_dict(2)["searchType"] == "keyword_search"
    assert engine.thematic_communities("Alpha Works").count() >= 1
    seen = engine.explore("alpha works", 9)
    assert seen["hops"] == 3 and len(seen["entities"]) == 4 and engine.explore("Zed") == {"error": "Entity 'Zed' not found"}
    own = tools.tools(engine, store)
    assert json.loads(tools.call(own, "get_corpus_stats()"))["chunkCount"] == 8
    assert "error" in json.loads(tools.call(own, "nothing()")) and "chunks" in json.loads(tools.call(own, 'search({"query": "bridge", "topK": 2})'))

    store.move_document(docs.orderBy("source_path").first().source_path, "/moved/x.md")
    assert lookup.by_portable_path(store.read("source_documents"), "C:\\moved\\x.md").count() == 1
    store.delete_chunks(store.read("chunks").orderBy("chunk_id").limit(1).select("chunk_id"))
    assert store.read("chunks").count() == store.read("embeddings").count() == store.read("postings").select("chunk_id").distinct().count() == 7
    assert ingest.prune_step(store) == 0 and store.clear()["chunks"] == 7 and store.read("chunks").count() == 0
    store.create()
    assert store.reset()["chunks"] == 0 and store.vacuum() == 0


def test_stream_ends_like_a_batch(spark, tmp_path):
    write_files(f"{tmp_path}/in")
    a, b = Store(spark, f"{tmp_path}/a"), Store(spark, f"{tmp_path}/b")
    for _ in range(2):
        q = follow_folder(a, f"{tmp_path}/in", f"{tmp_path}/ck", HashEmbedding(), RuleExtractor())
        q.awaitTermination()
    ingest.run(b, read_documents(spark, f"{tmp_path}/in"), HashEmbedding(), RuleExtractor())
    assert snapshot(a) == snapshot(b) and a.read("chunks").count() == 8


def test_rejects_registry_settings_and_command_line(spark, tmp_path, capsys, monkeypatch):
    rows = spark.createDataFrame([("c1", "Entropy too low: 1.00 < 3.0", "xx", {"source": "a"})], "chunk_id string, reason string, text string, metadata map<string,string>")
    write_rejects(rows, f"{tmp_path}/rej")
    assert spark.read.json(f"{tmp_path}/rej").count() == 1
    assert write_viewer(rows, f"{tmp_path}/view") == 1 and json.load(open(f"{tmp_path}/view/pruning.json"))[0]["chunkId"] == "c1"
    assert reject_name("c1", "Entropy too low: 1.00 < 3.0") == "c1_Entropy too low 10.md" and os.path.exists(f"{tmp_path}/view/c1_Entropy too low 10.md")
    reg = Registry(f"{tmp_path}/reg.json", str(tmp_path))
    assert reg.register(" My Notes ").name == "my-notes" and reg.names() == ["my-notes"] and reg.get("My Notes").path == f"{tmp_path}/my-notes/store"
    with pytest.raises(KeyError):
        reg.get("other")
    assert reg.remove("my notes") and not reg.remove("my notes")
    monkeypatch.setenv("GRAPHLOOM_TOP_K", "3")
    monkeypatch.setenv("GRAPHLOOM_DEDUP_ENABLED", "false")
    s = Settings.from_env()
    assert s.top_k == 3 and s.dedup_enabled is False and s.rrf_k == 60

    write_files(f"{tmp_path}/in")
    base = ["--registry", f"{tmp_path}/r.json"]

    def run(*a):
        assert cli.main([*base, *a]) == 0
        return capsys.readouterr().out

    run("register", "n", "--db-path", f"{tmp_path}/s", "--source", f"{tmp_path}/in")
    assert json.loads(run("index", "n", "--prune"))["chunks"] == 8
    assert json.loads(run("search", "n", "--query", "bridge", "-k", "2", "--json"))["chunks"]
    assert json.loads(run("explore", "n", "--entity", "Beta Labs", "--tabular"))["entities"]
    run("communities", "n")
    assert json.loads(run("status", "n"))["tables"]["chunks"] == 8 and run("list").strip() == "n"
    assert cli.main([*base, "delete", "n"]) == 1
    run("delete", "n", "--force", "--files")
    assert not os.path.exists(f"{tmp_path}/s")
