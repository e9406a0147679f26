import io
import math
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from graphloom import cli, session
from graphloom.functions.text import stopwords_of
from graphloom.operators import bm25, communities, vector_index
from graphloom.plans import ingest
from graphloom.plans.search import Engine, Tables, vector_hits_all
from graphloom.sources import files
from graphloom.sources.providers import HashEmbedding, ModelExtractor, RuleExtractor, SpanExtractor, probe
from graphloom.sources.store import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers do not find this file

DOC = "id string, source_path string, raw_content string, pipeline_status string, created_at timestamp"
CHUNK = "chunk_id string, source_document_id string, text string, chunk_index int, metadata map<string,string>"


def documents(spark, n, start=0, folder="/a/in"):
    body = "Alpha Works met Beta Labs near Gamma Park and Delta Union spoke with Alpha Works about the harbour survey"
    return spark.createDataFrame([(f"d{i}", f"{folder}/doc{i}.md", f"{body} in the year of number {i}.", "pending", None) for i in range(start, start + n)], DOC)


def test_versions_survive_crashes_and_rival_writers(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    row = lambda i: spark.createDataFrame([(f"c{i}", "d", f"t{i}", i, None)], CHUNK)
    assert store.read("chunks").count() == 0 and not store.has("chunks")
    store.upsert("chunks", row(1))
    store.upsert("chunks", row(2))
    assert len(store._current("chunks")[1]) == 2  # appended
    store.upsert("chunks", row(2).withColumn("text", F.lit("new")))
    assert len(store._current("chunks")[1]) == 1 and {r.text for r in store.read("chunks").collect()} == {"t1", "new"}
    open(f"{tmp_path}/s/chunks/_v000000000099", "w").write("half a li")  # a writer that died
    assert store.read("chunks").count() == 2
    store.append("chunks", row(3))
    assert store._current("chunks")[0] == 100 and store.read("chunks").count() == 3
    with pytest.raises(RuntimeError):
        store._publish("chunks", ["x"], 3)
    store.write("chunks", store.read("chunks").where("chunk_id <> 'c1'"))
    assert store.vacuum() == 4 and store.read("chunks").count() == 2
    for i in range(4, 8):
        store.append("chunks", row(i))
    assert store.vacuum(many=3) >= 5 and len(store._current("chunks")[1]) == 1 and store.read("chunks").count() == 6


def test_status_and_path_lie_over_the_contents(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.upsert_documents(documents(spark, 3))
    parts = store._current("source_documents")
    store.set_status(spark.createDataFrame([("d1",)], "id string"), "chunked")
    store.move_document("/a/in/doc1.md", "/b/doc1.md")
    store.set_status(spark.createDataFrame([("d1",), ("d2",)], "id string"), "embedded")
    assert store._current("source_documents") == parts
    assert {(r.id, r.pipeline_status, r.source_path) for r in store.statuses().collect()} == {("d0", "pending", "/a/in/doc0.md"), ("d1", "embedded", "/b/doc1.md"), ("d2", "embedded", "/a/in/doc2.md")}
    store.delete("source_documents", spark.createDataFrame([("d1",)], "id string"))
    assert store.read("document_status").count() == 1 and store.read("source_documents").count() == 2


class Model:
    """Answers for joint and single prompts; fails where it is told to."""

    def __init__(self, log, broken=""):
        self.log, self.broken = log, broken

    def complete(self, prompt):
        with open(self.log, "a") as f:
            f.write(("joint" if "### TEXT 0" in prompt else "relations" if "relationships" in prompt else "single") + "\n")
        if self.broken and self.broken in prompt:
            return None, "TimeoutError: no answer"
        if "relationships" in prompt:
            return '{"relationships": [{"source": "Alpha Works", "target": "Beta Labs", "type": "met"}]}', None
        one = '{"entities": [{"name": "Alpha Works", "type": "ORGANIZATION"}, {"name": "Beta Labs", "type": "x"}]}'
        if "### TEXT 0" in prompt:
            n = prompt.count("### TEXT")
            return "{" + ", ".join(f'"{i}": {one}' for i in range(n) if i != 2) + "}", None  # leaves one out
        return one, None


def test_joint_prompts_and_failures(spark, tmp_path):
    log = f"{tmp_path}/log"
    got = ModelExtractor(Model(log)).extract([f"text {i}" for i in range(6)])
    assert all(len(g["entities"]) == 2 and len(g["relationships"]) == 1 and not g["error"] for g in got)
    calls = open(log).read().split()
    assert calls.count("joint") == 2 and calls.count("single") == 1 and calls.count("relations") == 6
    got = ModelExtractor(Model(log, "text 5")).extract([f"text {i}" for i in range(8)])
    assert [bool(g["error"]) for g in got] == [False] * 4 + [True] * 4

    spans = lambda text, labels, threshold: [{"text": "Alpha  Works", "label": "Organization", "score": 0.9}, {"text": "alpha works", "label": "Person", "score": 0.6}, {"text": "x", "label": "Person", "score": 1.0}, {"text": "Low", "label": "Person", "score": 0.1}] if text else 1 / 0
    found = SpanExtractor(spans).extract(["some", ""])
    assert [(e["name"], e["type"]) for e in found[0]["entities"]] == [("Alpha Works", "ORGANIZATION")] and "ZeroDivisionError" in found[1]["error"]
    assert len(SpanExtractor(spans, model=Model(log)).extract(["some"])[0]["relationships"]) == 1
    assert probe(Model(log), HashEmbedding()) == {"text": "ok", "embedding": "ok"} and "no answer" in probe(Model(log, "word ok"))["text"]


def test_documents_of_failed_extractions_stay_open(spark, tmp_path):
    store, log = Store(spark, f"{tmp_path}/s"), f"{tmp_path}/log"
    ingest.run(store, documents(spark, 5), HashEmbedding(), ModelExtractor(Model(log, "number 3"), together=1))
    status = lambda: {r.id: r.pipeline_status for r in store.statuses().collect()}
    assert status() == {f"d{i}": "embedded" if i == 3 else "complete" for i in range(5)}
    chunks = store._current("chunks")
    ingest.run(store, documents(spark, 5), HashEmbedding(), ModelExtractor(Model(log), together=1))
    assert set(status().values()) == {"complete"} and store._current("chunks") == chunks
    assert {r.name for r in store.read("entities").collect()} == {"Alpha Works", "Beta Labs"} and store.read("relationships").count() == 5


def test_moved_files_are_known_again(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert ingest.add_documents(store, documents(spark, 3)) == 3
    moved = documents(spark, 4, folder="/mnt/other/in").withColumn("id", F.concat(F.lit("new-"), "id"))
    for _ in range(2):
        assert ingest.add_documents(store, moved) == 4
        assert {(r.id, r.source_path) for r in store.statuses().collect()} == {*((f"d{i}", f"/mnt/other/in/doc{i}.md") for i in range(3)), ("new-d3", "/mnt/other/in/doc3.md")}


def vectors(spark, n, seed=2):
    rng = random.Random(seed)
    rows = [(f"v{i:05d}", [rng.gauss(math.sin(i % 17 + j), 0.5) for j in range(16)]) for i in range(n)]
    return spark.createDataFrame([*rows, ("null", None), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("short", [1.0, 2.0])], "chunk_id string, embedding array<float>")


def test_indexed_vectors_find_what_a_scan_finds(spark):
    e = vectors(spark, 3000)
    leaves = vector_index.fit_leaves(e).cache()
    index = vector_index.in_leaves(e, leaves).cache()
    assert index.count() == 3000 and leaves.count() > 40 and leaves.first().probes < leaves.count()
    q = vectors(spark, 60, 5).where("chunk_id <> 'short'").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = {(r.query_id, r.id) for r in vector_hits_all(e, q, 10).collect()}
    got = {(r.query_id, r.id) for r in vector_index.indexed_hits(index, leaves, q, 10).collect()}
    assert len(want) == 600 and len(got & want) / len(want) >= 0.9 and len(got) == 600
    whole = {(r.query_id, r.id) for r in vector_index.indexed_hits(index, leaves, q, 10, leaves.count()).collect()}
    assert whole == want
    assert vector_index.fit_leaves(e.limit(0)).count() == 0 and vector_index.indexed_hits(index.limit(0), leaves, q, 3).count() == 0
    assert vector_index.indexed_hits(index, leaves.limit(0), q, 3).count() == 0


def test_search_over_stored_indexes_is_search_over_texts(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    ingest.run(store, documents(spark, 12), HashEmbedding(), RuleExtractor())
    ingest.run(store, documents(spark, 30), HashEmbedding(), RuleExtractor())
    t = Tables.of(store)
    assert t.postings is not None and t.vector_index.count() == 30
    plain = Tables(t.chunks, t.embeddings, t.entities, t.relationships)
    q = spark.createDataFrame([("q1", "harbour number 7"), ("q2", "survey 21 survey"), ("q3", "absent")], "query_id string, text string")
    q = q.withColumn("vector", F.array(*[F.lit(float(x)) for x in HashEmbedding().embed(["harbour survey number 7"])[0]]))
    show = lambda e: sorted((r.query_id, r.id, round(r.fused_score, 9), r["rank"]) for r in e.hybrid(q, 5).collect())
    assert show(Engine(t)) == show(Engine(plain)) and len(show(Engine(t))) == 15
    terms = bm25.query_terms(q, "query_id", "text")
    one = bm25.scores(*bm25.matching(t.chunks, "chunk_id", "text", terms), terms)
    other = bm25.scores(bm25.postings(t.chunks, "chunk_id", "text"), bm25.corpus_stats(t.chunks, "text"), terms)
    assert sorted((r.query_id, r.id, round(r.score, 9)) for r in one.collect()) == sorted((r.query_id, r.id, round(r.score, 9)) for r in other.collect())

    class Broken(HashEmbedding):
        def embed(self, texts):
            raise OSError("down")

    with pytest.raises(OSError):
        Engine(t, Broken()).keyword("harbour")
    assert Engine(t, Broken(), strict=False).keyword("harbour").to_dict(3)["chunks"]
    bad = q.select("query_id", "text", F.array(F.raise_error(F.lit("bad vector")).cast("double")).alias("vector"))
    assert Engine(plain, strict=False).hybrid(bad, 3).count() > 0
    ingest.community_step(store, model=Model(f"{tmp_path}/log"), embedding=HashEmbedding())
    rows = store.read("community_summaries").collect()
    assert rows and all(len(r.summary_embedding) == 64 and r.summary.startswith('{"entities"') for r in rows)
    found = Engine(Tables.of(store), HashEmbedding()).overview("Alpha Works", 3)["communities"]
    assert found and found[0]["summary"]


def test_two_coloured_graphs_settle(spark):
    rows = [(f"a{i}", f"b{j}", 1.0) for i in range(5) for j in range(5)] + [("x", "y", 1.0), ("y", "z", 1.0)]
    labels = {r.node: r.label for r in communities.settled_labels(spark.createDataFrame(rows, "a string, b string, weight double")).collect()}
    assert len({labels[n] for n in labels if n[0] in "ab"}) == 1 and len({labels[n] for n in "xyz"}) == 1 and labels["x"] != labels["a0"]


def test_files_languages_folders_and_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.md").write_text("Alpha Works met Beta Labs near Gamma Park. " * 3)
    (tmp_path / "in" / "empty.txt").write_text("")
    (tmp_path / "in" / "bad.txt").write_bytes(b"caf\xe9 " * 20)
    (tmp_path / "notes.log").write_text("Delta Union spoke with Alpha Works about the harbour for a long while.")
    assert {(r.source_path.split("/")[-1], r.reason) for r in files.unreadable(spark, f"{tmp_path}/in").collect()} == {("empty.txt", "empty"), ("bad.txt", "not UTF-8")}
    assert "und" in stopwords_of("de-AT") and "the" in stopwords_of("xx") and "les" in stopwords_of("FR")

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Cluster())
    df = session.stage(spark.range(3))
    session.unstage(df)
    with session.staging():
        inner = session.stage(spark.range(4))
        assert inner.count() == 4
    assert not [p for _, p in session._STAGED if p in (df._staged_at, inner._staged_at)]

    base = ["--registry", f"{tmp_path}/r.json"]

    def run(*a, code=0):
        assert cli.main([*base, *a]) == code
        return capsys.readouterr().out

    run("register", "n", "--db-path", f"{tmp_path}/s", "--source", f"{tmp_path}/in")
    assert '"unreadable": {"empty": 1, "not UTF-8": 1}' in run("index", "n", "--language", "en", "--extraction-mode", "rules").replace('"not UTF-8": 1, "empty": 1', '"empty": 1, "not UTF-8": 1')
    assert '"chunks": 2' in run("index", "n", "--file", f"{tmp_path}/notes.log")
    run("index", "n", "--extraction-mode", "model", code=1)
    run("communities", "n")
    assert "entities" in run("search", "n", "--query", "Alpha Works", "--type", "communities") and run("search", "n", "--query", "harbour", "--lenient")
    assert '"embedding": "ok"' in run("probe")
    monkeypatch.setattr("sys.stdin", io.StringIO('get_corpus_stats()\n\nsearch({"query": "harbour", "topK": 1})\n'))
    lines = run("start", "n").strip().splitlines()
    assert len(lines) == 2 and '"chunkCount":2' in lines[0].replace(" ", "")
