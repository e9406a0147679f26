import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions.jsontools import compact, repair_json, strip_nulls, tabular
from graphloom.functions.text import header_sections, normalize_text, strip_outer, tokenize
from graphloom.operators import bm25
from graphloom.operators.chunking import chunk_documents, windows
from graphloom.operators.quality import judge, quality_metrics, quality_score

SPLITS = [
    ("a" * 1500, [(0, 1000), (800, 1500), (1300, 1500)]),
    ("a" * 1001, [(0, 1000), (800, 1001), (801, 1001)]),
    ("x" * 700 + "? " + "y" * 100 + ". " + "z" * 400, [(0, 804), (604, 1204), (1004, 1204)]),
    ("x" * 600 + "\n\n" + "y" * 300 + ". " + "z" * 400, [(0, 602), (402, 1304), (1104, 1304)]),
]


@pytest.mark.parametrize("text, spans", SPLITS)
def test_windows_of_long_sections(text, spans):
    assert windows(text, 1000, 200, 50) == [text[a:b].strip() for a, b in spans]


def test_chunks_keep_fitting_sections_and_drop_short_ones(spark):
    long = "w" * 1001
    text = "# Head\n" + "a" * 60 + "\n\n\n\n\n## Next [[Page 3 STAT. 4]]\n" + "b" * 43 + "\n#x no header\n### tiny\n" + "c" * 3 + "\n# " + long
    docs = spark.createDataFrame([("d", "/v/a.md", text), ("n", "/v/n.md", None), ("e", None, ""), ("f", "/v/f.md", "d" * 1000), ("g", "/v/g.md", "e" * 49)], "id string, source_path string, raw_content string")
    rows = chunk_documents(docs).orderBy("source_document_id", "chunk_index").collect()
    own = [r.text for r in rows if r.source_document_id == "d"]
    assert own[0] == "# Head\n" + "a" * 60 and own[1] == "## Next \n" + "b" * 43 + "\n#x no header" and own[2:] == ["# " + "w" * 998, "w" * 203, "w" * 200][: len(own) - 2]
    assert [r.text for r in rows if r.source_document_id == "f"] == ["d" * 1000]
    assert {r.source_document_id for r in rows} == {"d", "f"}
    assert len({r.chunk_id for r in rows}) == len(rows) and rows[0].metadata == {"source": "/v/a.md"}


def model_sections(text):
    out, now = [], []
    for i, line in enumerate(text.split("\n")):
        bare = line.lstrip()
        if i and re.match("#{1,6} ", bare):
            out.append("\n".join(now))
            now = []
        now.append(line)
    return [*out, "\n".join(now)]


def test_header_sections_against_a_model(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["#", "## ", " ", "\n", "\n", "a", "\t", "\u3000", "\x85", "####### ", "\n# "]) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", header_sections(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.s == model_sections(r.t)


QUALITY = [
    ("=" * 60 + " Table of Contents", (0.8, 1.5781, 0, 0.0385), "Repetition too high: 0.80 > 0.4"),
    ("abab cdcd abab cdcd abab cdcd abab cdcd abab cdcd abab", (0.2727, 2.3161, 0, 0.1852), "Entropy too low: 2.32 < 3.0"),
    ("".join(chr(0x4E00 + i) for i in range(200)), (0.005, 7.6439, 0, 0), "Entropy too high: 7.64 > 7.0"),
    ("The af filiation of five of flat of firm offices moved quickly today", (0.1786, 3.8661, 0.3077, 0.1765), "Malformed text: 0.31 > 0.05"),
    (" ".join("abcdefghijklmnopqrstuvwxyz"), (0.0385, 3.396, 0, 0.4902), "Whitespace too dense: 0.49 > 0.3"),
    ("The quick brown fox jumps over the lazy dog near the river bank.", (0.1154, 4.3687, 0, 0.1875), None),
]


def test_quality_goldens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(QUALITY)] + [(90, None), (91, "")], "i int, text string")
    got = {r.i: r for r in quality_metrics(df, "text").collect()}
    for i, (_, want, _) in enumerate(QUALITY):
        assert [round(got[i][c], 4) for c in ("repetition", "entropy", "malformed", "whitespace")] == list(want)
    reasons = {r.i: r.reason for r in judge(df, "text").collect()}
    assert [reasons[i] for i in range(len(QUALITY))] == [w for _, _, w in QUALITY]
    assert got[90].entropy == 0 and reasons[91] == "Entropy too low: 0.00 < 3.0"


def test_scorer_replies(spark):
    df = spark.createDataFrame([("0.83 fine",), ("about 7",), ("none",), (None,), ("-0.5",)], "r string")
    assert [r[0] for r in df.select(quality_score(F.col("r"))).collect()] == [0.83, 1.0, 1.0, 1.0, 0.0]


def test_tokens_and_normal_form(spark):
    df = spark.createDataFrame([("Été the A1 中文b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tokenize(F.col("t"))).collect()] == [["a1", "中", "文"], [], []]
    df = spark.createDataFrame([("a[[Page 1 STAT. 22]]\n\n\n\nb       c",)], "t string")
    assert df.select(normalize_text(F.col("t"))).first()[0] == "a\n\nb    c"
    assert spark.createDataFrame([("\u00a0 x\u3000",)], "t string").select(strip_outer(F.col("t"))).first()[0] == "x"


def test_bm25_goldens(spark):
    docs = spark.createDataFrame([("d1", "spark spark graph"), ("d2", "graph search"), ("d3", "vector search index")], "id string, text string")
    q = spark.createDataFrame([("a", "graph search"), ("b", "graph graph"), ("c", "nothing here"), ("d", None)], "qid string, text string")
    got = {(r.query_id, r.id): round(r.score, 6) for r in bm25.search(docs, "id", "text", q, "qid", "text", 10, stopwords=[]).collect()}
    assert got == {("a", "d1"): 0.444974, ("a", "d2"): 1.059163, ("a", "d3"): 0.444974, ("b", "d1"): 0.889948, ("b", "d2"): 1.059163}
    one = spark.createDataFrame([("c", "Unique test content about knowledge and citations.")], "id string, text string")
    hit = bm25.search(one, "id", "text", spark.createDataFrame([("q", "knowledge")], "qid string, text string"), "qid", "text", 5).first()
    assert round(hit.score, 6) == 0.287682
    assert bm25.search(docs.limit(0), "id", "text", q, "qid", "text", 10).count() == 0


def test_json_repair():
    assert repair_json('{"entities": [{"name": "A"}, {"na') == {"entities": [{"name": "A"}]}
    assert repair_json('<think>no {"x": 1}</think>```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]}
    assert repair_json('so: {"name": ": "A"} end') == {"name": "A"} and repair_json('{"name":: "A"}') == {"name": "A"}
    assert repair_json('[{"a": "x, y"}, {"b": "open') == [{"a": "x, y"}] and repair_json("plain") is None and repair_json(None) is None


def test_tabular_and_compact():
    two = [{"a": 1}, {"a": 2}]
    assert tabular(two) == two
    assert tabular([{"a": 1}, {"a": 2, "b": "x"}, {"a": 3}]) == {"format": "tson", "schema": ["a:int", "b:str"], "data": [[1, None], [2, "x"], [3, None]]}
    assert tabular([{"a": True}, {"a": None}, {"b": 1.5}])["schema"] == ["a:bool", "b:float"]
    assert strip_nulls({"a": None, "b": [1, None, {"c": None}]}) == {"b": [1, {}]}
    assert compact({"x": [{"a": 1}, {"a": 2}, {"a": 3}], "n": None}) == '{"x":{"format":"tson","schema":["a:int"],"data":[[1],[2],[3]]}}'
    assert compact({"x": object()}).startswith('{"error"')
