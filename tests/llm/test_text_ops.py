import os
import random

import pytest

from graphloom.llm.encoding import TOKENIZERS, ForcedEncoder, encode_texts
from graphloom.llm.leakage import ItemAutomaton, contaminated, item_parts, leaked_spans, removed_spans, without_leaks, word_places, words
from graphloom.llm.spans import segments, shared_amount, shared_spans
from graphloom.llm.terms import characteristic_terms, residual_idf

VOCAB = f"{TOKENIZERS}/byte_bpe_50k"
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB + ".json"), reason="no vocabulary files")


def odd_texts(n):
    rng = random.Random(1)
    al = ["a", "b", " ", "  ", "\n", "\t", " ", "　", "é", "中", "😀", "'s", "'", "!", "1", "<|endoftext|>", "\r\n", "\x1c", "\x85", "don't"]
    out = ["".join(rng.choice(al) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + ["x" * 9000, "ab1!" * 3000, "中" * 6000, "".join(rng.choice(al) for _ in range(20000)), " ", "\n\n "]


@needs_vocab
def test_forced_boundaries_give_the_ids_of_the_public_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB + ".json")
    t.encode_special_tokens = True
    texts = odd_texts(1500)
    enc = ForcedEncoder(VOCAB + ".tiktoken")
    got = [enc.encode(x) for x in texts]
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [enc.bpe.decode(x) for x in got] == texts
    assert (ord("a"), ord(" ")) not in enc.inner and enc.border is not None


@needs_vocab
def test_encoding_of_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "Hi there", "z"), (3, "Hi there", "z"), (None, "x", "z")], "doc_id long, text string, ids string")
    rows = sorted(map(str, encode_texts(df, "doc_id", "text").collect()))
    assert rows == ["Row(doc_id=1, ids=[])", "Row(doc_id=2, ids=[])", "Row(doc_id=3, ids=[17250, 612])", "Row(doc_id=3, ids=[17250, 612])", "Row(doc_id=None, ids=[87])"]
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        items = {k: [rng.choice("abc") for _ in range(rng.randint(0, 14))] for k in range(4)}
        least = rng.randint(1, 4)
        m = ItemAutomaton(items, least)
        doc = [rng.choice("abcd") for _ in range(30)]
        has = lambda seq, run: any(seq[i : i + len(run)] == run for i in range(len(seq) - len(run) + 1))
        got = {e: (n, set(f)) for e, n, f in m.matches(doc)}
        for e in range(len(doc)):
            n = max([n for n in range(e + 2) if any(has(s, doc[e + 1 - n : e + 1]) for s in items.values())], default=0)
            if n < least:
                assert e not in got
            else:
                assert got[e] == (n, {k for k, s in items.items() if has(s, doc[e + 1 - least : e + 1])})


def test_leaks_nulls_blocks_and_clashing_columns(spark):
    text = "The quick brown fox jumps over the lazy dog near the river bank"
    items = spark.createDataFrame([(1, text, None), (2, "Fox, jumps; over the LAZY dog near the river bank!", "q"), (3, None, "q"), (4, "", None), (None, text, None)], "item_id long, text string, task string")
    docs = spark.createDataFrame([(10, f"x {text.upper()} y", "a"), (11, "jumps over the lazy dog near the river bank", "a"), (12, None, "a"), (13, "", "a"), (13, f"word {text}" + " filler" * 5000, "a"), (13, f"word {text}" + " filler" * 5000, "a")], "doc_id long, text string, item_id string")
    for size in (10**6, 12):
        got = {(r.doc_id, r.item_id) for r in leaked_spans(docs, items, max_words=size).collect()}
        assert got == {(10, 1), (10, 2), (13, 1), (13, 2)}
    assert [r.doc_id for r in contaminated(leaked_spans(docs, items)).collect()] == [10]
    assert leaked_spans(docs.limit(0), items).count() == 0 and leaked_spans(docs, items.limit(0)).count() == 0
    assert words("Ab-c9K") == ["ab", "c9k"]


def test_credit_of_each_item_against_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        items = {k: [rng.choice("abc") for _ in range(rng.randint(0, 14))] for k in range(4)}
        least = rng.randint(1, 3)
        doc = [rng.choice("abcd") for _ in range(30)]
        has = lambda seq, run: any(seq[i : i + len(run)] == run for i in range(len(seq) - len(run) + 1))
        want = set()
        for e in range(len(doc)):
            for k, s in items.items():
                n = max([n for n in range(e + 2) if has(s, doc[e + 1 - n : e + 1])], default=0)
                if n >= least:
                    want.add((e, k, n))
        assert set(ItemAutomaton(items, least).credits(doc)) == want


def test_blocks_of_items_do_not_change_what_is_removed(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eta", "theta"])
    own = [" ".join(word() for _ in range(n)) for n in (30, 40, 15, 60, 2500)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(own)] + [(9, own[0])], "item_id long, text string")
    docs = [(k, " Start. ".join(" ".join(rng.choice(own).split()[(a := rng.randint(0, 12)) : a + rng.randint(8, 40)]).title() + ", own words" * rng.randint(0, 30) for _ in range(3))) for k in range(60)]
    df = spark.createDataFrame([*docs, (70, None), (71, own[4]), (72, "İ" * 5 + own[1])], "doc_id long, text string")
    one, many = leaked_spans(df, items), leaked_spans(df, items, max_words=90)
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(contaminated(one)) == rows(contaminated(many)) and one.count() > 30
    assert rows(removed_spans(one).drop("text_hash")) == rows(removed_spans(many).drop("text_hash"))
    cleaned = {r.doc_id: r.text for r in without_leaks(df, one).collect()}
    gone = {(r.doc_id, r.whole, r.start, r.end) for r in removed_spans(one).collect()}
    for k, t in [*docs, (72, "İ" * 5 + own[1])]:
        cuts = sorted((a, b) for d, whole, a, b in gone if d == k)
        if any(whole for d, whole, _, _ in gone if d == k):
            assert k not in cleaned
        else:
            left, at = [], 0
            for a, b in cuts:
                left.append(t[at:a])
                at = b
            assert cleaned[k] == " ".join([*left, t[at:]])
    assert cleaned[70] is None and 71 not in cleaned


def test_parts_and_places():
    seq = [str(i) for i in range(25)]
    got = item_parts(seq, 10, 4)
    assert all(len(p) <= 10 for p in got) and got[0] == seq[:10] and got[-1][-1] == "24"
    assert all(any(seq[i : i + 4] == p[j : j + 4] for p in got for j in range(len(p) - 3)) for i in range(22))
    assert word_places("İst İx ab") == [(0, 1), (1, 3), (4, 5), (5, 6), (7, 9)]


def brute_spans(docs, n):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            where.setdefault(t[i : i + n], set()).add(d)
    out = {}
    for d, t in docs:
        hit = {i + j for i in range(len(t or "") - n + 1) if len(where[t[i : i + n]]) > 1 for j in range(n)}
        if hit:
            out[d] = len(hit)
    return out


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab 😀") for _ in range(120)) for _ in range(6)]
    docs = []
    for k in range(60):
        t = "".join(rng.choice(base)[rng.randint(0, 60) :][: rng.randint(5, 90)] for _ in range(rng.randint(0, 4)))
        docs.append((k, t))
    docs += [(100, None), (101, ""), (102, "a" * 500), (103, "b" + "a" * 300), (104, "a" * 20), *[(200 + i, base[0]) for i in range(20)]]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, seg int")
    for n in (20, 31):
        assert {r.doc_id: r.shared_chars for r in shared_amount(df, "doc_id", "text", n).collect()} == brute_spans(docs, n)
    again = df.unionByName(df.where("doc_id = 7"))
    assert {r.doc_id: r.shared_chars for r in shared_amount(again, "doc_id", "text", 20).collect()} == brute_spans(docs, 20)
    assert shared_spans(df.limit(0), "doc_id", "text", 20).count() == 0
    two = spark.createDataFrame([(1, base[0]), (1, base[1][:30]), (2, base[0] + "z"), (3, base[1][:25])], "doc_id long, text string")
    assert {r.doc_id: r.shared_chars for r in shared_amount(two, "doc_id", "text", 20).collect()} == {1: len(base[0]) + 25, 2: len(base[0]), 3: 25}


def test_long_texts_in_slices(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcd") for _ in range(900))
    first, last, _, _ = segments(text, 20, 9)
    assert first[0] == 0 and last[-1] == len(text) - 20 and (first[1:] == last[:-1] + 1).all() and (last - first < 9).all()
    docs = [(1, text), (2, text[100:400] + "x" + text[450:]), (3, "y" * 70 + text[300:340])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (7, 64, 10**6):
        assert {r.doc_id: r.shared_chars for r in shared_amount(df, "doc_id", "text", 20, most).collect()} == brute_spans(docs, 20)


def test_terms_of_null_empty_repeated_and_tied_records(spark):
    rows = [("a", "abracadabra Abracadabra-abracadabra short"), ("a", "abracadabra Abracadabra-abracadabra short"), ("b", None), ("c", ""), (None, "abracadabra " * 9), ("d", "commonterm " * 3), *[(f"e{i}", "commonterm") for i in range(5)], ("f", "verylongterm " * 20000)]
    df = spark.createDataFrame(rows, "chunk_id string, text string").selectExpr("*", "1 as tf", "2 as df")
    s = residual_idf(df, "chunk_id", "text", 9)
    assert {(r.id, r.term) for r in characteristic_terms(s).collect()} == {("a", "abracadabra"), ("f", "verylongterm")}
    by = {(r.id, r.term): r for r in s.collect()}
    assert by["d", "commonterm"].df == 6 and by["f", "verylongterm"].ridf > by["a", "abracadabra"].ridf > by["d", "commonterm"].ridf
    assert residual_idf(df.limit(0), "chunk_id", "text", 9).count() == 0
