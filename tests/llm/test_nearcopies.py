import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import nearcopies as nc


def jaccard(a, b, n=3):
    s, t = ({tuple(x.split()[i : i + n]) for i in range(len(x.split()) - n + 1)} for x in (a, b))
    return len(s & t) / len(s | t)


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(25, 60))]
        for v in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.choice(["q1", "q2"]), f"k{g}_{v}", " ".join(w)))
    return rows


def brute(rows, threshold):
    from itertools import combinations

    out = set()
    for (s, k, t), (s2, k2, t2) in combinations(rows, 2):
        if s == s2 and k != k2 and jaccard(t, t2) >= threshold:
            out.add((s, *sorted((k, k2))))
    return out


def test_pairs_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(s, k, t.upper().replace(" ", ", "), 1) for s, k, t in rows], "q string, k string, text string, tid int")
    got = [tuple(r) for r in nc.similar_pairs(nc.text_rows(df, F.col("q"), "k", "text", 20), 3, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.5)


def test_null_short_repeated_copied_and_long_texts(spark):
    long = " ".join(f"a{i % 700} b{i}" for i in range(30000))
    words = " ".join(f"x{i}" for i in range(30))
    rows = [("s", "a", words), ("s", "a", words), ("s", "b", words.upper()), ("s", "c", None), ("s", "d", ""), ("s", "e", "too short"), ("s", None, words), (None, "f", words), ("s", "g", long), ("s", "h", long + " end")]
    rows += [("s", f"z{i}", "same " * 25) for i in range(12)]
    df = spark.createDataFrame(rows, "q string, k string, text string")
    t = nc.text_rows(df, F.col("q"), "k", "text", 20)
    got = {tuple(r) for r in nc.similar_pairs(t, 3, 0.5).collect()}
    assert {g for g in got if g[1][0] != "z"} == {("s", "a", "b"), ("s", "g", "h")} and len(got) == 2 + 66
    groups = {r.key: r for r in nc.similar_groups(t, 3, 0.5).collect()}
    assert groups["z3"].copies == 12 and groups["z3"].links == 0 and groups["g"].links == 1 and len(groups) == 16
    assert nc.similar_pairs(nc.text_rows(df.limit(0), F.col("q"), "k", "text", 20), 3, 0.5).count() == 0


def test_odd_sketch_estimates(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    other = list(base)
    for i in range(0, 400, 16):
        other[i] = f"v{i}"
    flat, ends = nc.shingle_sets([" ".join(base), " ".join(other)], 3)
    odd = nc.odd_sketches(nc.min_samples(flat, ends, nc.ROWS * nc.BANDS), nc.SKETCH_BITS)
    z = int(np.unpackbits((odd[0] ^ odd[1]).view("u1")).sum())
    df = spark.createDataFrame([([int(x) for x in odd[0].view("i8")], [int(x) for x in odd[1].view("i8")])], "a array<long>, b array<long>")
    est = df.select(nc.odd_estimate(F.col("a"), F.col("b"))).first()[0]
    assert z > 0 and abs(est - jaccard(" ".join(base), " ".join(other))) < 0.15


def test_shared_boilerplate_proposes_few_pairs_and_loses_none(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(4000)]
    letterhead = [f"h{i}" for i in range(45)]
    rows = []
    for i in range(240):
        own = [rng.choice(vocab) for _ in range(45)]
        rows.append((f"q{i % 2}", f"k{i:03d}", " ".join(letterhead + own)))
        if i % 8 == 0:
            own[rng.randrange(45)] = "edited"
            rows.append((f"q{i % 2}", f"e{i:03d}", " ".join(letterhead + own)))
    t = nc.text_rows(spark.createDataFrame(rows, "q string, k string, text string"), F.col("q"), "k", "text", 20)
    want = brute(rows, 0.5)
    n = {hot: nc.candidate_pairs(t, 3, 0.5, hot).count() for hot in (10, 10**9)}
    assert n[10] < 1000 < 5000 < n[10**9]
    for hot in (10, 10**9):
        assert {tuple(r) for r in nc.similar_pairs(t, 3, 0.5, hot).collect()} == want and len(want) == 30
    plain = nc.text_rows(spark.createDataFrame(corpus(), "q string, k string, text string"), F.col("q"), "k", "text", 20)
    assert {tuple(r) for r in nc.similar_pairs(plain, 3, 0.5, 1).collect()} == brute(corpus(), 0.5)
