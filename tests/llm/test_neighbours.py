import numpy as np
import pytest

from graphloom.llm import neighbours as nb

W = 8
BRANCHES_AT_A_TIE = 8  # leaves below one node may be reached in any order


def exact(rows, k):
    """Neighbour pairs by brute force over (id, vector)."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == W and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v) / np.linalg.norm(v)
    ids = sorted(good)
    m = np.array([good[i] for i in ids]).reshape(-1, W).astype("f4").astype("f8")
    out = set()
    for r, i in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != r), key=lambda j: (-round(float(m[r] @ m[j]), 12), ids[j]))
        out |= {tuple(sorted((i, ids[j]))) for j in order[:k]}
    return out


def pairs(spark, rows, k=10, **options):
    df = spark.createDataFrame(rows, "id string, v array<double>").selectExpr("id as key", "v as sim", "1 as rank", "'x' as other")
    return {tuple(r) for r in nb.neighbour_pairs(nb.nearest_neighbours(df, "key", "sim", W, k, **options)).collect()}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, W))
    return [(f"v{i:05d}", (centres[i % 12] + rng.normal(size=W) * 0.5).tolist()) for i in range(n)]


def test_dirty_vectors_ties_copies_and_repeats(spark):
    rows = clustered(40, 1)
    rows += [(f"same{i:02d}", [float(x) for x in range(1, 9)]) for i in range(30)] + [("scaled", [float(x) for x in range(2, 17, 2)])]
    rows += rows[:5] + [("a", None), ("b", []), ("c", [0.0] * W), ("d", [float("nan")] + [1.0] * 7), ("e", [1.0] * 9), ("f", [None] + [1.0] * 7), (None, [1.0] * W), ("g", [float("inf")] * W)]
    assert pairs(spark, rows) == exact(rows, 10)


@pytest.mark.parametrize("n", [0, 1, 4])
def test_few_vectors_have_all_others(spark, n):
    rows = clustered(n, 2)
    assert pairs(spark, rows) == exact(rows, 10)


def test_recall_against_brute_force_over_many_cells(spark):
    rows = clustered(1500, 3) + [(f"x{i:03d}", [9.0] + [0.1] * 7) for i in range(300)]
    got, want = pairs(spark, rows, leaf_rows=25, cell_rows=200), exact(rows, 10)
    assert len(got & want) / len(want) > 0.98


def test_large_leaf_is_split_over_cells():
    first, many = nb._cells({0: 10, 1: 95, 2: 10, 3: 15, 4: 20}, 5, 30)
    assert many.tolist() == [1, 4, 1, 1, 1] and first.tolist() == [0, 1, 5, 5, 6]


def test_subtrees_and_copies_of_cells(spark, monkeypatch):
    monkeypatch.setattr(nb, "TOP", 6)
    monkeypatch.setattr(nb, "PER_LEAF", 8)
    rows = clustered(1500, 4)
    got, want = pairs(spark, rows, sample=200, leaf_rows=20, cell_rows=200, cell_queries=150), exact(rows, 10)
    assert len(got & want) / len(want) > 0.97


def test_grafted_tree_keeps_every_leaf():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, W))
    top = nb.Tree(x, 5)
    leaf = top.assign(x.astype("f4"))
    whole = top.graft({v: nb.Tree(x[leaf == v], 4, seed=v) for v in range(top.leaves) if v != 2})
    assert sorted(v for v in whole.leaf_of if v >= 0) == list(range(whole.leaves)) and whole.leaves > 3 * top.leaves
    assert set(whole.assign(x.astype("f4"))) == set(range(whole.leaves))
    assert sorted(whole.best_bins(whole.distances(x[:1])[0], 10**6)) == list(range(whole.leaves))
    d = whole.distances(rng.normal(size=(50, W)).astype("f4"))
    for visits in (1, 3, 7, whole.leaves):
        leaves, owner = whole.first_bins(d, visits)
        for i, row in enumerate(d):
            assert set(leaves[owner == i]) == set(whole.best_bins(row, visits)) or visits < whole.leaves
            order = whole.best_bins(row, whole.leaves)
            assert max(order.index(v) for v in leaves[owner == i]) < visits + BRANCHES_AT_A_TIE
