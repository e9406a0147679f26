"""The k most similar vectors of every vector, by cosine.

Method: a hierarchical k-means tree, searched best bin first. Leaves hold about
``LEAF_ROWS`` vectors, so they grow with the collection and the work for a query
does not. The upper levels are fitted on a bounded sample (``SAMPLE`` vectors,
chosen by a hash of the vector); a collection that needs more than ``TOP``
leaves gets its lower levels fitted on the workers, each subtree on a sample of
``PER_LEAF`` vectors a leaf. Every vector is then put into one of the leaves. A
query walks the tree with a priority queue, nearest node first, and visits a
number of leaves that is widened until, on ``CALIBRATION`` queries outside the
sample whose true neighbours are found by brute force over all vectors, the
recall reaches ``TARGET``.

The tree travels to the workers. It has at most ``HELD`` leaves (50 MB at 64
wide), enough for 50 million vectors; beyond that leaves become larger, and
the work for a query grows with them.

Vectors are cleaned first: only those of the given width with finite numbers,
not all zero, count, once per id (of different vectors of one id the least).
Vectors with the same direction form one class; only its k + 1 smallest ids can
be anybody's neighbours (ties go to the smaller id), so a hot group of copies
costs one row.

Leaves lie in *cells* of bounded size (about 12 at least, for parallel work),
neighbours in the tree together; a leaf larger than a cell is split over
several. A query travels once to each cell that holds some of its leaves, not
once to each leaf, and a worker never holds more than one cell. A cell that
many queries visit, as the calibration queries tell, is held several times and
its queries are dealt out over these.
"""

from __future__ import annotations

import heapq
import logging
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import stage

log = logging.getLogger(__name__)

SAMPLE, CALIBRATION, TARGET = 20_000, 256, 0.997
BRANCH, LEAF_ROWS, CELL_ROWS, CELL_QUERIES = 8, 250, 40_000, 200_000
TOP, PER_LEAF, HELD = 400, 16, 200_000
QUERY_BATCH = 2_048


def unit_vectors(df: DataFrame, id_col: str, vector: str, width: int) -> DataFrame:
    """(id, vec): cleaned vectors of length one, as ``width`` 32-bit floats, one per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, width)
            norm = np.linalg.norm(flat, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            unit = (flat[ok] / norm[ok, None]).astype("f4") + np.float32(0)
            vec = pa.array([r.tobytes() for r in unit], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), vec], ["id", "vec"])

    whole = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    whole = whole.where((F.size("v") == width) & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    return whole.mapInArrow(run, "id string, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))


class Tree:
    """A hierarchical k-means tree: node centroids, children, and leaves in depth-first order."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 7):
        self.centroids: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        if len(sample):
            self._grow(sample, max(1, math.ceil(len(sample) / leaves)), branch)
        self._freeze()

    def _freeze(self) -> None:
        self.matrix = np.array(self.centroids, "f4") if self.centroids else np.zeros((0, 1), "f4")
        self.norms = (self.matrix**2).sum(1)
        at = [(leaf, node) for node, leaf in enumerate(self.leaf_of) if leaf >= 0]
        self.leaf_nodes = np.array([node for _, node in sorted(at)], "i8")
        self.levels, level = [], [0] if self.children else []
        while level := [(p, kid) for p in level for kid in self.children[p]]:
            self.levels.append(tuple(np.array(side, "i8") for side in zip(*level)))
            level = [kid for _, kid in level]

    def graft(self, subtrees: dict[int, Tree]) -> Tree:
        """This tree with subtrees in place of some of its leaves."""
        out = Tree(np.zeros((0, 1)), 1)

        def copy(tree: Tree, node: int) -> int:
            sub = subtrees.get(tree.leaf_of[node]) if tree is self else None
            if sub is not None and sub.leaves:
                return copy(sub, 0)
            at = len(out.centroids)
            out.centroids.append(tree.matrix[node])
            out.children.append([])
            out.leaf_of.append(-1)
            if tree.children[node]:
                out.children[at] = [copy(tree, kid) for kid in tree.children[node]]
            else:
                out.leaf_of[at] = out.leaves
                out.leaves += 1
            return at

        if self.children:
            copy(self, 0)
        out._freeze()
        return out

    def _grow(self, x: np.ndarray, most: int, branch: int) -> int:
        node = len(self.centroids)
        self.centroids.append(x.mean(0))
        self.children.append([])
        self.leaf_of.append(-1)
        parts = [] if len(x) <= most else [p for p in self._split(x, min(branch, math.ceil(len(x) / most))) if len(p)]
        if len(parts) < 2:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(p, most, branch) for p in parts]
        return node

    def _split(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        c = x[self._rng.choice(len(x), k, replace=False)]
        for _ in range(12):
            at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            c = np.array([x[at == j].mean(0) if (at == j).any() else x[self._rng.integers(len(x))] for j in range(k)])
        at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        return [x[at == j] for j in range(k)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return self.norms - 2 * x @ self.matrix.T

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by greedy descent."""
        d = self.distances(x)
        out = np.zeros(len(x), "i4")
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
                continue
            near = d[np.ix_(rows, kids)].argmin(1)
            stack += [(kid, rows[near == j]) for j, kid in enumerate(kids) if (near == j).any()]
        return out

    def first_bins(self, distances: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """The leaves :meth:`best_bins` gives for each of a batch of queries, flat, and the query of each.

        A priority queue reaches a leaf when it has reached the farthest node on its way
        from the root; so leaves come in the order of the greatest distance on their
        paths, which is found for the whole batch level by level.
        """
        far = distances.copy()
        far[:, 0] = -np.inf  # the root is where every walk begins
        for parents, kids in self.levels:
            far[:, kids] = np.maximum(far[:, kids], far[:, parents])
        # Below one farthest node the nearest leaf comes first.
        key = far[:, self.leaf_nodes] + np.float32(1e-5) * distances[:, self.leaf_nodes]
        if visits < self.leaves:
            at = np.argpartition(key, visits - 1, axis=1)[:, :visits]
        else:
            at = np.broadcast_to(np.arange(self.leaves), key.shape)
        order = np.argsort(np.take_along_axis(key, at, 1), axis=1)
        return np.take_along_axis(at, order, 1).ravel(), np.repeat(np.arange(len(at)), at.shape[1])

    def best_bins(self, distances: np.ndarray, visits: int) -> list[int]:
        """Leaves of one query in best-bin-first order."""
        heap, out, d = [(0.0, 0)], [], distances.tolist()
        children, leaf_of = self.children, self.leaf_of
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if leaf_of[node] >= 0:
                out.append(leaf_of[node])
            else:
                for kid in children[node]:
                    heapq.heappush(heap, (d[kid], kid))
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "f4").reshape(-1, width)


def _counted(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each of the numbers, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k greatest similarities and their ids, in no order."""
    if sims.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(sims, at, 1), np.take_along_axis(np.broadcast_to(ids, sims.shape), at, 1)
    return sims, np.broadcast_to(ids, sims.shape)


def _true_neighbours(classes: DataFrame, queries: np.ndarray, width: int, k: int) -> list[list[int]]:
    """The k most similar classes of a bounded number of queries, by brute force over all classes."""
    sc = classes.sparkSession.sparkContext
    held = sc.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value.astype("f8")
        sims, ids = np.zeros((len(q), 0)), np.zeros((len(q), 0), "i8")
        for b in batches:
            s, i = _best(q @ _matrix(b.column(1), width).astype("f8").T, b.column(0).to_numpy()[None, :], k)
            sims, ids = _best(np.hstack([sims, s]), np.hstack([ids, i]), k)
        n = ids.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(ids.ravel()), pa.array(sims.ravel())], ["q", "cid", "sim"])

    rows = classes.select("cid", "vec").mapInArrow(run, "q long, cid long, sim double")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "cid"))).where(F.col("r") <= k)
    out: list[list[int]] = [[] for _ in queries]
    for r in first.collect():  # CALIBRATION * k rows
        out[r.q].append(r.cid)
    return out


def _calibrate(tree: Tree, leaves: DataFrame, queries: np.ndarray, width: int, k: int, target: float) -> int:
    """The least number of leaf visits at which the calibration queries reach the target recall."""
    if tree.leaves <= 1 or not len(queries):
        return 1
    truth = _true_neighbours(leaves, queries, width, k)
    wanted = sorted({c for t in truth for c in t})
    sought = leaves.sparkSession.createDataFrame([(c,) for c in wanted], "cid long")
    at = {r.cid: r.leaf for r in leaves.join(F.broadcast(sought), "cid").select("cid", "leaf").collect()}  # CALIBRATION * k rows
    order = tree.first_bins(tree.distances(queries), tree.leaves)[0].reshape(len(queries), -1)
    place = np.argsort(order, axis=1)
    ranks = sorted(int(place[i, at[c]]) for i, t in enumerate(truth) for c in t)
    return ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)] + 1


def _cells(counts: dict[int, int], leaves: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of each leaf; small neighbouring leaves share a cell."""
    first, many = np.zeros(leaves, "i8"), np.ones(leaves, "i8")
    cell, held = 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if n > cell_rows:
            cell += held > 0
            first[leaf], many[leaf] = cell, math.ceil(n / cell_rows)
            cell, held = cell + int(many[leaf]), 0
            continue
        if held + n > cell_rows:
            cell, held = cell + 1, 0
        first[leaf], held = cell, held + n
    return first, many


def _fit(classes: DataFrame, total: int, width: int, sample: int, leaf_rows: int) -> tuple[Tree, np.ndarray]:
    """The tree, and calibration queries that it was not fitted on (but for collections smaller than the sample)."""
    spark = classes.sparkSession
    mark = F.pmod(F.xxhash64(F.lit(11), "cid"), F.lit(1 << 40))
    part = lambda rows: math.ceil(min(1.0, rows / max(total, 1)) * (1 << 40))
    matrix = lambda rows: np.frombuffer(b"".join(bytes(r.vec) for r in rows), "f4").reshape(-1, width)
    points = matrix(classes.where(mark < part(sample)).select("cid", "vec").orderBy("cid").collect())  # about ``sample`` rows
    queries = matrix(classes.where(mark >= (1 << 40) - part(CALIBRATION)).select("cid", "vec").orderBy("cid").collect())
    wanted = min(HELD, math.ceil(total / leaf_rows) or 1)
    tree = Tree(points.astype("f8"), min(wanted, TOP))
    if wanted <= TOP:
        return tree, queries
    held = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = held.value.assign(_matrix(b.column(0), width)) if b.num_rows else np.zeros(0, "i4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf)], ["vec", "leaf"])

    share = min(1.0, PER_LEAF * wanted / total)

    def grow(key, table):
        x = _matrix(table.column("vec").combine_chunks(), width).astype("f8")
        sub = Tree(x[np.lexsort(x.T)], max(1, round(len(x) / PER_LEAF)), seed=key[0].as_py())
        return pa.table({"leaf": pa.array([key[0].as_py()], "i4"), "tree": [pickle.dumps(sub, 5)]})

    # A group is a top leaf's part of the sample: some PER_LEAF * HELD / TOP rows at most.
    drawn = classes.where(mark < math.ceil(share * (1 << 40))).select("vec").mapInArrow(place, "vec binary, leaf int")
    grown = drawn.groupBy("leaf").applyInArrow(grow, "leaf int, tree binary")
    return tree.graft({r.leaf: pickle.loads(r.tree) for r in grown.collect()}), queries  # TOP rows, HELD leaves in all


def nearest_classes(classes: DataFrame, width: int, k: int, target: float = TARGET, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(cid, found array<struct<far, other>>): for each class its k most similar classes, itself among them; far is the negative similarity."""
    spark = classes.sparkSession
    sc = spark.sparkContext
    total = classes.count()
    tree, queries = _fit(classes, total, width, sample, leaf_rows)
    held = sc.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = held.value.assign(_matrix(b.column(1), width)) if b.num_rows else np.zeros(0, "i4")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["cid", "vec", "leaf"])

    placed = stage(classes.select("cid", "vec").mapInArrow(place, "cid long, vec binary, leaf int"))
    visits = _calibrate(tree, placed, queries, width, k, target)
    log.info("%d leaves, %d visits for recall %.3f", tree.leaves, visits, target)
    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # at most HELD rows
    first, many = _cells(counts, max(tree.leaves, 1), min(cell_rows, max(2_000, total // 12)))
    # How many copies of each cell there are, by the visits of the calibration queries.
    load = np.zeros(int((first + many).max()), "i8")
    for seen in tree.first_bins(tree.distances(queries), visits)[0].reshape(len(queries), -1) if len(queries) and tree.leaves else ():
        load[np.unique(np.concatenate([np.arange(first[v], first[v] + many[v]) for v in seen]))] += 1
    copies = np.maximum(1, np.ceil(load * (total / max(len(queries), 1)) / cell_queries)).astype("i8")
    cells = sc.broadcast((first, many, copies, np.concatenate([[0], np.cumsum(copies)])))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class as data to the copies of its cell, and as a query to one copy of each cell of its best bins."""
        tree, (first, many, copies, base) = held.value, cells.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                cid, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
                x = _matrix(b.column(1), width)
                cell = first[leaf] + (cid.view("u8") % many[leaf].astype("u8")).astype("i8")
                mixed = (cid.view("u8") // np.uint64(7919)).astype("u8")
                to_data = np.repeat(base[cell], copies[cell]) + _counted(copies[cell])
                rows_data = np.repeat(np.arange(len(x)), copies[cell])
                bins, owner = tree.first_bins(tree.distances(x), visits)
                in_cell = np.repeat(first[bins], many[bins]) + _counted(many[bins])
                bins, owner = np.repeat(bins, many[bins]), np.repeat(owner, many[bins])
                order = np.lexsort((in_cell, owner))  # stable: the best bins of each cell first
                bins, owner, in_cell = bins[order], owner[order], in_cell[order]
                new = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(in_cell, prepend=-1))
                to_query = base[in_cell[new]] + (mixed[owner[new]] % copies[in_cell[new]].astype("u8")).astype("i8")
                ends = np.concatenate([np.arange(len(rows_data)), len(rows_data) + new, [len(rows_data) + len(bins)]])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(np.concatenate([leaf[rows_data], bins]).astype("i4")))
                take = pa.array(np.concatenate([rows_data, owner[new]]))
                kind = np.repeat(np.array([0, 1], "i1"), [len(rows_data), len(new)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([to_data, to_query])), pa.array(kind), b.column(0).take(take), b.column(1).take(take), lists], ["cell", "kind", "cid", "vec", "bins"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, data before queries."""
        cell, ids, vecs, leafs, groups = None, [], [], [], None
        for whole in batches:
            edges = [0, *(np.flatnonzero(np.diff(whole.column(0).to_numpy()) | np.diff(whole.column(1).to_numpy())) + 1).tolist(), whole.num_rows]
            for s, e in zip(edges, edges[1:]):
                b = whole.slice(s, e - s)
                if not b.num_rows:
                    continue
                if b.column(0)[0].as_py() != cell:
                    cell, ids, vecs, leafs, groups = b.column(0)[0].as_py(), [], [], [], None
                if b.column(1)[0].as_py() == 0:
                    ids.append(b.column(2).to_numpy())
                    vecs.append(_matrix(b.column(3), width))
                    leafs.append(b.column(4).flatten().to_numpy())
                    continue
                if groups is None:
                    groups = {}
                    if ids:
                        i, v, at = np.concatenate(ids), np.concatenate(vecs).astype("f8"), np.concatenate(leafs)
                        order = np.argsort(at, kind="stable")
                        i, v, at = i[order], v[order], at[order]
                        cuts = np.flatnonzero(np.diff(at)) + 1
                        groups = {int(a[0]): (p, q) for a, p, q in zip(np.split(at, cuts), np.split(i, cuts), np.split(v, cuts))}
                for t in range(0, b.num_rows, QUERY_BATCH):
                    yield _search_cell(groups, b.slice(t, QUERY_BATCH), width, k)

    sent = placed.mapInArrow(send, "cell long, kind byte, cid long, vec binary, bins array<int>")
    by_cell = sent.repartition("cell").sortWithinPartitions("cell", "kind")
    partial = by_cell.mapInArrow(search, "cid long, found array<struct<far:double, other:long>>")
    # A query's lists are as many as its cells, each of at most k entries.
    return partial.groupBy("cid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def _search_cell(groups: dict, b: pa.RecordBatch, width: int, k: int) -> pa.RecordBatch:
    q = _matrix(b.column(3), width).astype("f8")
    n = len(q)
    bins, lengths = b.column(4).flatten().to_numpy(), b.column(4).value_lengths().to_numpy()
    owner, start = np.repeat(np.arange(n), lengths), np.cumsum(lengths) - lengths
    least = np.full(n, -np.inf)
    rows, sims, ids = [np.zeros(0, "i8")], [np.zeros(0)], [np.zeros(0, "i8")]
    # The best bin of each query first: what it yields sets the least similarity that still counts.
    is_first = np.zeros(len(bins), bool)
    is_first[start] = True
    for now in (is_first, ~is_first):
        at = np.flatnonzero(now)
        at = at[np.argsort(bins[at], kind="stable")]
        for seg in np.split(at, np.flatnonzero(np.diff(bins[at])) + 1) if len(at) else ():
            if int(bins[seg[0]]) not in groups:
                continue
            own, vecs = groups[int(bins[seg[0]])]
            who = owner[seg]
            s = q[who] @ vecs.T
            if now is is_first and s.shape[1] >= k:
                least[who] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            r, c = np.nonzero(s >= least[who][:, None])
            rows.append(who[r])
            sims.append(s[r, c])
            ids.append(own[c])
    row, sim, other = np.concatenate(rows), np.concatenate(sims), np.concatenate(ids)
    order = np.lexsort((other, -sim, row))
    row, sim, other = row[order], sim[order], other[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    row, sim, other = row[keep], sim[keep], other[keep]
    values = pa.StructArray.from_arrays([pa.array(-sim), pa.array(other)], ["far", "other"])
    ends = np.searchsorted(row, np.arange(n + 1))
    return pa.RecordBatch.from_arrays([b.column(2), pa.ListArray.from_arrays(pa.array(ends, "i4"), values)], ["cid", "found"])


def nearest_neighbours(df: DataFrame, id_col: str, vector: str, width: int, k: int = 10, **options) -> DataFrame:
    """(id, other, sim, rank): the k most similar ids of every id, or all others if there are fewer."""
    rows = unit_vectors(df, id_col, vector, width).withColumn("cid", F.xxhash64("vec"))
    rows = stage(rows)
    by_id = Window.partitionBy("cid").orderBy("id")
    # The limit on row_number is pushed below the shuffle, so a hot class stays small.
    few = rows.select("cid", "id").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    heads = few.groupBy("cid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = rows.groupBy("cid").agg(F.min("vec").alias("vec"))
    found = nearest_classes(classes, width, k + 1, **options)
    entries = found.select("cid", F.explode("found").alias("f")).select("cid", "f.far", F.col("f.other").alias("other_cid"))
    named = entries.join(heads.select(F.col("cid").alias("other_cid"), "ids"), "other_cid")
    lists = named.groupBy("cid").agg(F.collect_list(F.struct("far", "ids")).alias("lists"))  # k + 1 lists of k + 1 ids
    flat = F.flatten(F.transform("lists", lambda s: F.transform(s.ids, lambda i: F.struct(s.far.alias("far"), i.alias("id")))))
    best = lists.select("cid", F.slice(F.array_sort(flat), 1, k + 1).alias("best"))
    own = rows.select("id", "cid").join(best, "cid")
    rest = own.select("id", F.slice(F.filter("best", lambda s: s.id != F.col("id")), 1, k).alias("best"))
    return rest.select("id", F.posexplode("best").alias("pos", "b")).select("id", F.col("b.id").alias("other"), (-F.col("b.far")).alias("sim"), (F.col("pos") + 1).alias("rank"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs in which at least one is a neighbour of the other."""
    return neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
