"""Exact searches of many queries over many records, block against block.

Records and queries are dealt out over blocks of bounded size by the hashes of
their ids; a task holds one block of each and scores them with arrays. What it
passes on are the best k records per query, so what is shuffled afterwards grows
with queries and blocks and not with the pairs scored. Nothing is left out: every
record is scored for every query it can be a hit of.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 1 << 16  # records of a block
LEAST = 1 << 12  # below that, records are not split for the sake of more tasks
ASKED = 1 << 15  # queries of a block
STRIPE = 64
TILE = 1 << 13  # vectors compared with a slice of the queries at once
SLICE = 256
NEAR = 1e-9  # far more than the error of a matrix product of unit vectors


def block_count(n: int, cores: int) -> int:
    """Blocks for n records: bounded by their size, and at least one a core if there are many records."""
    return max(1, -(-n // ROWS), min(cores, n // LEAST))


def _block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _everywhere(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], cells: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Cogroups the sides; the number of partitions is given, as a small table may mean much work."""
    sides = [df.repartition(max(4 * cells, 1), *keys).groupBy(*keys) for df in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _ranks(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of every value among the distinct ones in order (null first), and these."""
    coded = values.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy(zero_copy_only=False)] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


# ------------------------------------------------------------ words


def _pack(block: int, ids: pa.Array, lengths: np.ndarray, row: np.ndarray, word: np.ndarray, tf: np.ndarray | None, words: pa.Array, per_text: bool) -> pa.Table:
    """The postings of one block: a row for each word, and one without a word for the texts.

    A text is a distinct (id, length). ``row`` gives for every found word the row of ``ids`` it stands in.
    """
    rank, known = _ranks(ids)
    texts, text_of, rows = np.unique((rank << 31) | lengths, return_inverse=True, return_counts=True)
    n = max(len(texts), 1)
    keys = word.astype(np.int64) * n + text_of[row]
    if tf is None:
        keys, tf = np.unique(keys, return_counts=True)
    else:
        keys, at = np.unique(keys, return_inverse=True)
        tf = np.bincount(at, weights=tf, minlength=len(keys))
    of_word, text = keys // n, keys % n
    starts = np.flatnonzero(np.diff(of_word, prepend=-1))
    found = words.take(pa.array(of_word[starts]))
    bounds = np.append(starts, len(keys))
    head = pa.array([np.asarray(texts & ((1 << 31) - 1), np.int32)], pa.list_(pa.int32()))
    rows_of = pa.array([np.asarray(rows if per_text else rows * 0, np.int32)], pa.list_(pa.int32()))
    own = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), known.take(pa.array(texts >> 31)))
    return pa.table(
        {
            "block": pa.array(np.full(len(found) + 1, block), pa.int32()),
            "term": pa.concat_arrays([pa.nulls(1, pa.string()), found]),
            "ids": pa.concat_arrays([own, pa.nulls(len(found), own.type)]),
            "texts": pa.concat_arrays([head, _lists(text, bounds)]),
            "tf": pa.concat_arrays([rows_of, _lists(np.asarray(tf, np.int32), bounds)]),
        }
    )


def _packed_schema(df: DataFrame) -> str:
    return f"block int, term string, ids array<{_type(df, 'id')}>, texts array<int>, tf array<int>"


def _none(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def _out(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("block", pa.int32()), ("term", pa.string()), ("ids", pa.list_(id_type)), ("texts", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])


def pack_texts(texts: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """(block, term, ids, texts, tf) over n blocks: the postings of the words in texts (id, tokens).

    A block has one row without a term: the ids of its texts, in ``texts`` their
    lengths, in ``tf`` the number of rows that are this text. In the other rows
    ``texts`` are places in it.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _none(_out(left.schema.field("id").type))
        vocabulary = _whole(right["term"])
        rows, codes, before = [], [], 0
        for chunk in left["line"].chunks:
            parts = pc.split_pattern(chunk, " ")
            code = pc.index_in(parts.flatten(), value_set=vocabulary)
            at = np.repeat(np.arange(before, before + len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            before += len(parts)
            kept = code.is_valid().to_numpy(zero_copy_only=False)
            rows.append(at[kept])
            codes.append(code.drop_null().to_numpy(zero_copy_only=False))
        return _pack(left["block"][0].as_py(), _whole(left["id"]), left["length"].to_numpy().astype(np.int64), np.concatenate(rows), np.concatenate(codes), None, vocabulary, True)

    # One line of words is a third of what an array of them is in a shuffle.
    lines = texts.select("id", F.size("tokens").alias("length"), F.array_join("tokens", " ").alias("line")).withColumn("block", _block("id", n))
    return _meet(lines, _everywhere(words.select("term"), "block", n), ["block"], n, run, _packed_schema(texts))


def pack_postings(index: DataFrame, n: int) -> DataFrame:
    """:func:`pack_texts` from postings (id, term, tf, length) of the words sought; the number of rows of a text is not known and 0."""

    def run(table: pa.Table) -> pa.Table:
        code, words = _ranks(_whole(table["term"]))
        return _pack(table["block"][0].as_py(), _whole(table["id"]), table["length"].to_numpy().astype(np.int64), np.arange(table.num_rows), code, table["tf"].to_numpy(), words, False)

    rows = index.select("id", "term", "tf", "length", _block("id", n).alias("block"))
    return rows.repartition(4 * n, "block").groupBy("block").applyInArrow(run, _packed_schema(index))


def word_hits(packed: DataFrame, asked: DataFrame, blocks: int, queries: int, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, matched, hits): in every block of records, for every query with a match there, the number of
    matching ids and the best k as (id, score), by the score to twelve decimals and the smaller id.

    ``asked`` is (query_id, term, weight, avgdl); a score is matched if it is above 0 to twelve decimals.
    """
    q = max(1, -(-queries // ASKED))

    def run(index: pa.Table, questions: pa.Table) -> pa.Table:
        kind = index.schema.field("ids").type.value_type
        hits_type = pa.list_(pa.struct([("id", kind), ("score", pa.float64())]))
        schema = pa.schema([("query_id", questions.schema.field("query_id").type), ("matched", pa.int64()), ("hits", hits_type)])
        valid = pc.is_valid(index["term"])
        if not index.num_rows or not questions.num_rows or not pc.any(valid).as_py():
            return _none(schema)
        head, index = index.filter(pc.invert(valid)), index.filter(valid)
        ids, lengths = _whole(head["ids"]).flatten(), _whole(head["texts"]).flatten().to_numpy()
        posted, tf = _whole(index["texts"]), _whole(index["tf"]).flatten().to_numpy().astype(float)
        bounds = np.append(0, np.cumsum(pc.list_value_length(posted).to_numpy()))
        at, avgdl = posted.flatten().to_numpy(), questions["avgdl"][0].as_py()
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[at] / avgdl)) if avgdl > 0 else tf * 0.0
        owner, known = _ranks(ids)
        if len(known) < len(ids):  # texts of several lengths under one id: their parts add up
            keys, same = np.unique(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * len(known) + owner[at], return_inverse=True)
            impact, at = np.bincount(same, weights=impact), keys % len(known)
            bounds = np.searchsorted(keys // len(known), np.arange(len(bounds)))
        place = pc.index_in(questions["term"], value_set=_whole(index["term"]))
        found = place.is_valid().to_numpy()
        code, names = _ranks(_whole(questions["query_id"]))
        code, place, weight = code[found], place.drop_null().to_numpy(), questions["weight"].to_numpy()[found]
        order = np.argsort(code, kind="stable")
        code, place, weight = code[order], place[order], weight[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        score = np.zeros(-(-len(known) // STRIPE) * STRIPE)
        stripes = score.reshape(-1, STRIPE)
        out_query, out_n, out_id, out_score, out_size = [], [], [], [], []
        for lo, hi in zip(first, np.append(first[1:], len(code))):
            score.fill(0.0)
            for j in range(lo, hi):
                x, y = bounds[place[j]], bounds[place[j] + 1]
                score[at[x:y]] += weight[j] * impact[x:y]
            # As many stripes as hits are wanted have a score of at least that, so that many records have.
            tops = stripes.max(axis=1)
            least = np.partition(tops, len(tops) - k)[len(tops) - k] if len(tops) > k else 0.0
            some = np.flatnonzero(score >= max(least - 1e-11, 0.5e-12))
            if not len(some):
                continue
            some = some[np.argsort(-np.rint(score[some] * 1e12), kind="stable")[:k]]
            out_query.append(code[lo])
            out_n.append(np.count_nonzero(score >= 0.5e-12))
            out_id.append(some)
            out_score.append(score[some])
            out_size.append(len(some))
        if not out_query:
            return _none(schema)
        pairs = pa.StructArray.from_arrays([known.take(pa.array(np.concatenate(out_id))), pa.array(np.concatenate(out_score))], fields=list(hits_type.value_type))
        hits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(out_size)), pa.int32()), pairs)
        return pa.table([names.take(pa.array(out_query)), pa.array(out_n, pa.int64()), hits.cast(hits_type)], schema=schema)

    left = _everywhere(packed, "part", q)
    right = _everywhere(asked.select("query_id", "term", "weight", "avgdl"), "block", blocks).withColumn("part", _block("query_id", q))
    kind = packed.schema["ids"].dataType.elementType.simpleString()
    return _meet(left, right, ["block", "part"], blocks * q, run, f"query_id {_type(asked, 'query_id')}, matched long, hits array<struct<id: {kind}, score: double>>")


def exploded(found: DataFrame) -> DataFrame:
    """(query_id, id, score) of lists of hits, brought together by query while they are lists."""
    return found.select("query_id", "hits").repartition("query_id").select("query_id", F.explode("hits").alias("h")).select("query_id", "h.id", "h.score")


# ------------------------------------------------------------ vectors


def _matrix(vectors: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, vectors as doubles) for each width, of vectors without null elements that are finite."""
    widths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = []
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        flat = vectors.take(pa.array(rows)).flatten()
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).all(axis=1)
        m = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
        good = whole & np.isfinite(m).all(axis=1)
        out.append((int(width), rows[good], m[good]))
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first element to the last as ``vectors.dot`` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total = total + a[:, i] * b[:, i]
    return total


def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all vectors of ``a``: (row of a, row of b, cosine) of pairs that have the best k of each among them.

    A product of unit vectors proposes all pairs within its error; their cosine is that of ``vectors.cosine``.
    """
    with np.errstate(all="ignore"):
        size_a, size_b = _dot(a, a), _dot(b, b)
        row_a, row_b = np.flatnonzero(size_a > 0), np.flatnonzero(size_b > 0)  # others have no cosine
        a, b, size_a, size_b = a[row_a], b[row_b], size_a[row_a], size_b[row_b]
        # Of sizes whose product may leave the range of doubles every pair is proposed.
        odd_a, odd_b = (~((s > 1e-140) & (s < 1e140)) for s in (size_a, size_b))
        unit_a, unit_b = (m / np.sqrt(np.where(odd, 1, s))[:, None] * ~odd[:, None] for m, s, odd in ((a, size_a, odd_a), (b, size_b, odd_b)))
        out = [(np.array([], int), np.array([], int), np.array([]))]
        for lo in range(0, len(a), SLICE):
            part = unit_a[lo : lo + SLICE]
            least, own = np.full(len(part), -2.0), [(np.array([], int), np.array([], int), np.array([]))]
            for start in range(0, len(b), TILE):
                odd = odd_b[start : start + TILE]
                near = part @ unit_b[start : start + TILE].T
                near[:, odd] = -np.inf
                # Maxima of stripes bound the k-th best from below, as many stripes as hits are wanted.
                width = max(1, min(STRIPE, near.shape[1] // (2 * k)))
                tops = near[:, : near.shape[1] // width * width].reshape(len(near), -1, width).max(axis=2)
                if tops.shape[1] >= k:
                    least = np.maximum(least, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k])
                    least[odd_a[lo : lo + SLICE]] = -2.0
                near[:, odd] = np.inf
                i, j = np.nonzero(near >= (least - NEAR)[:, None])
                own.append((i, j + start, near[i, j]))
            i, j, near = (np.concatenate(x) for x in zip(*own))
            kept = near >= least[i] - NEAR
            i, j = i[kept] + lo, j[kept]
            for x in range(0, len(i), ROWS):
                m, n = i[x : x + ROWS], j[x : x + ROWS]
                cosine = _dot(a[m], b[n]) / np.sqrt(size_a[m] * size_b[n])
                real = np.abs(cosine) <= 2
                out.append((row_a[m[real]], row_b[n[real]], cosine[real]))
    return tuple(np.concatenate(x) for x in zip(*out))


def vector_lists(embeddings: DataFrame, queries: DataFrame, records: int, asked: int, k: int) -> DataFrame:
    """(query_id, hits): for every query vector in every block of embeddings (id, embedding) the best k as
    (id, score), by the cosine and the smaller id. ``records`` and ``asked`` are their numbers."""
    n, q = block_count(records, embeddings.sparkSession.sparkContext.defaultParallelism), max(1, -(-asked // ASKED))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("id").type
        hits_type = pa.list_(pa.struct([("id", kind), ("score", pa.float64())]))
        schema = pa.schema([("query_id", right.schema.field("query_id").type), ("hits", hits_type)])
        if not left.num_rows or not right.num_rows:
            return _none(schema)
        ids, names = _whole(left["id"]), _whole(right["query_id"])
        place = _ranks(ids)[0]
        records, out = _matrix(_whole(left["embedding"])), []
        for width, rows, a in _matrix(_whole(right["vector"])):
            for other, known, b in records:
                if other == width:
                    i, j, score = _nearest(a, b, k)
                    order = np.lexsort((place[known[j]], -score, i))
                    i, j, score = i[order], known[j[order]], score[order]
                    first = np.flatnonzero(np.diff(i, prepend=-1))
                    nth = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                    out.append((rows[i[nth < k]], j[nth < k], score[nth < k]))
        if not sum(len(x[0]) for x in out):
            return _none(schema)
        query, record, score = (np.concatenate(x) for x in zip(*out))
        first = np.flatnonzero(np.diff(query, prepend=-1))
        pairs = pa.StructArray.from_arrays([ids.take(pa.array(record)), pa.array(score)], fields=list(hits_type.value_type))
        hits = pa.ListArray.from_arrays(pa.array(np.append(first, len(query)), pa.int32()), pairs)
        return pa.table([names.take(pa.array(query[first])), hits.cast(hits_type)], schema=schema)

    left = _everywhere(embeddings.select("id", "embedding").withColumn("block", _block("id", n)), "part", q)
    right = _everywhere(queries.select("query_id", "vector").withColumn("part", _block("query_id", q)), "block", n)
    return _meet(left, right, ["block", "part"], n * q, run, f"query_id {_type(queries, 'query_id')}, hits array<struct<id: {_type(embeddings, 'id')}, score: double>>")
