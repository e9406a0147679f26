"""Near-duplicate texts with small edits.

Method: MinHash samples of a text's word shingles are used twice. In bands they
propose candidate pairs; folded into an odd sketch (each sample flips one bit
of a bitmap) they estimate the similarity of each candidate from the population
count of the XOR of two bitmaps. The estimate decides unless it lies within
``SLACK`` (over four standard deviations) of the threshold; only for these
pairs the long shingle lists are fetched and the exact Jaccard similarity taken.

Texts that share boilerplate meet in bands although they are not alike. A band
of more than ``hot_band`` classes proposes no pairs. Its classes are paired by
their rarest shingles instead, which loses nothing: two sets of similarity t or
more share one of their |x| - ceil(t |x|) + 1 rarest elements, in whichever
order all elements are ranked.

Texts with equal word sequences form one class before anything is paired, so a
hot group of copies is a single text here. Pairs are sought within a *scope*
(a part of the data, such as one query's hits), which is folded into the band
keys. With 64 bands of 3 samples a pair of similarity 0.5 is proposed with
probability 0.9998, one of 0.6 practically always.

Texts that are null or have too few words are left out. Classes and band keys
are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import word_line
from graphloom.session import stage

ROWS, BANDS, SKETCH_BITS, SLACK, HOT_BAND = 3, 64, 1024, 0.25, 300
SLICE = 400


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each line of words, flat and sorted per line, with offsets."""
    split = [x.split(" ") for x in lines]
    counts = np.array([len(s) for s in split], "i8")
    words = np.fromiter(chain.from_iterable(split), object, counts.sum())
    codes, distinct = pd.factorize(words)
    hashes = pd.util.hash_array(np.asarray(distinct, object), categorize=False)[codes]
    doc = np.repeat(np.arange(len(lines)), counts)
    n = len(words) - width + 1
    inside = doc[:n] == doc[width - 1 :]
    acc = np.zeros(n, "u8")
    for i in range(width):
        acc = _mix(acc + hashes[i : n + i] * np.uint64(2 * i + 1) + np.uint64(i))
    acc, doc = acc[inside], doc[:n][inside]
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    acc, doc = acc[new], doc[new]
    return acc, np.searchsorted(doc, np.arange(len(lines) + 1))


def min_samples(flat: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """n MinHash samples (rows) of each non-empty set (columns), 32 bits each."""
    out = np.empty((n, len(ends) - 1), "u8")
    mul = _mix(np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for k in range(n):
        out[k] = np.minimum.reduceat((flat ^ (flat >> np.uint64(29))) * mul[k] >> np.uint64(32), ends[:-1])
    return out


def band_keys(samples: np.ndarray, rows: int, scope: np.ndarray) -> np.ndarray:
    bands = samples.shape[0] // rows
    keys = np.empty((samples.shape[1], bands), "u8")
    for j in range(bands):
        acc = scope + np.uint64(j)
        for r in range(rows):
            acc = _mix(acc + samples[j * rows + r] + np.uint64(r))
        keys[:, j] = acc
    return keys


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (bits / 64 words a text) of the samples."""
    n = samples.shape[1]
    parity = np.zeros((n, bits), "u1")
    at = np.arange(n)
    for k in range(samples.shape[0]):
        parity[at, _mix(samples[k] + np.uint64(k + 1 << 32)) % np.uint64(bits)] ^= 1
    return np.packbits(parity, axis=1, bitorder="little").view("u8")


def _lists(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a).view("i8").ravel()), a.shape[1]).cast(pa.list_(pa.int64()))


def _bands_of(classes: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                flat, ends = shingle_sets(b.column(2).to_pylist(), width)
                keys = band_keys(min_samples(flat, ends, ROWS * BANDS), ROWS, b.column(1).to_numpy().view("u8"))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(keys)], ["tid", "bands"])

    return classes.select("tid", F.xxhash64("scope"), "line").mapInArrow(run, "tid long, bands array<long>")


def _sketches_of(classes: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                flat, ends = shingle_sets(b.column(2).to_pylist(), width)
                odd = odd_sketches(min_samples(flat, ends, ROWS * BANDS), SKETCH_BITS)
                sets = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(flat.view("i8")))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(odd), sets], ["tid", "scope", "odd", "shingles"])

    return classes.select("tid", F.xxhash64("scope"), "line").mapInArrow(run, "tid long, scope long, odd array<long>, shingles array<long>")


def odd_estimate(a: Column, b: Column, bits: int = SKETCH_BITS, samples: int = ROWS * BANDS) -> Column:
    """Jaccard similarity estimated from two odd sketches."""
    z = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x.cast("int"))
    differing = -bits / 2.0 * F.log(F.greatest(1 - 2.0 * z / bits, F.lit(1e-3)))
    return 1 - differing / (2.0 * samples)


def text_rows(df: DataFrame, scope: Column, key: str, text: str, min_words: int) -> DataFrame:
    """(scope, key, line, tid) of the texts that count."""
    rows = df.select(scope.cast("string").alias("scope"), F.col(key).alias("key"), word_line(F.col(text)).alias("line"))
    spaces = F.length("line") - F.length(F.translate("line", " ", ""))
    return rows.where(F.col("scope").isNotNull() & F.col("key").isNotNull() & (spaces + 1 >= min_words)).withColumn("tid", F.xxhash64("scope", "line"))


def _rare_pairs(details: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of sets that share one of their rarest elements, all pairs at the threshold among them."""
    sets = details.select("tid", "scope", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    sets = sets.select("tid", "n", F.xxhash64("scope", "s").alias("s"))
    ranked = sets.join(sets.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "s", "left")
    place = F.row_number().over(Window.partitionBy("tid").orderBy(F.coalesce("df", F.lit(1)), "s"))
    first = ranked.withColumn("p", place).where((F.col("p") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1) & F.col("df").isNotNull())
    side = lambda p: first.select("s", F.col("tid").alias(p), F.col("n").alias(f"n_{p}"))
    sized = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    return side("a").join(side("b"), "s").where((F.col("a") < F.col("b")) & sized).select("a", "b").distinct()


def candidate_pairs(rows: DataFrame, width: int, threshold: float, hot_band: int = HOT_BAND) -> DataFrame:
    """(a, b): pairs of classes that may be alike, a < b."""
    banded = _bands_of(_as_classes(rows), width).select("tid", F.explode("bands").alias("band"))
    # Most bands have one class; they end here, after the one shuffle of all bands.
    shared = stage(banded.withColumn("m", F.count("*").over(Window.partitionBy("band"))).where("m > 1"))
    cold = shared.where(F.col("m") <= hot_band)
    left, right = cold.select("band", F.col("tid").alias("a")), cold.select("band", F.col("tid").alias("b"))
    pairs = left.join(right, "band").where("a < b").select("a", "b")
    hot = shared.where(F.col("m") > hot_band).select("tid").distinct()
    if not hot.isEmpty():
        scoped = rows.join(hot, "tid", "left_semi")
        pairs = pairs.unionByName(_rare_pairs(stage(_sketches_of(_as_classes(scoped), width)), threshold))
    return pairs.distinct()


def _as_classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tid").agg(F.first("scope").alias("scope"), F.first("line").alias("line"))


def similar_classes(rows: DataFrame, width: int, threshold: float, hot_band: int = HOT_BAND) -> DataFrame:
    """(a, b): pairs of classes of one scope at or above the threshold, a < b."""
    candidates = stage(candidate_pairs(rows, width, threshold, hot_band))
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    details = stage(_sketches_of(_as_classes(rows.join(wanted, "tid", "left_semi")), width))
    side = lambda p, c: details.select(F.col("tid").alias(p), F.col(c).alias(f"{c}_{p}"))
    estimated = candidates.join(side("a", "odd"), "a").join(side("b", "odd"), "b").select("a", "b", odd_estimate(F.col("odd_a"), F.col("odd_b")).alias("estimate"))
    estimated = stage(estimated.where(F.col("estimate") >= threshold - SLACK))
    sure = estimated.where(F.col("estimate") >= threshold + SLACK).select("a", "b")
    pairs = estimated.where(F.col("estimate") < threshold + SLACK).select("a", "b").join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    exact = both / (F.size("shingles_a") + F.size("shingles_b") - both)
    return sure.unionByName(pairs.where(exact >= threshold).select("a", "b"))


def similar_pairs(rows: DataFrame, width: int, threshold: float, hot_band: int = HOT_BAND) -> DataFrame:
    """(scope, key_a, key_b), every pair of keys whose texts are alike, key_a < key_b, distinct.

    Copies are expanded here, by the definition of the result; :func:`similar_groups` keeps classes.
    """
    rows = stage(rows)  # the words of a text are found once
    members = rows.groupBy("scope", "key", "tid").agg(F.lit(1).alias("one")).drop("one")
    m = lambda t, k: members.select(F.col("tid").alias(t), F.col("key").alias(k), "scope")
    same = m("t", "key_a").join(m("t", "key_b").drop("scope"), "t").where("key_a < key_b").select("scope", "key_a", "key_b")
    classes = similar_classes(rows, width, threshold, hot_band)
    other = classes.join(m("a", "x"), "a").join(m("b", "y").drop("scope"), "b").where("x <> y")
    other = other.select("scope", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    return same.unionByName(other).distinct()


def similar_groups(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """(scope, key, class_id, copies, links): each text's class, the class's size and its links to other classes."""
    rows = stage(rows)
    members = rows.groupBy("scope", "key", "tid").agg(F.lit(1).alias("one")).drop("one")
    classes = similar_classes(rows, width, threshold)
    links = classes.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("links"))
    sizes = members.groupBy("tid").agg(F.count("*").alias("copies")).join(links, "tid", "left")
    return members.join(sizes, "tid").select("scope", "key", F.col("tid").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
