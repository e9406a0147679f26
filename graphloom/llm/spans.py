"""Long exact spans shared between records.

Method: Rabin-Karp hashes of fixed-length windows of the text, counted in
Spark; repeated windows merge into maximal intervals. The tokens are code
points and a window is the wanted span length, so the result is exact.

Counting every window would move many times the text, so windows are counted
in runs. In each window the least hash of its half-length pieces is its
anchor; equal windows have equal anchors wherever they stand. Neighbouring
windows with one anchor form a segment (about 50 windows). Per segment one row
goes to Spark: (anchor, hash of the segment's text). A segment whose text
occurs in two records is shared as a whole. Only where one anchor has several
segment texts (the borders of shared passages) are single windows hashed and
counted, once per distinct segment text. No window is skipped: an equal window
in another record has the same anchor, hence its segment is either equal or is
among those expanded. A group of copies becomes one row per segment before
anything is shuffled twice.

Segments and windows are compared together with their anchors, that is, by two
independent 64-bit hashes of text they contain. A long text is hashed in slices
of ``SLICE_CHARS`` windows; where a slice ends, so does a segment, which makes
it one of those that are expanded.

Null ids and null texts are ignored; texts shorter than the span share
nothing; rows repeating an id count as one record, and if their texts differ
each text is looked at by itself and the amounts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import stage

MIN_CHARS = 200
SLICE_CHARS = 500_000

_BASE = 0x9E6C63D0876A9A35 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Rabin-Karp hashes modulo 2^64 of any stretch of a code point array."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers = np.full(n + 1, _BASE, "u8")
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.back = np.full(n + 1, _INVERSE, "u8")
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, "u8")
        np.cumsum(_mix(codes.astype("u8") + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype("u8"))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // w) * w, np.iinfo("u8").max, "u8")
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def segments(text: str, chars: int, most: int = SLICE_CHARS) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, text hash) of the runs of windows of ``chars`` with one anchor, at most ``most`` long."""
    codes = _codes(text)
    slices = [_slice_segments(codes[a : a + most + chars - 1], chars, a) for a in range(0, len(codes) - chars + 1, most)]
    return slices[0] if len(slices) == 1 else tuple(np.concatenate(c) for c in zip(*slices))


def _slice_segments(codes: np.ndarray, chars: int, offset: int) -> tuple[np.ndarray, ...]:
    piece = chars // 2
    n = len(codes)
    h = RollingHash(codes)
    at = np.arange(n - piece + 1)
    anchor = _window_min(h.of(at, at + piece), chars - piece + 1)
    cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts - 1, [len(anchor) - 1]])
    return (first + offset).astype("i4"), (last + offset).astype("i4"), anchor[first].view("i8"), h.of(first, last + chars).view("i8")


def _segment_rows(docs: DataFrame, chars: int, most: int) -> DataFrame:
    """(id, tid, first, last, anchor, seg) of all records; tid is the hash of the text."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts, held = [], [], 0
            for i, t in enumerate(b.column(1).to_pylist()):
                if len(t) >= chars:
                    parts.append(segments(t, chars, most))
                    ids.append(np.full(len(parts[-1][0]), i, "i8"))
                    held += len(t)
                if held > SLICE_CHARS or parts and i == b.num_rows - 1:
                    cols = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own := pa.array(np.concatenate(ids))), b.column(2).take(own), *cols], ["id", "tid", "first", "last", "anchor", "seg"])
                    ids, parts, held = [], [], 0
            if parts:
                cols = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(own := pa.array(np.concatenate(ids))), b.column(2).take(own), *cols], ["id", "tid", "first", "last", "anchor", "seg"])

    return docs.mapInArrow(run, f"id {id_type}, tid long, first int, last int, anchor long, seg long")


def _window_rows(docs: DataFrame, wanted: DataFrame, chars: int, most: int) -> DataFrame:
    """(anchor, seg, off, win, lo, hi): the single windows of the wanted segments."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, segs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                codes = _codes(t)
                first, last = (np.array([s[k] for s in segs], "i8") for k in ("first", "last"))
                count = last - first + 1
                # The stretches of the wanted segments one after the other, hashed some at a time.
                cuts = np.flatnonzero(np.diff(np.cumsum(count + chars) // most)) + 1
                win = np.concatenate([_windows_of(codes, first[s], last[s], chars) for s in np.split(np.arange(len(segs)), cuts)])
                off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                per_window = pa.array(np.repeat(np.arange(len(segs)), count))
                anchor, seg = (pa.array([s[k] for s in segs], "i8").take(per_window) for k in ("anchor", "seg"))
                lo, hi = (pa.array([s[k] for s in segs]).take(per_window).cast(b.schema.field(0).type) for k in ("lo", "hi"))
                yield pa.RecordBatch.from_arrays([anchor, seg, pa.array(off.astype("i4")), pa.array(win.view("i8")), lo, hi], ["anchor", "seg", "off", "win", "lo", "hi"])

    # A record's wanted segments are bounded by its own text.
    lists = wanted.groupBy(F.col("rep_id").alias("id"), "tid").agg(F.collect_list(F.struct("first", "last", "anchor", "seg", "lo", "hi")).alias("segs"))
    one_text = docs.join(lists, ["id", "tid"]).select("id", "text", "segs")
    return one_text.mapInArrow(run, f"anchor long, seg long, off int, win long, lo {id_type}, hi {id_type}")


def _windows_of(codes: np.ndarray, first: np.ndarray, last: np.ndarray, chars: int) -> np.ndarray:
    """The hashes of the windows of some segments, in order."""
    length = last - first + chars
    begin = np.cumsum(length) - length
    inside = np.arange(length.sum()) - np.repeat(begin, length)
    h = RollingHash(codes[np.repeat(first, length) + inside])
    count = last - first + 1
    start = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return h.of(start, start + chars)


def _intervals(df: DataFrame, id_col: str, text_col: str, chars: int, most: int) -> DataFrame:
    """(id, tid, start, end) of shared stretches, overlapping."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tid")).where("id is not null and text is not null")
    rows = stage(_segment_rows(docs, chars, most))
    texts = rows.groupBy("anchor", "seg").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), *[F.first(c).alias(f"rep_{c}") for c in ("id", "tid", "first", "last")])  # of one row
    anchors = texts.groupBy("anchor").agg(F.count("*").alias("n_seg"), F.min("lo").alias("a_lo"), F.max("hi").alias("a_hi")).where("a_lo <> a_hi")
    known = stage(texts.join(anchors, "anchor").select("anchor", "seg", "lo", "hi", "rep_id", "rep_tid", "rep_first", "rep_last", "n_seg"))
    whole = rows.join(known.where("lo <> hi").select("anchor", "seg"), ["anchor", "seg"]).select("id", "tid", F.col("first").alias("start"), (F.col("last") + chars).alias("end"))
    border = known.where("n_seg > 1").select("rep_id", *[F.col(f"rep_{c}").alias(c) for c in ("tid", "first", "last")], "anchor", "seg", "lo", "hi")
    windows = stage(_window_rows(docs, border, chars, most))
    shared = windows.groupBy("anchor", "win").agg(F.min("lo").alias("w_lo"), F.max("hi").alias("w_hi")).where("w_lo <> w_hi").select("anchor", "win")
    # Segments of several records are whole already; the rest belong to one record, maybe at several places.
    offsets = windows.where("lo = hi").join(shared, ["anchor", "win"]).select("anchor", "seg", "off")
    single = rows.join(known.where("lo = hi and n_seg > 1").select("anchor", "seg"), ["anchor", "seg"]).join(offsets, ["anchor", "seg"])
    return whole.unionByName(single.select("id", "tid", (F.col("first") + F.col("off")).alias("start"), (F.col("first") + F.col("off") + chars).alias("end")))


def shared_spans(df: DataFrame, id_col: str, text_col: str, chars: int = MIN_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(id, start, length) of the maximal intervals of each record that are covered by shared spans."""
    so_far = Window.partitionBy("id", "tid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id", "tid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    marked = _intervals(df, id_col, text_col, chars, slice_chars).distinct().withColumn("before", F.max("end").over(so_far))
    begins = F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)
    grouped = marked.withColumn("run", F.sum(begins).over(upto)).groupBy("id", "tid", "run")
    spans = grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.select(F.col("id").alias(id_col), "start", (F.col("end") - F.col("start")).alias("length"))


def shared_amount(df: DataFrame, id_col: str, text_col: str, chars: int = MIN_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(id, shared_chars, spans) of the records that share any span."""
    return shared_spans(df, id_col, text_col, chars, slice_chars).groupBy(id_col).agg(F.sum("length").alias("shared_chars"), F.count("*").alias("spans"))
