"""Evaluation texts inside training texts.

Method: a generalised suffix automaton over the words of the test items is
built; the training texts stream through it word by word, which yields at every
position the longest run of words that ends there and occurs in some item.
These runs, as spans with positions, are what is removed: spans of
``MAX_RUN`` words or more are cut out of a text, and a text of which more than
``MAX_SHARE`` is covered goes as a whole.

An automaton travels to the workers, so its size is bounded: items beyond
``MAX_WORDS`` words in all are dealt into blocks, each with its own automaton
over which the texts stream in turn; the blocks are built on the workers, and
the driver passes on one at a time (some 10 MB each). Nothing depends on the
blocks: spans of one document are united over all of them before anything is
measured. Items longer than ``PART`` words, however many there are, are cut into
parts that overlap by ``OVERLAP`` words; of a run longer than that the longest
piece inside one part is reported, covered words are exact always.

A word is a maximal run of a-z and 0-9 in the lower-cased text. Null and empty
texts (and texts shorter than the run) leak nothing; items without id are left
out; rows that repeat an id with another text are looked at by themselves.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import stage

MIN_RUN = 10
MAX_RUN, MAX_SHARE = 25, 0.3
MAX_WORDS, PART, OVERLAP = 100_000, 50_000, 1_000
WORD = re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word, as code points of the text itself."""
    low = text.lower()
    places = [m.span() for m in WORD.finditer(low)]
    if len(low) != len(text):  # some character becomes two when lower-cased
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
        places = [(origin[a], origin[b - 1] + 1) for a, b in places]
    return places


class ItemAutomaton:
    """Suffix automaton of several word sequences; states know the items they occur in."""

    def __init__(self, items: dict[int, list[str]] | list[tuple[int, list[str]]], min_run: int):
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.min_run = min_run
        items = list(items.items() if isinstance(items, dict) else items)
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        own: list[set[int]] = [set() for _ in self.size]
        for item, seq in items:
            state = 0
            for w in seq:
                state = self.next[state][w]
                s = state
                while s > 0 and item not in own[s]:  # everything above is marked already
                    own[s].add(item)
                    s = self.link[s]
        # The shortest suffix of a state's run that still has min_run words occurs in the most items.
        self.items: list[tuple[int, ...] | None] = [None] * len(self.size)
        for s in sorted(range(len(self.size)), key=self.size.__getitem__):
            if self.size[s] >= min_run:
                up = self.link[s]
                self.items[s] = self.items[up] if self.size[up] >= min_run else tuple(sorted(own[s]))
        self.own = [tuple(o) if n >= min_run else () for o, n in zip(own, self.size)]

    def _new(self, size: int, nxt: dict[str, int], link: int) -> int:
        self.next.append(nxt)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _clone(self, p: int, q: int, w: str) -> int:
        c = self._new(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, w)
        cur, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, w)
        return cur

    def matches(self, seq: list[str]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(end position, longest run ending there, items) wherever the run has min_run words."""
        return ((i, run, self.items[state]) for i, run, state in self._walk(seq))

    def credits(self, seq: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end position, item, longest run of that item ending there) wherever the run has min_run words."""
        for i, run, state in self._walk(seq):
            seen: set[int] = set()
            while self.size[state] >= self.min_run:  # the shorter the suffix, the more items have it
                for k in self.own[state]:
                    if k not in seen:
                        seen.add(k)
                        yield i, k, min(run, self.size[state])
                state = self.link[state]

    def _walk(self, seq: list[str]) -> Iterator[tuple[int, int, int]]:
        nxt, link, size, least = self.next, self.link, self.size, self.min_run
        state = run = 0
        for i, w in enumerate(seq):
            t = nxt[state].get(w)
            while t is None and state:
                state = link[state]
                run = size[state]
                t = nxt[state].get(w)
            if t is not None:
                state = t
                run += 1
                if run >= least:
                    yield i, run, state


def item_parts(seq: list[str], most: int, overlap: int) -> list[list[str]]:
    """The words in parts of at most ``most``, each overlapping the next."""
    if len(seq) <= most:
        return [seq]
    return [seq[i : i + most] for i in range(0, len(seq) - overlap, most - overlap)]


def _machines(items: DataFrame, item_id: str, item_text: str, min_run: int, max_words: int) -> DataFrame:
    """(block, machine): the automata of all items, built on the workers.

    A part of an item lies in the block of its hash; there are twice as many
    blocks as would hold all words, so that none is much larger than max_words.
    """
    id_type = items.select(item_id).schema[0].dataType.simpleString()
    overlap = max(OVERLAP, min_run)
    most = max(PART, 2 * overlap)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, " ".join(p), len(p)) for i, t in enumerate(b.column(1).to_pylist()) for p in item_parts(words(t), most, overlap) if len(p) >= min_run]
            at, line, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, "i8")), pa.array(line, "string"), pa.array(n, "i4")], ["item", "line", "n"])

    parts = stage(items.where(F.col(item_id).isNotNull()).select(item_id, item_text).mapInArrow(split, f"item {id_type}, line string, n int").distinct())
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = 1 if total <= max_words else -(-2 * total // max_words)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        # Several parts or texts of one item are sequences of one owner.
        seqs = [(k, line.split(" ")) for k, line in zip(group["item"].tolist(), group["line"].tolist())]
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "machine": [pickle.dumps(ItemAutomaton(seqs, min_run), 5)]})

    keyed = parts.withColumn("block", F.pmod(F.xxhash64("item", "line"), F.lit(blocks)))
    return keyed.groupBy("block").applyInPandas(build, "block long, machine binary")


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", min_run: int = MIN_RUN, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, text_hash, item_id, start_word, end_word, start, end, longest_run, doc_words): the stretches of each document that an item shares.

    start and end are code points; end is exclusive. longest_run is the longest
    run inside the stretch that the item holds in one piece.
    """
    sc = docs.sparkSession.sparkContext
    id_type = docs.select(doc_id).schema[0].dataType.simpleString()
    item_type = items.select(item_id).schema[0].dataType.simpleString()
    numbers = ["start_word", "end_word", "start", "end", "longest_run", "doc_words"]
    schema = f"`{doc_id}` {id_type}, text_hash long, `{item_id}` {item_type}, " + ", ".join(f"{n} int" for n in numbers)
    machines = stage(_machines(items, item_id, item_text, min_run, max_words))
    # Null texts and repeated rows have nothing (more) to say; only the id, the text and its hash are read.
    texts = docs.select(F.col(doc_id), F.col(doc_text).alias("_text"), F.xxhash64(doc_text).alias("_hash")).where("_text is not null")
    out = None
    for (block,) in machines.select("block").orderBy("block").collect():
        held = sc.broadcast(machines.where(F.col("block") == block).first().machine)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            machine: ItemAutomaton = pickle.loads(held.value)
            for b in batches:
                rows = [(i, *row) for i, t in enumerate(b.column(1).to_pylist()) for row in _text_spans(machine, t)]
                at, found, *cols = zip(*rows) if rows else ((),) * 8
                own = pa.array(at, "i8")
                item = pa.array(found, pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(2).take(own), item, *(pa.array(c, "i4") for c in cols)], [doc_id, "text_hash", item_id, *numbers])

        own = texts.mapInArrow(run, schema)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _text_spans(machine: ItemAutomaton, text: str) -> list[tuple]:
    """(item, start_word, end_word, start, end, longest_run, doc_words) of one text."""
    seq = words(text)
    if len(seq) < machine.min_run:
        return []
    spans: dict[int, list[list[int]]] = {}
    for end, item, n in machine.credits(seq):
        own = spans.setdefault(item, [])
        start = end + 1 - n
        if own and start <= own[-1][1]:
            own[-1] = [min(own[-1][0], start), end + 1, max(own[-1][2], n)]
        else:
            own.append([start, end + 1, n])
    if not spans:
        return []
    places = word_places(text)
    return [(k, a, b, places[a][0], places[b - 1][1], n, len(seq)) for k, own in spans.items() for a, b, n in _united(own)]


def _united(own: list[list[int]]) -> list[list[int]]:
    """Stretches found in order of their ends, those that touch made one."""
    out: list[list[int]] = []
    for a, b, n in own:
        while out and a <= out[-1][1]:
            p = out.pop()
            a, n = min(a, p[0]), max(n, p[2])
        out.append([a, b, n])
    return out


def document_spans(spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, start, end, longest_run, doc_words): the spans of all items and blocks united.

    A document's spans are as many as its own words at most.
    """
    so_far = Window.partitionBy(doc_id, "text_hash").orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(doc_id, "text_hash").orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, 0)
    single = spans.groupBy(doc_id, "text_hash", "start_word", "end_word", "start", "end", "doc_words").agg(F.max("longest_run").alias("longest_run"))
    marked = single.withColumn("_before", F.max("end_word").over(so_far))
    marked = marked.withColumn("_run", F.sum(F.when(F.col("start_word") <= F.col("_before"), 0).otherwise(1)).over(upto))
    return marked.groupBy(doc_id, "text_hash", "_run", "doc_words").agg(*[f(c).alias(c) for c, f in (("start_word", F.min), ("end_word", F.max), ("start", F.min), ("end", F.max), ("longest_run", F.max))]).drop("_run")


def _shares(spans: DataFrame, doc_id: str) -> DataFrame:
    united = document_spans(spans, doc_id)
    return united.groupBy(doc_id, "text_hash").agg(F.max("longest_run").alias("longest_run"), (F.sum(F.col("end_word") - F.col("start_word")) / F.max("doc_words")).alias("share"))


def contaminated(spans: DataFrame, doc_id: str = "doc_id", max_run: int = MAX_RUN, max_share: float = MAX_SHARE) -> DataFrame:
    """(doc_id, longest_run, share) of the documents with a run of max_run words, or more than max_share of the words leaked."""
    texts = _shares(spans, doc_id).where((F.col("longest_run") >= max_run) | (F.col("share") > max_share))
    return texts.groupBy(doc_id).agg(F.max("longest_run").alias("longest_run"), F.max("share").alias("share"))


def removed_spans(spans: DataFrame, doc_id: str = "doc_id", max_run: int = MAX_RUN, max_share: float = MAX_SHARE) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, start, end, whole): what has to go.

    Spans of which one item holds max_run words or more; and from start to end of its
    leaks every document (``whole``) of which more than max_share is covered.
    """
    united = document_spans(spans, doc_id)
    share = Window.partitionBy(doc_id, "text_hash")
    marked = united.withColumn("whole", F.sum(F.col("end_word") - F.col("start_word")).over(share) / F.col("doc_words") > max_share)
    return marked.where(F.col("whole") | (F.col("longest_run") >= max_run)).select(doc_id, "text_hash", "start_word", "end_word", "start", "end", "whole")


def without_leaks(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", max_run: int = MAX_RUN, max_share: float = MAX_SHARE) -> DataFrame:
    """The documents without what :func:`removed_spans` names; those that go as a whole are left out.

    A space stands where a span was. All other columns and rows stay as they are.
    """
    gone = removed_spans(spans, doc_id, max_run, max_share).groupBy(F.col(doc_id).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("whole").alias("_whole"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_gone"))
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(doc_text) == F.col("_hash")), "left").where("_whole is null or not _whole")
    # The pieces before, between and after the spans.
    first = F.transform("_gone", lambda g: g.end)
    starts = F.concat(F.array(F.lit(0)), first)
    ends = F.concat(F.transform("_gone", lambda g: g.start), F.array(F.length(doc_text)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col(doc_text), a + 1, b - a))
    return joined.withColumn(doc_text, F.when(F.col("_gone").isNotNull(), F.array_join(pieces, " ")).otherwise(F.col(doc_text))).select(*docs.columns)
