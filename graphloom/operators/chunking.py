"""Texts to chunks: sections at headings, long sections to overlapping windows."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings
from graphloom.functions.text import header_sections, normalize_text, strip_outer

# Where a window may end, best first: behind a paragraph, a sentence, a line, a word.
MARKS = ("\n\n", ". ", "? ", "! ", "\n", " ")


def _places(text: str) -> list[list[int]]:
    """For each mark the offsets behind all its occurrences, overlapping ones too."""
    return [[m.start() + len(mark) for m in re.finditer(f"(?={re.escape(mark)})", text)] for mark in MARKS]


def _spans(length: int, places: list[list[int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows: each ends at the best mark in its second half, and the next begins ``overlap`` before it."""
    start = 0
    while start < length:
        reach = start + size
        end = length
        if reach < length:
            # Of each mark the last one that lies whole between the middle and the reach of the window.
            last = ((mark, own, bisect_right(own, reach)) for mark, own in zip(MARKS, places))
            end = next((own[n - 1] for mark, own, n in last if n and own[n - 1] - len(mark) >= start + size // 2), reach)
        yield start, end
        start = end - (overlap if overlap < end - start else 0)


def windows(text: str, size: int, overlap: int, shortest: int) -> list[str]:
    """Overlapping stripped windows of a long section.

    The last ``overlap`` characters come once more as a window of their own when
    the window that reaches the end is wider than that.
    """
    pieces = (text[a:b].strip() for a, b in _spans(len(text), _places(text), size, overlap))
    return [p for p in pieces if len(p) >= shortest]


def chunk_texts(text: Column, s: Settings = DEFAULTS) -> Column:
    """The chunks of a text in order, as an array; null text gives an empty array.

    Short sections are dropped and fitting ones kept whole by built-in
    functions; only sections longer than a chunk go through Python.
    """

    @F.pandas_udf("array<string>")
    def split(sections: pd.Series) -> pd.Series:
        return sections.map(lambda own: [w for x in own for w in (windows(x, s.chunk_size, s.chunk_overlap, s.min_chunk_length) if len(x) > s.chunk_size else [x])])

    sections = F.filter(F.transform(header_sections(normalize_text(F.coalesce(text, F.lit("")))), strip_outer), lambda x: F.length(x) >= s.min_chunk_length)
    return F.when(F.exists(sections, lambda x: F.length(x) > s.chunk_size), split(sections)).otherwise(sections)


def chunk_id(path: Column, index: Column) -> Column:
    """An id that is the same on every run and retry."""
    return F.sha2(F.concat_ws("\x01", path, index.cast("string")), 256)


def chunk_documents(docs: DataFrame, s: Settings = DEFAULTS, doc_id: str = "id", path: str = "source_path", content: str = "raw_content") -> DataFrame:
    """(chunk_id, source_document_id, text, chunk_index, metadata) of all documents.

    chunk_index counts before any quality filter, so gaps may follow.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("source_document_id"), F.col(path).alias("_path"), F.posexplode(chunk_texts(F.col(content), s)).alias("chunk_index", "text"))
    return rows.select(chunk_id(F.coalesce(F.col("_path"), F.lit("")), F.concat_ws("/", "source_document_id", "chunk_index")).alias("chunk_id"), "source_document_id", "text", "chunk_index", F.create_map(F.lit("source"), "_path").alias("metadata"))
