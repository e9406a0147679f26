"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method, forced-boundary splitting: a byte pair that occurs inside no vocabulary
token can never be merged over, so a cut there is certain. The pairs are read
off the vocabulary itself. Where such a pair is a printable ASCII byte followed
by white space it is also a border of the tokenizer's own pre-splitting, so the
text falls into short fragments that are encoded independently (each distinct
fragment once per worker) and concatenated. Fragments without such a border
(one very long "word") are pre-split by the tokenizer's pattern and then cut at
their inner forced pairs.

Null and empty texts both give the empty list. Strings that look like special
tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the published pre-splitting pattern of the 50k byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHED_CHARS, CACHED = 64, 200_000
LONG = 4096
SLICE = 500
MOST_BYTES = 64_000_000


def read_vocabulary(path: str, most: int = MOST_BYTES) -> bytes:
    """A file of base64 tokens and ranks, refused if it is too large to be sent to every worker."""
    if os.path.getsize(path) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    with open(path, "rb") as f:
        return f.read()


def load_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes to ids."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def inner_pairs(ranks: dict[bytes, int]) -> set[tuple[int, int]]:
    """Every byte pair that occurs inside some vocabulary token."""
    return {p for t in ranks for p in zip(t, t[1:])}


class ForcedEncoder:
    """Encodes texts to the ids of one byte-level BPE vocabulary, given as its path or its contents."""

    def __init__(self, vocabulary: str | bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = load_ranks(read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary)
        self.inner = inner_pairs(ranks)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pre = regex.compile(pattern)
        # Borders: printable ASCII before ASCII white space. Only left bytes whose pair with
        # every white space byte is forced count, which the vocabulary decides.
        spaces = b" \n\t\r"
        left = [b for b in range(0x21, 0x7F) if not any((b, s) in self.inner for s in spaces)]
        chars = "".join(rf"\x{b:02x}" for b in left)
        self.border = regex.compile(rf"(?<=[{chars}])(?=[ \n\t\r])") if left else None
        self.cache: dict[str, list[int]] = {}

    def _long_piece(self, piece: bytes) -> Iterator[int]:
        start = 0
        for i in range(1, len(piece)):
            if (piece[i - 1], piece[i]) not in self.inner:
                yield from self.bpe._encode_single_piece(piece[start:i])
                start = i
        yield from self.bpe._encode_single_piece(piece[start:])

    def _fragment(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.bpe.encode_ordinary(text)
        return [i for m in self.pre.finditer(text) for i in self._long_piece(m[0].encode("utf-8", "replace"))]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts = self.border.split(text) if self.border else [text]
        cache, out = self.cache, []
        if len(cache) > CACHED:
            cache.clear()
        for p in parts:
            ids = cache.get(p)
            if ids is None:
                ids = self._fragment(p)
                if len(p) <= CACHED_CHARS:
                    cache[p] = ids
            out.append(ids)
        return list(chain.from_iterable(out))


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids) of every row, ``ids`` an array of ints; other columns are ignored.

    The vocabulary file is read from ``folder`` by the driver and sent to the workers;
    nothing is shuffled. Repeated rows stay repeated.
    """
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(f"{folder}/{vocabulary}.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ForcedEncoder(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):  # small results, whatever the size of a batch
                b = whole.slice(at, SLICE)
                ids = [enc.encode(t) for t in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype="i8")
                flat = np.fromiter(chain.from_iterable(ids), "i4", ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], [id_col, "ids"])

    src = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
