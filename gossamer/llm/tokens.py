"""Byte-level BPE of whole texts, from a public vocabulary of ranks.

A text is cut into pieces by the vocabulary's published pattern.  The merges of
a piece run on a segment tree over its byte positions: each leaf holds the rank
of the pair that starts there, each inner node the smallest rank below it, the
left one on ties.  A merge descends to the leftmost minimum and updates three leaves:
its own, its left neighbour's and the one swallowed.  So a piece of n bytes
costs O(n log n), however long it is.  Pieces seen before come from a bounded table.

Defined results: empty and null texts give an empty list; strings that look like
special tokens are ordinary text; repeated rows each give a row; other columns
are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
#: The published splitting pattern of the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept per task, and the longest piece that is kept.
KEPT, KEPT_BYTES = 200_000, 64
NONE = 1 << 30


def load_ranks(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    """Token bytes to rank, read on the driver (a fixed half megabyte, sent to the tasks)."""
    with open(f"{folder}/{name}", "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece by rank-ordered merges, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    ends = list(range(1, n + 1))  # of the token that starts at i
    before = list(range(-1, n - 1))  # start of the token to the left
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] != NONE:
        low, k = tree[1], 1
        while k < size:
            k *= 2
            if tree[k] != low:
                k += 1
        i = k - size
        j = ends[i]
        end = ends[i] = ends[j]
        put(j, NONE)
        if end < n:
            before[end] = i
            put(i, get(piece[i : ends[end]], NONE))
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            put(h, get(piece[h:end], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Encoder(dict):
    """Pieces to ids; also the bounded table of pieces seen before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        ids = merge_piece(raw, self.ranks)
        if len(raw) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.split(text)))) if text else 0


#: Rows encoded before a batch is handed on.
ROWS = 1000


def _over_texts(ranks, make, column: pa.DataType, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks.value)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                made = [make(enc, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(made, column)], ["doc_id", name])

    return run


def _ranks(spark: SparkSession, folder: str, name: str):
    return spark.sparkContext.broadcast(load_ranks(folder, name))


def encode(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) of every document."""
    run = _over_texts(_ranks(documents.sparkSession, folder, name), lambda e, t: e.encode(t), pa.list_(pa.int32()), "ids")
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n) of every document; 0 for empty and null texts."""
    run = _over_texts(_ranks(documents.sparkSession, folder, name), lambda e, t: e.count(t), pa.int64(), "n")
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint")
