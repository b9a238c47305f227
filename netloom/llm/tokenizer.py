"""Byte-pair encoding of whole texts with a public vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabularies, the same on all machines.
TOKENIZERS = "/opt/tokenizers"
#: How byte_bpe_50k splits text before merging (a fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps; beyond that it starts anew.
KEPT_PIECES = 1_000_000
_NONE = 1 << 62


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of least rank, leftmost first, is merged until no pair has a rank.

    A segment tree over byte positions holds in each node the least of (rank, position) below it. Position i stands for
    the pair of the part that begins at i and the part after it; a merge changes two pairs, of the part merged and of its
    live left neighbour, and takes one away, each in logarithmic time, so a piece of n bytes takes n log n.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next and the previous live part begin

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] < _NONE:
        i = tree[1] & 0xFFFFFFFF
        gone = after[i]
        end = after[i] = after[gone]
        put(gone, _NONE)
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
        else:
            r = None
        put(i, _NONE if r is None else r << 32 | i)
        left = before[i]
        if left >= 0:
            r = get(piece[left:end])
            put(left, _NONE if r is None else r << 32 | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pieces(dict):
    """Ids of pieces seen so far."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple(merge(raw, self.ranks))
        if len(self) >= KEPT_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(1)
def pieces(path: str) -> Pieces:
    """The vocabulary of a rank file, once per worker."""
    with open(path, "rb") as f:
        return Pieces({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(texts: list[str | None], path: str) -> pa.ListArray:
    """Ids of whole texts, special tokens' strings being ordinary text; null and empty texts give empty lists."""
    known, split = pieces(path), regex.compile(PATTERN).findall
    parts = [np.fromiter(chain.from_iterable(map(known.__getitem__, split(t))), np.int32) if t else np.empty(0, np.int32) for t in texts]
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``key`` and ``ids`` of every row of ``df``.

    Null and empty texts give an empty list, rows with a null key keep it, repeated rows come out as often as they stand,
    an empty table gives none; texts of any length are encoded whole; other columns, also one named ``ids``, are dropped.
    Nothing is shuffled: a scan with two columns feeds Arrow batches to the encoder.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.record_batch({key: part.column(0), "ids": encode(part.column(1).to_pylist(), path)})

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, ids array<int>")
