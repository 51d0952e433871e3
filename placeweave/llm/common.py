"""Helpers shared by the training-data operators: tables and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What separates words: space and U+0009 to U+000D. All are single bytes in UTF-8.
SPACES = b"\t\n\x0b\x0c\r "
#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[list(SPACES)] = False
#: Bytes of words when punctuation separates as well: ASCII letters and digits, and all that is not ASCII.
PLAIN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Odd multipliers of the places in a shingle.
_PLACES = np.array([(0xD6E8FEB86659FD93 * (2 * k + 1) ^ (k << 40)) | 1 & (2**64 - 1) for k in range(64)], dtype=object)
_PLACES = np.array([int(x) % 2**64 | 1 for x in _PLACES], dtype=np.uint64)
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n + 1:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            step = np.full(n + 1, base, np.uint64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes together, at least one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, A-Z in lower case, the first word of each row (and one more entry), and the words' first bytes and ends."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    data = _LOWER[data]
    word = letters[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _power_tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return hashes, np.searchsorted(starts, offsets, "left"), starts, ends


def words_of(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first three of word_spans."""
    return word_spans(data, offsets, letters)[:3]


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles that begin at each word; the last k-1 are meaningless."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        out[: n - j] += words[j:] * _PLACES[j]
    return mix(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): k-word shingles; with fewer words, the whole sequence as one; none without words."""
    for first, data, offsets in text_chunks(column):
        words, at, _ = words_of(data, offsets)
        grams = shingles_of(words, k)
        for r in range(len(offsets) - 1):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= k:
                yield first + r, np.unique(grams[a : b - k + 1])
            elif b > a:
                short = np.array([b - a], np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64)
                yield first + r, mix(short)
            else:
                yield first + r, np.empty(0, np.uint64)
