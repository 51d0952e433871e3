"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import PLAIN, shingles_of, text_chunks, words_of
from placeweave.operators.graph import cut

#: Words of a seed. Every n-gram of an item is one, so any copied run of so many words holds one.
GRAM = 3
#: Alignment scores of equal and unequal words and of a gap, and the share of an item's best score that makes a leak.
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Bits of the filter that texts' n-grams pass before they are joined, and its hash functions.
FILTER_BITS, FILTER_HASHES = 1 << 23, 3


def _bits(grams: np.ndarray) -> list[np.ndarray]:
    return [(grams >> np.uint64(20 * i)) & np.uint64(FILTER_BITS - 1) for i in range(FILTER_HASHES)]


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, data, offsets in text_chunks(column):
        words, at, _ = words_of(data, offsets, PLAIN)
        for r in range(len(offsets) - 1):
            yield first + r, words[at[r] : at[r + 1]]


def item_grams(items: DataFrame) -> DataFrame:
    """(item_id, item_pos, gram) of every n-gram of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in _words(batch.column(1)):
                n = len(words) - GRAM + 1
                if n > 0 and batch.column(0)[row].is_valid:
                    grams = shingles_of(words, GRAM)[:n].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[row].as_py()), pa.int64()), pa.array(range(n), pa.int32()), pa.array(grams)], ["item_id", "item_pos", "gram"])

    return items.select("item_id", "text").mapInArrow(run, "item_id long, item_pos int, gram long")


def gram_filter(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size: each task sets bits, and the parts meet piece by piece."""
    pieces = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for b in _bits(batch.column(0).to_numpy().astype(np.uint64)):
                bits[b] = True
        packed = np.packbits(bits).reshape(pieces, -1)
        found = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([packed[i].tobytes() for i in found], pa.binary())], ["piece", "bits"])

    def join(group: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in group["bits"]])
        return pa.table([group["piece"][:1], pa.array([both.tobytes()], pa.binary())], names=["piece", "bits"])

    out = np.zeros((pieces, FILTER_BITS // 8 // pieces), np.uint8)
    parts = grams.select("gram").distinct().mapInArrow(run, "piece int, bits binary")
    for r in parts.groupBy("piece").applyInArrow(join, "piece int, bits binary").collect():  # 1 MB at any size
        out[r["piece"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def gram_hits(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, version, pos, gram): n-grams of texts that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(2)):
                words, at, _ = words_of(data, offsets, PLAIN)
                if len(words) < GRAM:
                    continue
                grams = shingles_of(words, GRAM)
                ok = np.ones(len(grams), bool)
                for b in _bits(grams):
                    ok &= (bits[b >> np.uint64(3)] >> (np.uint64(7) - (b & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
                found = np.flatnonzero(ok)
                row = np.searchsorted(at, found, "right") - 1
                inside = found + GRAM <= at[row + 1]
                found, row = found[inside], row[inside]
                if len(found):
                    rows = pa.array(first + row, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found - at[row], pa.int32()), pa.array(grams[found].astype(np.int64))], ["doc_id", "version", "pos", "gram"])

    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, "doc_id long, version long, pos int, gram long")


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The best local alignment of b inside a (Smith-Waterman, linear gaps): its score, and the end in a."""
    slope = np.arange(len(a) + 1) * -GAP
    row, best, end = np.zeros(len(a) + 1, np.int64), 0, 0
    for word in b:
        t = np.zeros(len(a) + 1, np.int64)
        t[1:] = np.maximum(row[:-1] + np.where(a == word, MATCH, MISMATCH), row[1:] + GAP)
        t = np.maximum(t, 0)
        row = np.maximum.accumulate(t + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, version, item_id, score, end_word) of every text and benchmark item that it holds a copy of, also an edited one.

    Words are of letters and digits (ASCII punctuation separates), A-Z in lower case. Seeds are all n-grams of an item, common
    ones too; texts that share a seed are aligned with the item around it, as far as an alignment of `threshold` can reach,
    unless the passage holds too few of the item's words for that. score is the alignment's share of the item's best
    (1: verbatim); from `threshold` on it is a leak. A copy without any GRAM words in a row of the item has no seed.
    version is a hash of the text. Null and empty texts and items, items of fewer than GRAM words and items without an id
    have no leaks; a null or repeated doc_id is kept as it is, equal rows once each; ties keep the first place in the text.
    Other columns are ignored.
    """
    grams = cut(item_grams(items))
    hits = gram_hits(docs, gram_filter(grams))
    shift = hits.join(grams, "gram").select("doc_id", "version", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    passages = shift.groupBy("doc_id", "version", "item_id").agg(F.collect_set("shift").alias("shifts"))
    wanted = passages.join(items.select("item_id", F.col("text").alias("item")).where("item_id IS NOT NULL AND item IS NOT NULL"), "item_id").select(F.col("doc_id").alias("id"), F.col("version").alias("of"), "item_id", "item", "shifts")
    texts = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    held = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("of"))).select("doc_id", "version", "item_id", "item", "shifts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, ends, scores = [], [], []
                for (row, words), (_, item) in zip(_words(part.column(5)), _words(part.column(3)), strict=True):
                    best, end, done = 0, 0, None
                    # words that an alignment of the threshold can have besides the item's
                    slack = int(MATCH * len(item) * max(0.0, 1 - threshold) / -GAP) + 1
                    for s in sorted(part.column(4)[row].as_py()):
                        if done is not None and s <= done:
                            continue
                        # one window for all seeds that begin close together
                        done = s + slack
                        low, high = max(0, s - slack), done + len(item) + slack
                        window = words[low:high]
                        if np.isin(item, window).sum() < threshold * len(item):
                            continue
                        found, to = align(window, item)
                        if found > best:
                            best, end = found, low + to
                    score = best / (MATCH * len(item)) if len(item) else 0.0
                    if score >= threshold:
                        ids.append(row)
                        scores.append(score)
                        ends.append(end)
                if ids:
                    keep = part.select(["doc_id", "version", "item_id"]).take(pa.array(ids, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(scores, pa.float64()), pa.array(ends, pa.int64())], ["doc_id", "version", "item_id", "score", "end_word"])

    return held.mapInArrow(run, "doc_id long, version long, item_id long, score double, end_word long")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; rows without text stay, columns and their names stay."""
    found = leaks(docs, items).select(F.col("doc_id").alias("id"), F.col("version").alias("of")).distinct()
    row = docs.select(F.struct("*").alias("row"))
    kept = row.join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("of")), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
