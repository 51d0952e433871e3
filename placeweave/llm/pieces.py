"""SentencePiece encoding and decoding over a lattice of pieces (operator 9).

A task explodes the distinct words of its texts into substrings of bounded length, equi-joins these to the piece table by
hash and groups the edges found by word; a fold over each word's edges then picks the segmentation. The model at hand is a
BPE model: its right segmentation is the one that merging by score reaches, which is not the path of the best score sum,
so the fold merges. All words are folded together in columns. `fold_words` is the same over Spark rows, for tables of words.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm.common import mix

#: SentencePiece's mark of a space.
SPACE = "▁"
#: Words longer than this are merged one by one with a heap instead of in columns.
LONG = 96
#: Words that are folded at a time; together they stay below 2**20 characters.
TOGETHER = 10_000
#: Words that a worker remembers, at most; beyond it the memory starts anew, which changes no result.
REMEMBERED = 400_000
_NONE = np.int64(2**40)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def piece_rows(model: str) -> list[tuple[str, int, float]]:
    """(piece, id, score) of the pieces that text can become; byte, control and unknown pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(p.id_to_piece(i), i, p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]


class PieceEncoder:
    """Encodes texts as the library does for BPE models with byte fallback, identity normaliser and a space in front."""

    def __init__(self, model: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        rows = piece_rows(model)
        self.ids = {piece: i for piece, i, _ in rows}
        self.longest = max(map(len, self.ids))
        # merging order: higher scores first; pieces of equal score are one rank, and the leftmost comes first
        ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in rows}, reverse=True))}
        self.rank = {piece: ranks[s] for piece, _, s in rows}
        if any(SPACE in piece.lstrip(SPACE) or "\n" in piece for piece in self.ids):
            raise ValueError("a piece reaches over the ends of words")
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b""] * p.get_piece_size()
        for piece, i, _ in rows:
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        hashes = self.hash_of([piece for piece, _, _ in rows])
        self.bits = 20
        self.slot_hash, self.slot_rank, self.slot_id = self.table(hashes, np.array([ranks[s] for _, _, s in rows], np.int64), np.array([i for _, i, _ in rows], np.int64))
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        # entry 0: nothing, which ends a text; both arrays are filled up to self.used and double when they are full
        self.flat, self.at, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 1

    @staticmethod
    def hash_of(words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for i, w in enumerate(words):
            points = np.frombuffer(w.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
            h = np.zeros(1, np.uint64)
            for x in points:
                h = h * _BASE + x
            out[i] = mix(h)[0]
        return out

    def table(self, hashes: np.ndarray, ranks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The piece table by the low bits of a hash, with linear probing."""
        n = 1 << self.bits
        slot_hash, slot_rank, slot_id = np.zeros(n, np.uint64), np.full(n, _NONE), np.full(n, -1, np.int64)
        used = np.zeros(n, bool)
        self.probes = 1
        for h, r, i in zip(hashes.tolist(), ranks.tolist(), ids.tolist(), strict=True):
            at, k = h & (n - 1), 1
            while used[at]:
                at, k = (at + 1) & (n - 1), k + 1
            used[at], slot_hash[at], slot_rank[at], slot_id[at] = True, h, r, i
            self.probes = max(self.probes, k)
        return slot_hash, slot_rank, slot_id

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the pieces with these hashes; -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        at = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        for _ in range(self.probes):
            here = at[left]
            hit = self.slot_hash[here] == hashes[left]
            out[left[hit]] = here[hit]
            left = left[~hit & (self.slot_id[here] >= 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            if not len(left):
                break
        return out

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: set[str]) -> None:
        new = sorted(words)
        short = [w for w in new if len(w) <= LONG]
        found = {w: self.merged(w) for w in new if len(w) > LONG}
        for at in range(0, len(short), TOGETHER):
            found.update(zip(short[at : at + TOGETHER], self.fold(short[at : at + TOGETHER]), strict=True))
        base = self.used
        self.index.update(zip(new, range(base, base + len(new)), strict=True))
        ends = self.at[base] + np.cumsum([len(found[w]) for w in new])
        for name, need in (("flat", int(ends[-1])), ("at", base + len(new) + 1)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
        self.flat[self.at[base] : ends[-1]] = np.concatenate([found[w] for w in new])
        self.at[base + 1 : base + len(new) + 1] = ends
        self.used = base + len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text)."""
        split = [self.split(t) for t in texts]
        if len(self.index) > REMEMBERED:
            self.reset()
        new = {w for words in split for w in words if w not in self.index}
        if new:
            self.learn(new)
        get, index, counts = self.index.__getitem__, [], []
        for words in split:
            index.extend(map(get, words))
            index.append(0)
            counts.append(len(words) + 1)
        index = np.array(index, np.int64)
        sizes = self.at[index + 1] - self.at[index]
        ends = np.cumsum(sizes)
        where = np.repeat(self.at[index] - (ends - sizes), sizes) + np.arange(ends[-1])
        last = np.cumsum(counts) - 1
        return self.flat[where], np.diff(ends[last], prepend=0)

    def fold(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: lattice edges of all words, then merges of all words side by side."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        n = len(points)
        word = np.repeat(np.arange(len(words)), sizes)
        end_of = np.cumsum(sizes)[word]
        # edges: slot of the piece of each length at each place
        edges = np.full((self.longest + 1, n), -1, np.int32)
        h = np.zeros(n, np.uint64)
        for length in range(1, min(self.longest, int(sizes.max())) + 1):
            at = np.flatnonzero(np.arange(n) + length <= end_of)
            h[at] = h[at] * _BASE + points[at + length - 1]
            edges[length, at] = self.find(mix(h[at]))
        start, length, of = np.arange(n), np.ones(n, np.int64), word
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(start):
            together = length[:-1] + length[1:]
            slot = np.where((of[:-1] == of[1:]) & (together <= self.longest), edges[np.minimum(together, self.longest), start[:-1]], -1)
            key = np.full(len(start), _NONE << 20)
            key[:-1] = np.where(slot >= 0, self.slot_rank[slot] << 20, key[:-1]) + np.arange(len(start) - 1) % (1 << 20)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = np.minimum.reduceat(key, first)
            merges = best < (_NONE << 20)
            over = np.repeat(~merges, np.diff(np.append(first, len(start))))
            done.append((of[over], start[over], length[over]))
            at = best[merges] & ((1 << 20) - 1)
            length = length.copy()
            length[at] += length[at + 1]
            keep = ~over
            keep[at + 1] = False
            start, length, of = start[keep], length[keep], of[keep]
        of, start, length = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((start, of))
        of, start, length = of[order], start[order], length[order]
        slot = edges[np.minimum(length, self.longest), start]
        ids = np.where(slot >= 0, self.slot_id[slot], -1)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for w in np.unique(of[ids < 0]):
            # characters without a piece become their bytes
            mine: list[int] = []
            for i, s in zip(out[w].tolist(), (start[bounds[w] : bounds[w + 1]] - start[bounds[w]]).tolist(), strict=True):
                mine += [i] if i >= 0 else [self.byte_ids[b] for b in words[w][s].encode("utf-8", "surrogatepass")]
            out[w] = np.array(mine, np.int64)
        return out

    def merged(self, word: str) -> np.ndarray:
        """Ids of one long word: merges from a heap."""
        n, rank = len(word), self.rank
        ends, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := rank.get(word[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            alive[j], ends[i], after[i] = False, end, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                piece = word[i : ends[i]]
                out += [self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return np.array(out, np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, marks as spaces, bytes as UTF-8, without the space in front."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def encoder(model: str) -> PieceEncoder:
    return PieceEncoder(model)


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """(piece, id, rank): as many rows as the model has pieces; rank orders merges."""
    rows = piece_rows(model)
    ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in rows}, reverse=True))}
    return spark.createDataFrame([(p, i, ranks[s]) for p, i, s in rows], "piece string, id int, rank int")


def fold_words(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word, pieces) of distinct words(word), each beginning with its mark of a space: the lattice in rows.

    Words are exploded into substrings no longer than the longest piece, these joined to the piece table (of a fixed size),
    the edges grouped by word, and a higher-order aggregate takes the best merge of two neighbours as often as there is one.
    A null or empty word is left out; characters that are no piece stay as they are.
    """
    w = words.select("word").where("word <> ''").distinct()
    n, longest = F.length("word"), table.agg(F.max(F.length("piece"))).first()[0] or 1
    starts = w.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("size"))
    edges = spans.select("word", "s", (F.col("s") + F.col("size")).alias("t"), F.substring(F.col("word"), F.col("s") + 1, F.col("size")).alias("piece")).where("size > 1").join(F.broadcast(table), "piece")
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("rank", "s", "t")).alias("edges"))
    held = w.join(grouped, "word", "left").select("word", F.coalesce("edges", F.expr("CAST(array() AS array<struct<rank: int, s: int, t: int>>)")).alias("edges"))

    def step(cuts: Column, _: Column) -> Column:
        two = lambda e: F.array_contains(cuts, e["s"]) & F.array_contains(cuts, e["t"]) & (F.size(F.filter(cuts, lambda c: (c > e["s"]) & (c < e["t"]))) == 1)
        best = F.array_min(F.filter("edges", two))
        return F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= best["s"]) | (c >= best["t"])))

    cuts = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)
    out = held.select("word", F.explode(F.array(cuts)).alias("cuts"))
    return out.select("word", F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.substring(F.col("word"), F.element_at("cuts", i) + 1, F.element_at("cuts", i + 1) - F.element_at("cuts", i))).alias("pieces"))


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every row of docs(doc_id, text, ...), without begin and end pieces.

    A null or empty text has no ids. Rows with null or repeated ids keep their own row, other columns are ignored, an empty
    table gives an empty result, and whole texts are encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, sizes = e.encode([t or "" for t in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text. A U+2581 in an encoded text comes back as a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [None if x.as_py() is None else e.decode(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens, ids_crc32, round_trip): of each text encoded and decoded again.

    round_trip says whether the decoded text is the text, with U+2581 as a space. Cases as in encode_pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, sizes = e.encode(texts)
                ends, flat = np.cumsum(sizes), ids.tolist()
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans]
                same = [e.decode(flat[a:b]) == t.replace(SPACE, " ") for (a, b), t in zip(spans, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_chars", "n_tokens", "ids_crc32", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long, ids_crc32 long, round_trip boolean")
