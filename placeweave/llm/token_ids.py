"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes (operator 4).

A file set is a folder with two Parquet tables. `ranks` (rank, id) lists the vocabulary by falling corpus frequency.
`blocks` holds, in ascending doc_id order, one row per block: `part` (range partition), `block` (within it), `first_id`
(ids of the part before the block), `doc_ids`, `lengths` (ids of each document), `control` (two bits an id: its bytes less
one, four ids a byte, low bits first) and `data` (each rank in 1 to 4 little-endian bytes). Spark's own writer commits the
files, so lost executors and retried tasks leave none half-written.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm.common import CHUNK_BYTES, text_chunks, word_spans
from placeweave.operators.graph import fresh_path, remove

#: Ids in a block, about: a block ends with the document that reaches it.
BLOCK_IDS = 1 << 18
#: Ids in a range partition, about.
PART_IDS = 1 << 24
#: Bytes of text whose distinct words are encoded together.
TOGETHER = 8 << 20

# The pre-tokeniser's pattern that WordBpe applies itself; with any other the library gets each distinct word.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Kinds of characters; of those of no kind the library is asked.
_ASK, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)
_NONE = np.int32(2**31 - 1)

#: Bytes of the four ids of each control byte.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of non-negative integers below 2**32."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    sizes = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers of pack, by table lookup on the control bytes."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... as many as sizes[0], and so on."""
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n and max(n, int(begin.max())) < 2**31 else np.int64
    out = np.arange(n, dtype=kind)
    out += np.repeat((begin - (ends - sizes)).astype(kind), sizes)
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct hash, which distinct hash each one is)."""
    which = pa.array(hashes).dictionary_encode().indices.to_numpy()  # numbered as they come first
    return np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1)), which


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of the characters below U+2100: Latin ones that no normalisation joins, and signs."""
    kind, lower = np.zeros(0x2100, np.uint8), np.arange(0x2100, dtype=np.uint32)
    for c in range(0x20, 0x2100):
        x = chr(c)
        sort = unicodedata.category(x)
        sign = 0x2010 <= c < 0x2028 or 0x2030 <= c < 0x205F or 0x20A0 <= c < 0x20C0
        if not (c < 0x250 or sign) or sort[0] in "CZM" or len(x.lower()) != 1 or unicodedata.normalize("NFC", x) != x:
            continue
        kind[c] = _LETTER if sort[0] == "L" else _NUMBER if sort[0] == "N" else _OTHER
        lower[c] = ord(x.lower())
    kind[0x20] = _SPACE
    return kind, lower


class WordBpe:
    """Encodes texts by a BPE vocabulary with word ends that drops white space; each distinct word of a run of texts once.

    Texts are cut at ASCII white space, where the vocabulary's pre-tokeniser cuts as well. Distinct words are cut on into
    pre-tokens and these merged side by side in columns: in each round every pre-token makes its first merge of lowest rank,
    which is the order of the library. Words with characters of no known kind, texts that hold an added token's string and
    all words of a vocabulary of another build go to the library.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.kind, self.lower = _kinds()
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        model = spec["model"]
        known = normal == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": PATTERN} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        if not (known and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["continuing_subword_prefix"] and not model["ignore_merges"] and not model["dropout"]):
            self.kind[:] = _ASK
            return
        vocabulary = model["vocab"]
        shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]  # ByteLevel's letters of bytes
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner, self.final = (np.array([vocabulary[letter[b] + end] for b in range(256)], np.int32) for end in ("", "</w>"))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self.base = np.int64(max(vocabulary.values()) + 1)
        keys = np.array([vocabulary[a] * int(self.base) + vocabulary[b] for a, b in merges], np.int64)
        self.bits, self.probes = 18, 1
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            k = 1
            while self.slot_key[at] >= 0:
                at, k = (at + 1) & ((1 << self.bits) - 1), k + 1
            self.slot_key[at], self.slot_rank[at], self.probes = key, rank, max(self.probes, k)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two symbols; _NONE where there is none."""
        keys = a.astype(np.int64) * self.base + b
        out, at, left = np.full(len(keys), _NONE, np.int32), self._slot(keys), None
        for _ in range(self.probes):
            here = at if left is None else at[left]
            found = self.slot_key[here]
            hit = found == (keys if left is None else keys[left])
            rest = np.flatnonzero(~hit & (found >= 0))
            hit = np.flatnonzero(hit)
            out[hit if left is None else left[hit]] = self.slot_rank[here[hit]]
            left = rest if left is None else left[rest]
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of pre-tokens given as bytes in a row, none of them empty."""
        symbol = self.inner[data]
        ends = np.cumsum(sizes)
        symbol[ends - 1] = self.final[data[ends - 1]]
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(symbol), _NONE, np.int32)
        inside = np.flatnonzero(of[1:] == of[:-1])
        rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(symbol)))
            over = np.repeat(best == _NONE, counts)
            if over.any():
                done.append((of[over], symbol[over]))
                stay = ~over
                symbol, rank, of, best, counts = symbol[stay], rank[stay], of[stay], best[best < _NONE], counts[best < _NONE]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, counts))
            at = at[np.concatenate([[True], of[at[1:]] != of[at[:-1]]])]
            symbol[at] = self.merged[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, rank, of = symbol[stay], rank[stay], of[stay]
            at -= np.arange(len(at))  # one symbol went behind each earlier place
            rank[at] = _NONE
            for left in (at[(at + 1 < len(of)) & (of[np.minimum(at + 1, len(of) - 1)] == of[at])], at[(at > 0) & (of[at - 1] == of[at])] - 1):
                rank[left] = self.ranks(symbol[left], symbol[left + 1])
        if not done:
            return np.empty(0, np.uint32), np.zeros(len(sizes), np.int64)
        of, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbol[np.argsort(of, kind="stable")].astype(np.uint32), np.bincount(of, minlength=len(sizes))

    def words(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of distinct words given as UTF-8, each followed by a space; sizes count its bytes with that."""
        raw = np.frombuffer(data, np.uint8)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
        kind = np.where(points < len(self.kind), self.kind[np.minimum(points, len(self.kind) - 1)], _ASK)
        ends = np.flatnonzero(points == 0x20)
        of = np.repeat(np.arange(len(sizes)), np.diff(np.concatenate([[-1], ends])))
        ask = np.zeros(len(sizes), bool)
        ask[of[kind == _ASK]] = True
        asked = np.flatnonzero(ask)
        at = np.cumsum(sizes) - sizes
        texts = [data[a : a + n - 1].decode("utf-8") for a, n in zip(at[asked].tolist(), sizes[asked].tolist(), strict=True)]
        given = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []
        begin, n_ids, flat = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.array([i for x in given for i in x], np.uint32)
        n_ids[asked] = [len(x) for x in given]
        begin[asked] = np.cumsum(n_ids[asked]) - n_ids[asked]
        keep = ~ask[of]
        points, kind, of = self.lower[points[keep]] if keep.any() else points[:0], kind[keep], of[keep]
        if not len(points):
            return flat[spans(begin, n_ids)], n_ids
        # pre-tokens: runs of a kind, numbers one by one, and an apostrophe alone with the ending that follows it
        start = (kind != _SPACE) & (np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == _NUMBER))
        mark = np.flatnonzero((points == ord("'")) & start)
        mark = mark[kind[mark + 1] == _LETTER]
        one, two = points[mark + 1], points[np.minimum(mark + 2, len(points) - 1)]
        is_ = lambda x, c: x == ord(c)
        size = np.where(is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d"), 1, np.where((is_(one, "r") | is_(one, "v")) & is_(two, "e") | is_(one, "l") & is_(two, "l"), 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + 1 + size
        start[after] |= kind[after] != _SPACE
        begins = np.flatnonzero(start)
        stop = np.flatnonzero(start | (kind == _SPACE))
        stops = stop[np.searchsorted(stop, begins, "right")]
        low = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        place = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800))])
        a, b = place[begins], place[stops]
        hashes, _, _, _ = word_spans(*_apart(low, a, b))
        some, which = distinct(hashes)
        tokens, n = self.merge(low[spans(a[some], (b - a)[some])], (b - a)[some])
        owner = of[begins]
        sizes_of = n[which]
        n_fast = np.bincount(owner, weights=sizes_of, minlength=len(sizes)).astype(np.int64)
        begin = np.where(ask, begin, len(flat) + np.cumsum(n_fast) - n_fast)
        flat = np.concatenate([flat, tokens[spans((np.cumsum(n) - n)[which], sizes_of)]])
        return flat[spans(begin, n_ids + n_fast)], n_ids + n_fast

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of texts, each ended by end_id, ids of each text)."""
        column = column.cast(pa.large_string()).fill_null("")
        added = np.zeros(len(column), bool)
        for token in self.added:
            added |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(added), "", column) if added.any() else column
        run: list[tuple] = []
        held = first = 0
        for row, data, offsets in text_chunks(plain, min(CHUNK_BYTES, TOGETHER)):
            run.append((data, *word_spans(data, offsets)))
            held += len(data)
            if held >= TOGETHER:
                yield first, *self._run(run, column, added, first)
                run, held, first = [], 0, row + len(offsets) - 1
        if run:
            yield first, *self._run(run, column, added, first)

    def _run(self, run: list[tuple], column: pa.Array, added: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        words = np.cumsum([0, *(len(r[1]) for r in run)])
        size = np.cumsum([0, *(len(r[0]) for r in run)])
        some, which = distinct(np.concatenate([r[1] for r in run]))
        data = np.concatenate([*(r[0] for r in run), np.array([0x20], np.uint8)])
        a, b = (np.concatenate([r[i] + size[j] for j, r in enumerate(run)])[some] for i in (3, 4))
        # words one after another, each with the space behind it; the last byte of data is one
        sizes = b - a + 1
        at = spans(a, sizes)
        at[np.cumsum(sizes) - 1] = len(data) - 1
        flat, n = self.words(data[at].tobytes(), sizes)
        ends = np.concatenate([r[2][1:] + words[j] for j, r in enumerate(run)])
        whole = np.flatnonzero(added[first : first + len(ends)])
        given = [self.tokenizer.encode(column[first + i].as_py(), add_special_tokens=False).ids for i in whole.tolist()]
        end = len(n) + len(given)
        flat = np.concatenate([flat, *(np.array(x, np.uint32) for x in given), np.array([self.end_id], np.uint32)])
        n = np.concatenate([n, np.array([*(len(x) for x in given), 1], np.int64)])
        row = np.concatenate([whole, np.arange(len(ends))])
        order = np.argsort(row, kind="stable")
        units = np.insert(which, ends[row[order]], np.concatenate([end - len(given) + np.arange(len(given)), np.full(len(ends), end)])[order])
        sizes = n[units]
        last = np.cumsum(sizes)[np.flatnonzero(units == end)]
        return flat[spans((np.cumsum(n) - n)[units], sizes)], np.diff(last, prepend=0)


def _apart(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of data one after another, as word_spans takes them: one word each, all bytes letters."""
    sizes = b - a
    return data[spans(a, sizes)], np.concatenate([[0], np.cumsum(sizes)]), np.ones(256, bool)


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> WordBpe:
    return WordBpe(path, end_id)


def stage_ids(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Writes (doc_id, tie, ids) of every text, in no order: its ids, end_id last, as little-endian integers of 2 or 4 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, end_id)
        kind = _kind(e.size)
        for batch in batches:
            for first, ids, lengths in e.encode(batch.column(2)):
                offsets = np.concatenate([[0], np.cumsum(lengths)]) * kind.itemsize
                lists = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                rows = batch.slice(first, len(lengths))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], ["doc_id", "tie", "ids"])

    out = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, ids binary")
    out.write.option("compression", "zstd").parquet(path)


def _kind(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _staged(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each row) of a column of stage_ids."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), np.diff(offsets) // kind.itemsize


def id_counts(staged: DataFrame, size: int) -> DataFrame:
    """(id, n): how often each id occurs in all texts; each task sends one row an id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_staged(batch.column(0), _kind(size))[0], minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["id", "n"])

    return staged.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2) -> None:
    """Writes the token ids of docs(doc_id, text, ...), each text ended by end_id, as a file set at `path`.

    A null text counts as empty. Documents go in ascending doc_id order, null first; equal ids in the order of a hash of
    their text. Other columns are ignored; an empty table gives a file set without blocks. Texts are never truncated.

    Texts are encoded once, where they lie. Their ids are staged in the shared folder, counted, and only they are put in order.
    """
    spark = docs.sparkSession
    staging = fresh_path(spark, "staged-ids")
    stage_ids(docs, vocabulary, end_id, staging)
    staged = spark.read.parquet(staging)
    size = encoder(vocabulary, end_id).size
    kind = _kind(size)
    counts = id_counts(staged, size).collect()  # one row an id of the vocabulary at most
    by_rank = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame([(r, i) for r, i in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, held, n_held = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held, n_held
            ids, lengths = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            control, data = pack(rank[ids])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            values = [part, block, first, len(ids), one(pa.concat_arrays([h[0] for h in held])), one(pa.array(lengths, pa.int64())), control, data]
            block, first, held, n_held = block + 1, first + len(ids), [], 0
            return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

        for batch in batches:
            ids, lengths = _staged(batch.column(1), kind)
            ends, row = np.cumsum(lengths), 0
            while row < len(lengths):
                begin = int(ends[row] - lengths[row])
                upto = min(len(lengths), int(np.searchsorted(ends, begin + BLOCK_IDS - n_held)) + 1)
                held.append((batch.column(0).slice(row, upto - row), ids[begin : ends[upto - 1]], lengths[row:upto]))
                n_held += int(ends[upto - 1]) - begin
                row = upto
                if n_held >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["n"] for r in counts) // PART_IDS))
    (
        staged.repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "ids")
        .mapInArrow(run, "part int, block int, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary")
        .write.parquet(f"{path}/blocks")
    )
    remove(spark, staging)


def _layout(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """The blocks, the id of each rank, and the ids before each part; the last two have a row an id and a part at most."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    before, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[r["part"]] = total
        total += r["n"]
    return blocks, ids, before


def _decoded(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            found = ids[unpack(row["control"], row["data"], row["n_ids"])]
            yield row, found, np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a file set; start counts the ids of all documents before."""
    blocks, ids, before = _layout(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, found, at in _decoded(batches, ids):
            start = before[row["part"]] + row["first_id"] + at[:-1]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), lists], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a file set: crc32 of each document's ids as little-endian 32-bit integers."""
    blocks, ids, before = _layout(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, found, at in _decoded(batches, ids):
            raw = memoryview(found.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            start = before[row["part"]] + row["first_id"] + at[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
