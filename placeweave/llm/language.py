"""Language identification: script ranges, byte n-gram scores by word, and Viterbi with a switching penalty (operator 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import text_chunks

#: Labelled documents of a language that a model is fitted on, about: the bound of the training sample.
TRAIN_DOCS = 2000
#: What a change of language between two words costs, in nats, and the most that one word may speak against a language.
SWITCH, CLIP = 24.0, 12.0
#: Counts added to every n-gram.
SMOOTH = 0.25
#: Slots of an n-gram table; two-byte grams fit exactly, longer ones are hashed.
SLOTS = 1 << 16
ORDERS = (2, 3, 4)
#: A language uses a script if so large a part of its training words is written in it.
SCRIPT_SHARE = 0.01

# First code point of blocks of scripts, from the Unicode standard; 0 is no script of its own.
SCRIPT_RANGES = (
    (0x00C0, 0x024F, 1), (0x0250, 0x02AF, 1), (0x1E00, 0x1EFF, 1),  # Latin; ASCII letters are looked up by byte
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2),  # Greek
    (0x0400, 0x052F, 3),  # Cyrillic
    (0x0530, 0x058F, 4),  # Armenian
    (0x0590, 0x05FF, 5),  # Hebrew
    (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6),  # Arabic
    (0x0900, 0x097F, 7),  # Devanagari
    (0x0980, 0x09FF, 8),  # Bengali
    (0x0E00, 0x0E7F, 9),  # Thai
    (0x10A0, 0x10FF, 10),  # Georgian
    (0x1100, 0x11FF, 11), (0xAC00, 0xD7AF, 11),  # Hangul
    (0x3040, 0x30FF, 12),  # Kana
    (0x3400, 0x4DBF, 13), (0x4E00, 0x9FFF, 13),  # Han
)
N_SCRIPTS = 14


def _script_table() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for first, last, script in SCRIPT_RANGES:
        out[first : last + 1] = script
    return out


_SCRIPTS = _script_table()
# bytes in an n-gram: ASCII letters in lower case and what is not ASCII; all else is a boundary
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals in lower case and boundaries for all that is no part of a word."""
    out = _FOLD[data]
    if len(out) > 1:
        high = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][high] += 0x20
    return out


def spans_of(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of words: runs without boundary, inside a row."""
    inside = np.zeros(len(folded) + 1, bool)
    inside[:-1] = folded != 32
    edge = np.zeros(len(folded) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends


def scripts_of(folded: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word's first character; 0 if it has none."""
    at = lambda k: folded[np.minimum(starts + k, len(folded) - 1)].astype(np.int64)
    a, b, c = at(0), at(1), at(2)
    point = np.where(a < 0xE0, (a & 0x1F) << 6 | b & 0x3F, np.where(a < 0xF0, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F, 0))
    return np.where(a < 128, 1, _SCRIPTS[np.minimum(point, 65535)])


def grams(folded: np.ndarray) -> list[np.ndarray]:
    """Slots of the 2-, 3- and 4-byte grams that begin one byte before each byte: a word's grams begin with its boundary."""
    x = np.full(len(folded) + 4, 32, np.uint32)
    x[1 : len(folded) + 1] = folded
    n = len(folded)
    two = x[:n] << np.uint32(8) | x[1 : n + 1]
    three = two << np.uint32(8) | x[2 : n + 2]
    four = three << np.uint32(8) | x[3 : n + 3]
    return [two, three * np.uint32(2654435761) >> np.uint32(16), four * np.uint32(2246822519) >> np.uint32(16)]


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # by order: SLOTS x languages, log probabilities
    scripts: np.ndarray  # N_SCRIPTS x languages, whether the language uses it

    def word_scores(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each word and language, the log likelihood less that of the word's best language, at least -CLIP."""
        found = grams(folded)
        out = np.empty((len(starts), len(self.languages)))
        for k in range(len(self.languages)):
            sums = np.zeros(len(folded) + 1)
            each = self.tables[0][k][found[0]] + self.tables[1][k][found[1]] + self.tables[2][k][found[2]]
            np.cumsum(each, out=sums[1:], dtype=np.float64)
            out[:, k] = sums[ends] - sums[starts]
        script = scripts_of(folded, starts)
        fits = self.scripts[script]
        known = fits.any(axis=1)
        out[~fits] = -np.inf
        out[~known] = 0.0
        out -= out.max(axis=1, keepdims=True)
        return np.maximum(out, -CLIP)


def labels_of(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word, where each change between neighbours costs `switch`; ties to the earlier language."""
    n, k = scores.shape
    total = scores.sum(axis=0)
    best = int(total.argmax())
    # no stretch of words gains half a switch by another language: then one language for all is best
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, [best]], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= switch / 2:
        return np.full(n, best)
    back = np.empty((n, k), np.int8 if k < 128 else np.int32)
    rows, run = scores.tolist(), [0.0] * k
    kinds = range(k)
    for i, row in enumerate(rows):
        top = max(kinds, key=run.__getitem__)
        enter = run[top] - switch
        for j in kinds:
            if run[j] >= enter:
                back[i, j] = j
                run[j] += row[j]
            else:
                back[i, j] = top
                run[j] = enter + row[j]
    at = max(kinds, key=run.__getitem__)
    out = np.empty(n, np.int64)
    for i in range(n - 1, -1, -1):
        out[i] = at
        at = back[i, at]
    return out


def train(docs: DataFrame, text: Column, lang: Column, usable: Column, key: Column, most: int = TRAIN_DOCS) -> Model:
    """A model fitted on about `most` documents of each language that `usable` allows, picked by a hash of `key`.

    Rows without text or language are not used. Without any usable row the model knows no language.
    """
    rows = docs.where(usable & text.isNotNull() & lang.isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], [np.zeros((0, SLOTS), np.float32)] * 3, np.zeros((N_SCRIPTS, 0), bool))
    million = 1_000_000
    share = F.lit(0)
    for x, n in counts.items():
        share = F.when(lang == x, F.lit(min(million, -(-most * million // n)))).otherwise(share)
    number = F.lit(0)
    for i, x in enumerate(languages):
        number = F.when(lang == x, F.lit(i)).otherwise(number)
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(million)) < share).select(number.cast("int").alias("lang"), text.alias("text")).repartition(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros((len(languages), len(ORDERS), SLOTS), np.int64)
        scripts = np.zeros((len(languages), N_SCRIPTS), np.int64)
        for batch in batches:
            which = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_chunks(batch.column(1)):
                for r in range(len(offsets) - 1):
                    folded = fold(data[offsets[r] : offsets[r + 1]])
                    starts, ends = spans_of(folded, np.array([0, len(folded)]))
                    if not len(starts):
                        continue
                    x, inside = which[first + r], folded != 32
                    for o, g in enumerate(grams(folded)):
                        slots[x, o] += np.bincount(g[inside], minlength=SLOTS)
                    scripts[x] += np.bincount(scripts_of(folded, starts), minlength=N_SCRIPTS)
        for x in np.flatnonzero(scripts.sum(axis=1)):
            yield pa.RecordBatch.from_pylist([{"lang": int(x), "slots": zlib.compress(slots[x].astype("<i4").tobytes(), 1), "scripts": scripts[x].tolist()}], pa.schema([("lang", pa.int32()), ("slots", pa.binary()), ("scripts", pa.list_(pa.int64()))]))

    slots = np.zeros((len(languages), len(ORDERS), SLOTS))
    scripts = np.zeros((len(languages), N_SCRIPTS))
    for r in sample.mapInArrow(run, "lang int, slots binary, scripts array<long>").toLocalIterator():  # a row a task and language
        slots[r["lang"]] += np.frombuffer(zlib.decompress(bytes(r["slots"])), "<i4").reshape(len(ORDERS), SLOTS)
        scripts[r["lang"]] += r["scripts"]
    logs = np.log((slots + SMOOTH) / (slots.sum(axis=2, keepdims=True) + SMOOTH * SLOTS)).astype(np.float32)
    uses = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True))
    uses[:, 0] = False
    return Model(languages, [np.ascontiguousarray(logs[:, o]) for o in range(len(ORDERS))], np.ascontiguousarray(uses.T))


UNKNOWN = "und"


def predictions(data: np.ndarray, offsets: np.ndarray, model: Model, switch: float, with_spans: bool) -> list[tuple[str, float, int, list[dict]]]:
    """(language, score, words, spans) of each row of a chunk."""
    languages = model.languages
    folded = fold(data)
    starts, ends = spans_of(folded, offsets)
    at = np.searchsorted(starts, offsets)
    letters = np.concatenate([[0], np.cumsum((folded >= 97) & (folded < 123))])
    scores = model.word_scores(folded, starts, ends) if len(starts) and languages else None
    out: list[tuple[str, float, int, list[dict]]] = []
    for r in range(len(offsets) - 1):
        a, b = int(at[r]), int(at[r + 1])
        no_ascii = letters[offsets[r + 1]] == letters[offsets[r]]
        if scores is None or a == b or no_ascii and not any(c.isalpha() for c in bytes(data[offsets[r] : offsets[r + 1]]).decode("utf-8", "replace")):
            out.append((UNKNOWN, 0.0, 0, []))
            continue
        found = labels_of(scores[a:b], switch)
        count = np.bincount(found, minlength=len(languages))
        top = int(count.argmax())
        spans = []
        if with_spans:
            turns = np.concatenate([[0], np.flatnonzero(np.diff(found)) + 1, [b - a]])
            spans = [{"first": int(i), "end": int(j), "lang": languages[found[i]]} for i, j in zip(turns[:-1], turns[1:], strict=True)]
        out.append((languages[top], float(count[top] / (b - a)), b - a, spans))
    return out


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, with_spans: bool = True) -> DataFrame:
    """Language of every row of docs(doc_id, text, ...): (doc_id, lang_pred, score, n_words, spans).

    Words are runs of letters; each is scored in the languages that use its script (in all if none does, all alike), and
    Viterbi labels the words with a penalty for changes. lang_pred is the label of most words, ties to the first in
    alphabetical order; score is its share of the words; spans lists (first word, end, lang) of runs of a label. A text
    that is null or has no letter is `und` with score 0 and no spans. Rows with null or repeated ids keep their own row;
    other columns are ignored; whole texts are read. With a model that knows no language all rows are `und`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                names, score, words, spans = zip(*predictions(data, offsets, model, switch, with_spans), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(names)), pa.array(names), pa.array(score, pa.float64()), pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))],
                    ["doc_id", "lang_pred", "score", "n_words", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, spans array<struct<first: long, end: long, lang: string>>")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, switch: float = SWITCH) -> DataFrame:
    """docs without the rows that are `und` or of which no language has the share `least` of the words; `lang` becomes the prediction.

    Columns and their names stay; `lang` must be one of them.
    """
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(text)):
                found = [(name, score) for name, score, _, _ in predictions(data, offsets, model, switch, False)]
                keep = [name != UNKNOWN and score >= least for name, score in found]
                part = batch.slice(first, len(found))
                yield part.set_column(lang, part.schema.field(lang), pa.array([name for name, _ in found], part.schema.field(lang).type)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs, F.col("text"), F.col("lang"), ~held_out(F.col("doc_id")), F.col("doc_id"))
