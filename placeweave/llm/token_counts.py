"""Token counts: exact byte-level BPE counts at every prefix by dynamic programming (operator 3)."""

from __future__ import annotations

import functools
import json
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pattern that byte-level BPE vocabularies of this kind split text with before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same with runs of other than white space left whole: what is between two matches never depends on either.
RUNS = r""" ?\S+|\s+(?!\S)|\s+"""
#: Runs whose results a worker remembers, at most; beyond it the memory starts anew, which changes no result.
CACHE = 500_000
#: Longest run, in characters, for which a worker remembers the result.
CACHED_CHARS = 64
NEVER = 1 << 60
#: Stands for the token before the first; no vocabulary has so many.
START = (1 << 20) - 1


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class PrefixCounter:
    """Counts tokens of every prefix of a text without encoding each of them.

    Within a piece, the encoding of a prefix is the encoding of a shorter prefix and one more token: the only one whose
    pair with the shorter prefix's last token the merges leave as two tokens. So last tokens and counts of all prefixes
    follow from one left-to-right pass. Across pieces, counts add up.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.ranks = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault((as_bytes(left), as_bytes(right)), r)
        self.parts = {a + b: (r, (a, b)) for (a, b), r in self.ranks.items()}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.longest = max(map(len, self.ids))
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.runs = regex.compile(RUNS)
        self.pair_ok: dict[int, bool] = {}
        self.totals: dict[str, int] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain merging; only to see whether a token stands when it is alone."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get((parts[i], parts[i + 1]), NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """What stands at the token's end (or beginning) while it is built, each with the rank of the merge that uses it up."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, pair = self.parts[token]
            token = pair[right]

    def together(self, last: int, token: int) -> bool:
        """Whether the merges leave `last` and `token`, side by side, as these two tokens; last is START before the first.

        They do unless some merge reaches across while both its sides still stand. Equal ranks happen from left to right.
        """
        if len(self.pair_ok) > 4 * CACHE:
            self.pair_ok.clear()
        if last == START:
            ok = self.merge(self.tokens[token]) == [self.tokens[token]]
        else:
            for t, right in ((last, True), (token, False)):
                if (t, right) not in self.spines:
                    self.spines[t, right] = self.spine(self.tokens[t], right)
            get, ok = self.ranks.get, True
            for x, x_until in self.spines[last, True]:
                for y, y_until in self.spines[token, False]:
                    r = get((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        ok = False
            ok = ok and self.stands(START, token)
        self.pair_ok[last << 20 | token] = ok
        return ok

    def stands(self, last: int, token: int) -> bool:
        ok = self.pair_ok.get(last << 20 | token)
        return self.together(last, token) if ok is None else ok

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for every i from 0 on."""
        last, count, ids, known, together, longest = [START << 20], [0], self.ids.get, self.pair_ok.get, self.together, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = ids(piece[start:end])
                if token is not None:
                    ok = known(last[start] | token)
                    if together(last[start] >> 20, token) if ok is None else ok:
                        last.append(token << 20)
                        count.append(count[start] + 1)
                        break
            else:
                raise ValueError("a byte is missing in the vocabulary")
        return count

    def total(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        return 1 if raw in self.ids and self.stands(START, self.ids[raw]) else self.piece_counts(raw)[-1]

    def run_total(self, run: str) -> int:
        """Tokens of a match of RUNS; the short ones are remembered."""
        n = self.totals.get(run)
        if n is None:
            n = 0
            for piece in self.pieces.findall(run):
                known = self.totals.get(piece)
                if known is None:
                    known = self.total(piece)
                    if len(piece) <= CACHED_CHARS:
                        self.totals[piece] = known
                n += known
            if len(run) <= CACHED_CHARS:
                if len(self.totals) >= CACHE:
                    self.totals.clear()
                self.totals[run] = n
        return n

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and these."""
        at = 0
        if self.split_special is not None and any(s in text for s in self.special):
            for m in self.split_special.finditer(text):
                yield text[at : m.start()], False
                yield m.group(), True
                at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        known, run_total, n = self.totals.get, self.run_total, 0
        for part, special in self.segments(text):
            if special:
                n += 1
                continue
            for run in self.runs.findall(part):
                found = known(run)
                n += run_total(run) if found is None else found
        return n

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i], counted alone, for every number i of characters from 0 on.

        Inside a special string a prefix is ordinary text, and a prefix may split otherwise than the text does: what
        follows the last piece boundary that both share is split anew there. That is a white-space run, an apostrophe
        ending or a special string at most, so the pass stays linear but for those.
        """
        out, base, special_starts = [0], 0, ""
        for part, special in self.segments(text):
            if special:
                out += [base + self._rest(special_starts, part[:i]) for i in range(1, len(part))] + [base + self.count(special_starts) + 1]
                base, special_starts = out[-1], ""
                continue
            before, tail = base, ""
            at = 0
            for m in self.pieces.finditer(part):
                piece = m.group()
                raw = piece.encode("utf-8", "surrogatepass")
                if piece.isspace() or piece[0] == "'":
                    out += [base + sum(map(self.total, self.pieces.findall(piece[:i]))) for i in range(1, len(piece) + 1)]
                else:
                    counts, b = self.piece_counts(raw), 0
                    for c in piece:
                        b += len(c.encode("utf-8", "surrogatepass"))
                        out.append(base + counts[b])
                tail_base, tail = base, piece
                base += self.total(piece)
                out[-1] = base
                at = m.end()
            # a special string that follows may be cut: its beginning continues the last piece
            special_starts = tail
            if tail:
                base = tail_base
            del before, at
        return out

    def _rest(self, tail: str, more: str) -> int:
        return sum(map(self.total, self.pieces.findall(tail + more)))

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens, with pieces split as in the whole text."""
        n = at = 0
        for part, special in self.segments(text):
            for run in [part] if special else self.runs.findall(part):
                more = 1 if special else self.run_total(run)
                if n + more > budget:
                    return at if special else at + self._fit(run, budget - n)
                n += more
                at += len(run)
        return at

    def _fit(self, run: str, budget: int) -> int:
        """Characters of a match of RUNS that fit."""
        at = 0
        for piece in self.pieces.findall(run):
            counts, b, fits = self.piece_counts(piece.encode("utf-8", "surrogatepass")), 0, 0
            for i, c in enumerate(piece, 1):
                b += len(c.encode("utf-8", "surrogatepass"))
                fits = i if counts[b] <= budget else fits
            if fits < len(piece):
                return at + fits
            at, budget = at + len(piece), budget - counts[-1]
        return at


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def answer(prefix_counts: list[int], budget: int) -> int:
    """The longest prefix (characters) of at most `budget` tokens, from stored counts that never fall."""
    return bisect_right(prefix_counts, budget) - 1


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_chars) of every row of docs(doc_id, text, ...).

    cut_chars is where to cut a text to at most `limit` tokens: the longest prefix (in characters) that fits, with pieces
    split as in the whole text. A null text counts as empty: no bytes, no tokens. Rows with a null or repeated doc_id keep
    their own row; other columns are ignored; an empty table gives an empty result. Texts are never truncated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1):
                    text = text.as_py() or ""
                    n = c.count(text)
                    rows.append((len(text.encode("utf-8", "surrogatepass")), n, n > limit, c.cut(text, limit) if n > limit else len(text)))
                cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, counts): tokens of every prefix, by its number of characters from 0 on; `answer` reads budgets off it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                counts = [c.prefix_counts(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, counts array<int>")
