"""Names, tokens, phrases and similarities as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from placeweave import config as C

# Letters with marks and what is left of them without, from the Unicode standard.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŹźŻżŽž"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiNnNnOoOoRrSsSsSsTtUuUuUuZzZzZz"


def strip_accents(value: Column) -> Column:
    """Latin letters without their marks; combining marks are dropped."""
    return F.regexp_replace(F.translate(value, _MARKED, _PLAIN), r"[̀-ͯ]", "")


def name_key(name: Column) -> Column:
    """The matching key of a name: plain lower-case words without noise words, unless there are no others."""
    words = F.filter(F.split(F.regexp_replace(F.lower(strip_accents(name)), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*C.NOISE_TOKENS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def distinctive_tokens(key: Column) -> Column:
    """Words of a key that identify a place, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda w: (F.length(w) >= C.DISTINCTIVE_LENGTH) & ~w.isin(*C.GENERIC_TOKENS))))


def trigrams(key: Column) -> Column:
    """Distinct three-letter pieces of a key's words, each word with two spaces before and one after."""
    words = F.filter(F.split(key, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements by all elements of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(text)), 256)


def synthetic_id(source: str, *parts: Column) -> Column:
    return F.concat(F.lit(source + ":"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 20))


def tokens(text: Column) -> Column:
    """Lower-case words and clause ends."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_']+|[.!?;:])"), F.lit(1))


# Words that deny what follows, ends of clauses, and how far denial reaches.
NEGATORS = (
    "no", "not", "never", "none", "without", "isnt", "isn't", "arent", "aren't", "wasnt", "wasn't", "dont", "don't", "doesnt", "doesn't",
    "didnt", "didn't", "cant", "can't", "cannot", "wont", "won't", "hardly", "barely", "avoid", "skip", "lacks", "lacking", "anything", "far", "less",
)
CLAUSE_ENDS = (".", "!", "?", ";", ":", "but", "however", "though", "although")
REACH = 6


def phrase_starts(words: Column, phrase: Column) -> Column:
    """0-based places where the words of `phrase` (an array) occur one after another."""
    m = F.size(phrase)
    places = F.sequence(F.lit(0), F.size(words) - m)
    return F.when((m > 0) & (F.size(words) >= m), F.filter(places, lambda i: F.slice(words, i + 1, m) == phrase)).otherwise(F.expr("CAST(array() AS array<int>)"))


def negated(words: Column, at: Column) -> Column:
    """Whether a negator stands within REACH words before, with no clause end between."""
    before = F.reverse(F.slice(words, F.greatest(F.lit(0), at - REACH) + 1, F.least(at, F.lit(REACH))))
    nearest = F.try_element_at(F.filter(before, lambda w: w.isin(*NEGATORS, *CLAUSE_ENDS)), F.lit(1))
    return F.coalesce(nearest.isin(*NEGATORS), F.lit(False))


def phrase_hits(words: Column, phrase: Column) -> Column:
    """Occurrences of a phrase that nothing denies."""
    return F.size(F.filter(phrase_starts(words, phrase), lambda i: ~negated(words, i)))


# ---------------------------------------------------------------- fuzzy similarity of names


def _places(a: str) -> dict[str, int]:
    """Where each letter stands, as bits."""
    out: dict[str, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _lcs(places: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of a text of n letters, given by its places, and b: a row of the table is one integer."""
    full = (1 << n) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence by both lengths."""
    return 2 * _lcs(_places(a), len(a), b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a window of the longer one, cut off at both ends as well."""
    short, long = sorted((a, b), key=len)
    n, places = len(short), _places(short)
    if short and short in long:
        return 1.0
    best = 0.0
    for w in {long[max(0, i) : i + n] for i in range(1 - n, len(long))} - {""}:
        if 2 * min(n, len(w)) > best * (n + len(w)):
            best = max(best, 2 * _lcs(places, n, w) / (n + len(w)))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words alone and with each side's other words; 1 if one side has no others."""
    x, y = set(a.split()), set(b.split())
    shared = " ".join(sorted(x & y))
    one, two = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not one or not two):
        return 1.0
    left, right = f"{shared} {one}".strip(), f"{shared} {two}".strip()
    found = [ratio(left, right)]
    if shared:
        found += [ratio(shared, left), ratio(shared, right)]
    return max(found)


def similarity(a: str | None, b: str | None) -> float:
    """Names' similarity: the mean of the more generous of two ratios and the strict one; 0 for an empty name."""
    if not a or not b:
        return 0.0
    generous = token_set_ratio(a, b)
    return (max(generous, partial_ratio(a, b) if generous < 1 else 0.0) + ratio(a, b)) / 2


@F.pandas_udf(DoubleType())
def name_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """similarity of two keys, each distinct pair of a batch once."""
    for left, right in pairs:
        known = {p: similarity(*p) for p in set(zip(left, right, strict=True))}
        yield pd.Series([known[p] for p in zip(left, right, strict=True)], dtype="float64")


# ---------------------------------------------------------------- sources' texts


def tidy(text: Column) -> Column:
    """White space made single, and punctuation trimmed off the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ .,;:\-–]+|[ .,;:\-–]+$", "")


def tidy_name(text: Column) -> Column:
    return tidy(F.regexp_replace(text, r"\[[^\]]*\]", " "))


def price_tier(text: Column) -> Column:
    """Tier 1 to 4 of a price in words: symbols, free, or an amount."""
    t = F.trim(text)
    amount = F.try_to_number(F.replace(F.regexp_extract(t, r"[€$]\s?(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")), F.lit("99999999.99999")).cast("double")
    return (
        F.when(t.rlike(r"^[€$]{1,4}$"), F.length(t))
        .when(F.lower(t).startswith("free"), 1)
        .when(amount <= 12, 1)
        .when(amount <= 30, 2)
        .when(amount <= 60, 3)
        .when(amount.isNotNull(), 4)
    )


# Parts of a source's types and the category they stand for, the first that fits counts.
MAP_TYPES = (
    ("night_club", "nightlife"), ("bar", "bar"), ("cafe", "cafe"), ("coffee_shop", "cafe"), ("bakery", "cafe"), ("museum", "museum"), ("art_gallery", "museum"),
    ("park", "park"), ("zoo", "attraction"), ("tourist_attraction", "attraction"), ("historical_landmark", "attraction"), ("church", "attraction"),
    ("stadium", "attraction"), ("food_court", "restaurant"), ("market", "restaurant"), ("shopping_mall", "shopping"), ("store", "shopping"),
    ("lodging", "hotel"), ("hotel", "hotel"), ("restaurant", "restaurant"), ("food", "restaurant"),
)
LISTING_TYPES = (
    ("nightlife", "nightlife"), ("danceclub", "nightlife"), ("flamenco", "nightlife"), ("jazzandblues", "nightlife"), ("cocktailbar", "bar"), ("wine_bar", "bar"),
    ("bars", "bar"), ("pubs", "bar"), ("coffee", "cafe"), ("cafes", "cafe"), ("bakeries", "cafe"), ("museums", "museum"), ("parks", "park"), ("landmarks", "attraction"),
    ("tours", "attraction"), ("hotels", "hotel"), ("shopping", "shopping"), ("restaurants", "restaurant"), ("tapas", "restaurant"), ("spanish", "restaurant"),
    ("asianfusion", "restaurant"), ("desserts", "cafe"), ("food_court", "restaurant"), ("markets", "restaurant"), ("food", "restaurant"),
)


def _contains(part: str):
    return lambda t: t.contains(part)


def category(types: Column, table: tuple[tuple[str, str], ...], primary: Column | None = None) -> Column:
    """The category of the first table row that is part of a type; the primary type is tried alone first."""
    out = None
    if primary is not None:
        for part, name in table:
            hit = F.lower(primary).contains(part)
            out = F.when(hit, name) if out is None else out.when(hit, name)
    low = F.transform(types, F.lower)
    for part, name in table:
        hit = F.exists(low, _contains(part))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")
