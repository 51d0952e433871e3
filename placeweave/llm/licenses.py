"""Licence scans: Dice coefficient over word bigrams against templates, in DataFrame functions only (operator 7)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Similarity from which a passage counts as a template.
THRESHOLD = 0.8

# Notices in common use and short licences in full, from the licences' public texts.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", _BSD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_WARRANTY),
)
TEMPLATES += (("MIT", next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100) + _MIT_WARRANTY),)


def bag(text: str) -> list[str]:
    """Numbered word bigrams of a template: the n-th of its kind ends in #n, so that set operations count repeats."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return [f"{p}#{pairs[: i + 1].count(p)}" for i, p in enumerate(pairs)]


def _signs(known: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which a unit that reaches the threshold for some template has one: without them too few of its bigrams are left."""
    out: set[str] = set()
    for _, b in known:
        pairs = [p.split("#")[0].split() for p in b]
        for word in sorted({w for p in pairs for w in p}, key=lambda w: (-len(w), w)):
            if sum(out.isdisjoint(p) for p in pairs) < len(pairs) * threshold / (2 - threshold):
                break
            out.add(word)
    return sorted(out)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generator's output is not copied into the expressions that use it."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def _let(value: Column, f) -> Column:
    """f(value) with value computed once, inside of a higher-order function too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pairs(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)))


def _numbered(pairs: Column) -> Column:
    return F.transform(pairs, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(pairs, 1, i + 1), lambda y: y == x)).cast("string")))


def _dice(words: Column, t: Column, threshold: float) -> Column:
    """Dice of a unit of two words or more and a template; 0 where the distinct bigrams in common already rule the threshold out."""

    def of(pairs: Column) -> Column:
        both = t["n"] + F.size(pairs)
        bound = F.size(F.array_intersect(t["pairs"], pairs)) + t["n"] - F.size(t["pairs"])
        return F.when(2.0 * bound / both >= threshold, 2.0 * F.size(F.array_intersect(t["bag"], _numbered(pairs))) / both).otherwise(0.0)

    return _let(_pairs(words), of)


def _fits(n: Column, t: Column, threshold: float) -> Column:
    """Whether so many bigrams allow the threshold."""
    return (t["n"] * (2 - threshold) >= n * threshold) & (n * (2 - threshold) >= t["n"] * threshold)


def _line_hits(known: Column, threshold: float, least: float, most: float, sign: str) -> Column:
    """(line, license, dice) of the lines of a text, and of the whole text if it has several, that are like a template."""
    several = F.when(F.size("parts") > 1, F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("unit")))).otherwise(F.array().cast("array<struct<line:int,unit:string>>"))
    units = F.filter(F.concat(F.transform("parts", lambda x, i: F.struct(i.alias("line"), x.alias("unit"))), several), lambda u: F.lower(u["unit"]).rlike(sign))
    split = F.transform(units, lambda u: F.struct(u["line"].alias("line"), F.split(_normal(u["unit"]), " ").alias("words")))
    sized = F.filter(split, lambda u: (F.size(u["words"]) > 1) & (F.size(u["words"]) - 1).between(least, most))

    def best(u: Column) -> Column:
        share = lambda bag, t: (2.0 * F.size(F.array_intersect(t["bag"], bag)) / (t["n"] + F.size(bag))).alias("dice")
        scored = lambda bag: F.transform(F.filter(known, lambda t: _fits(F.size(bag), t, threshold)), lambda t: F.struct(share(bag, t), t["license"].alias("license")))
        return F.struct(u["line"].alias("line"), _let(_pairs(u["words"]), lambda pairs: _let(_numbered(pairs), lambda bag: F.array_max(scored(bag)))).alias("best"))

    found = F.filter(F.transform(sized, best), lambda u: u["best"]["dice"] >= threshold)
    return F.transform(found, lambda u: F.struct(u["line"].alias("line"), u["best"]["license"].alias("license"), u["best"]["dice"].alias("dice")))


def _passages(texts: DataFrame, known: Column, every: Column, threshold: float) -> DataFrame:
    """texts(parts, ...) with passages (every: all templates' bigrams): (line, license, dice) of runs of consecutive lines, blank ones not counted, that are like a template.

    Of runs that share a line the most similar counts, and only if none of its lines is as much like that template. The run of
    all lines is the whole text, which is a unit of its own.
    """
    lines = F.filter(F.transform("parts", lambda x, i: F.struct(i.alias("line"), _normal(x).alias("unit"))), lambda x: x["unit"] != "")
    kept = _computed(texts, "lines", lines)
    pairs = F.flatten(F.transform("lines", lambda x: F.split(x["unit"], " ")))
    pairs = F.when(F.size("lines") > 1, _let(pairs, lambda w: F.when(F.size(w) > 1, _pairs(w))))
    # of all templates' bigrams those of the text: a small set, held against each template's
    kept = _computed(kept, "shared", F.array_intersect(every, pairs))
    present = lambda t: F.size(F.array_intersect(t["pairs"], F.col("shared"))) + t["n"] - F.size(t["pairs"])
    near = F.when(F.size("shared") > 0, F.filter(known, lambda t: present(t) * (2 - threshold) >= t["n"] * threshold))
    near = _computed(kept, "near", F.coalesce(near, F.filter(known, lambda t: F.lit(False))))
    any_near = F.size("near") > 0
    near = _computed(near, "words", F.when(any_near, F.transform("lines", lambda x: F.split(x["unit"], " "))))
    upto = F.aggregate("words", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(x))))
    near = _computed(near, "upto", upto)
    count = F.size("words")

    def runs(t: Column) -> Column:
        alone = F.transform("words", lambda w: F.when((F.size(w) > 1) & _fits(F.size(w) - 1, t, threshold), _dice(w, t, threshold)).otherwise(0.0))
        last = lambda i: F.least(count, i + F.ceil(t["n"] * (2 - threshold) / threshold).cast("int") + 1)
        size = lambda i, j: F.element_at("upto", j + 1) - F.element_at("upto", i) - 1
        ends = lambda i: F.filter(F.sequence(i, last(i)), lambda j: (j > i) & _fits(size(i, j), t, threshold))
        scored = lambda i, j: F.struct(i.alias("i"), j.alias("j"), t["license"].alias("license"), _dice(F.flatten(F.slice("words", i, j - i + 1)), t, threshold).alias("dice"))
        found = F.flatten(F.transform(F.sequence(F.lit(1), count), lambda i: F.transform(ends(i), lambda j: scored(i, j))))
        better = lambda alone: F.filter(found, lambda r: (r["dice"] >= threshold) & (r["dice"] > F.array_max(F.slice(alone, r["i"], r["j"] - r["i"] + 1))))
        return _let(alone, better)

    near = _computed(near, "runs", F.when(any_near, F.array_distinct(F.flatten(F.transform("near", runs)))))
    order = lambda r: F.struct(-r["dice"], r["i"], r["j"])
    beats = lambda o, r: (o["i"] <= r["j"]) & (o["j"] >= r["i"]) & ((order(o) < order(r)) | (order(o) == order(r)) & (o["license"] > r["license"]))
    best = F.filter("runs", lambda r: ~F.exists("runs", lambda o: beats(o, r)) & ~((r["i"] == 1) & (r["j"] == count)))
    named = F.transform(best, lambda r: F.struct(F.element_at("lines", r["i"])["line"].alias("line"), r["license"].alias("license"), r["dice"].alias("dice")))
    return near.withColumn("passages", F.coalesce(named, F.array().cast("array<struct<line:int,license:string,dice:double>>")))


def licence_hits(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line, license, dice): every line, every whole text of several lines (line -1) and every passage of consecutive
    lines (line: its first), like some template.

    Text is compared in lower case with words of a-z and 0-9. dice is twice the shared bigrams, repeats counted, by the
    bigrams of both; only templates whose size allows the threshold are compared. The best template is named, ties to
    the name that sorts last. Null and empty texts and lines of fewer than two words have no hits; rows with null or
    repeated ids are scanned each; other columns are ignored. Texts and units without any word that a hit must have are
    left out first. One scan reads whole texts, without a shuffle.
    """
    known = [(name, b) for name, text in templates if (b := bag(text))]
    least = min(len(b) for _, b in known) * threshold / (2 - threshold)
    most = max(len(b) for _, b in known) * (2 - threshold) / threshold
    kinds = [(name, b, sorted({x.split("#")[0] for x in b})) for name, b in known]
    literal = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("bag"), F.array(*map(F.lit, p)).alias("pairs")) for name, b, p in kinds))
    every = F.array(*map(F.lit, sorted({x for _, _, p in kinds for x in p})))
    sign = f"(?<![a-z0-9])(?:{'|'.join(_signs(known, threshold))})(?![a-z0-9])"
    texts = docs.select("doc_id", "text").where(F.lower("text").rlike(sign))
    texts = _passages(_computed(texts, "parts", F.split("text", "\n", -1)), literal, every, threshold)
    return texts.select("doc_id", F.inline(F.concat(_line_hits(literal, threshold, least, most, sign), F.col("passages")))).select("doc_id", "line", "license", "dice")


def licence_report(docs: DataFrame) -> DataFrame:
    """(doc_id, license, n_hits, first_line, dice): hits of each document and licence, the first line, and the highest dice."""
    hits = licence_hits(docs).groupBy("doc_id", "license")
    return hits.agg(F.count("*").alias("n_hits"), F.min("line").alias("first_line"), F.round(F.max("dice"), 6).alias("dice"))


def report_sql() -> str:
    known = ", ".join("('{}', {}, [{}])".format(name, len(bag(text)), ", ".join(f"'{x}'" for x in bag(text))) for name, text in TEMPLATES)
    return f"""
WITH t(license, n, bag) AS (VALUES {known}),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
  UNION ALL SELECT doc_id, text, -1 FROM documents WHERE len(string_split(text, chr(10))) > 1
), u AS (
  SELECT doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM l
), p AS (
  SELECT doc_id, line, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs
  FROM u WHERE len(words) BETWEEN 2 AND 400
), b AS (
  SELECT doc_id, line, list_transform(pairs, lambda x, i: x || '#' || CAST(len(list_filter(pairs[:i], lambda y: y = x)) AS VARCHAR)) AS bag FROM p
), s AS (
  SELECT doc_id, line, license, 2.0::DOUBLE * len(list_intersect(t.bag, b.bag)) / (t.n + len(b.bag)) AS dice
  FROM b JOIN t ON t.n * (2 - {THRESHOLD}) >= len(b.bag) * {THRESHOLD} AND len(b.bag) * (2 - {THRESHOLD}) >= t.n * {THRESHOLD}
), best AS (
  SELECT doc_id, line, unnest(max(struct_pack(dice := dice, license := license)), recursive := true) FROM s GROUP BY doc_id, line
)
SELECT doc_id, license, count(*) AS n_hits, CAST(min(line) AS INTEGER) AS first_line, round(max(dice), 6) AS dice
FROM best WHERE dice >= {THRESHOLD} GROUP BY doc_id, license
"""
