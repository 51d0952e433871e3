import functools
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeweave.llm import common, decontaminate, html_text, jaccard_join, language, licenses, line_dedup, topk

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows, more="n string, row string, lines string, h string, k string, a string"):
    """documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, *["x"] * len(more.split(", "))) for r in rows], f"doc_id long, text string, {more}")


# ---------------------------------------------------------------- line dedup


def brute_lines(rows):
    texts = {i: (t or "").split("\n") for i, t in rows if t is not None}
    seen, gone = set(), defaultdict(set)
    for i in sorted(texts):
        x = ["" if not s.strip(" ") else s for s in texts[i]]
        for p in range(len(x) - 2):
            w = tuple(x[p : p + 3])
            if any(w):
                if w in seen:
                    gone[i] |= {p, p + 1, p + 2}
                seen.add(w)
    return {i: None if t is None else "\n".join(s for p, s in enumerate(t.split("\n")) if p not in gone[i]) for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "a\nb"), (903, "z\n" * 50), (904, "\n\n\n\n"), (905, "q\nr\ns\n" * 400)]
    expected = brute_lines(rows)
    df = table(spark, rows)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and {r["doc_id"]: r["text"] for r in out.collect()} == expected
    assert out.where("row <> 'x' OR lines <> 'x'").count() == 0
    report = {r["doc_id"]: r for r in line_dedup.line_report(df).collect()}
    assert report[903]["n_removed"] > 0 and report[900]["n_lines"] == 0 and report[902]["n_removed"] == 0


def test_line_dedup_odd_rows(spark):
    same = "a\nb\nc\nd"
    rows = [(1, same), (1, same), (2, same), (None, same), (None, "e\nf\ng"), (3, "e\nf\ng\nh")]
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(table(spark, rows)).collect())
    assert got == Counter({(1, ""): 2, (2, ""): 1, (None, same): 1, (None, "e\nf\ng"): 1, (3, "h"): 1})
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


# ---------------------------------------------------------------- Jaccard join


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute_classes(rows, k, num, den):
    sets, root, links = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 9, 60, 200]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "num", "den", "small", "block"), [(4, 85, 100, 32, 256), (5, 4, 5, 3, 8)])
def test_jaccard_classes(spark, monkeypatch, k, num, den, small, block):
    """Also with so few groups and sets allowed that chains and several blocks are needed."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(11, 150) + [(500, None), (501, ""), (502, " \n "), (503, "One"), (504, "oNE"), (505, "a b c " * 3000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(table(spark, rows), k, num, den).collect()}
    assert got == brute_classes(rows, k, num, den)


def test_jaccard_of_very_common_shingles(spark, monkeypatch):
    """Lists longer than SMALL over several size classes, units against each other, and groups of several sets."""
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(21)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, " ".join([common, *(f"t{j}" for j in range(rng.randint(0, 30))), *(f"u{rng.randint(0, 3)}" for _ in range(rng.randint(0, 4)))])) for i in range(90)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(near_copies(5, 60))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(table(spark, rows), 3, 85, 100).collect()}
    assert got == brute_classes(rows, 3, 85, 100)


def test_bitmaps_tell_large_sets_apart():
    rng = np.random.default_rng(4)
    for n, m in ((3, 3), (100, 120), (3000, 3000), (16000, 18000), (300, 3000)):
        a, b = (np.unique(rng.integers(0, 2**64, x, np.uint64)) for x in (n, m))
        near = np.concatenate([a[: n - n // 20], b[: n // 20]])
        maps = [pa.array([jaccard_join.bitmap_of(x) for x in y], pa.list_(pa.int64())) for y in ([a] * 3, [b, near, a])]
        unlike, alike, same = jaccard_join.differing(*maps)
        assert same == 0 and alike <= 2 * (n // 20) and unlike <= n + m
        # 20 * |both| >= 17 * |either| is not ruled out for the near copy, and is for the other
        assert 37 * ((2 * n - alike) // 2) >= 17 * 2 * n and 37 * ((n + m - unlike) // 2) < 17 * (n + m)


def test_rare_shingles_have_low_levels(spark):
    rows = [(i, " ".join(f"w{(i * 7919 + j) % 9973 if j > 40 else j}x{i if j > 40 else 0}" for j in range(2000))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard_join.shingle_levels(docs, 4)
    sets = [s for _, s in common.shingle_sets(pa.array([t for _, t in rows[:20]]), 4)]
    often = functools.reduce(np.intersect1d, sets)
    rare = np.concatenate([np.setdiff1d(s, often) for s in sets])
    level = lambda s: found[s & np.uint64(jaccard_join.SKETCH - 1)]
    assert len(often) >= 30 and level(often).min() > 100 and np.quantile(level(rare), 0.95) <= 3


def test_levels_rise_with_counts():
    for scale in (1, 60, 3000):
        counts = np.sort(np.concatenate([np.random.default_rng(2).poisson(scale, 5000), [10**4, 10**5, 10**6, 10**9]]))
        got = jaccard_join.levels(counts).astype(int)
        assert (np.diff(got) >= 0).all() and got[-3] > got[2500]


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (3, "a b c d e"), (None, "a b c d e"), (3, "a b c d e")]
    got = sorted((repr(r["doc_id"]), r["component_id"]) for r in jaccard_join.jaccard_classes(table(spark, rows), 4, 85, 100).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 1), ("3", 1), ("None", None)]
    assert jaccard_join.jaccard_classes(table(spark, []), 4, 85, 100).count() == 0


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b\tc", None, "", " A  B\x0bc ", "é b c", "abc"]
    sets = dict(common.shingle_sets(pa.array(texts), 2))
    assert sets[0].tolist() == sets[3].tolist() and len(sets[0]) == 2 and len(sets[1]) == len(sets[2]) == 0 and len(sets[5]) == 1
    assert set(sets[4].tolist()) & set(sets[0].tolist())


# ---------------------------------------------------------------- decontamination


def test_leaks(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(30))) for i in range(12)] + [(50, None), (51, "two words"), (52, "")]
    rows, expected = [], set()
    for i in range(60):
        w = say(200)
        if i % 3 == 0:
            j = i % 12
            leak = items[j][1].split()
            if i % 2:
                leak[5], leak[14], leak[23] = "edited", "words", "here"
                del leak[18]
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in leak]
            expected.add((i, j))
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (None, items[0][1])]
    df, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == expected | {(None, 0)} and got[(0, 0)] == 1.0 and all(0.5 <= s <= 1 for s in got.values())
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i is not None} - {i for i, _ in expected}
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(table(spark, []), bench).count() == 0


def test_leaks_of_copies_edited_throughout(spark):
    """Against the alignment of all pairs: a word in 4 to 6 replaced, words put in between, and a verbatim copy beside them."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(20, 50)))) for i in range(10)]
    rows = [(999, "x " + items[0][1])]
    for i in range(80):
        w, every = items[i % 10][1].split(), 3 + i // 10 % 4
        if i < 40:
            w[every - 1 :: every] = [f"e{i}-{j}".replace("-", "x") for j in range(len(w[every - 1 :: every]))]
        else:
            w = [x for j, y in enumerate(w) for x in ([y, f"e{i}x{j}"] if j % every == every - 1 else [y])]
        before = say(rng.randint(0, 150))
        rows.append((i, " ".join(before + w + say(60))))
    ids = {x: k for k, x in enumerate({x for _, t in rows + items for x in t.split()})}
    number = lambda t: np.array([ids[x] for x in t.split()])
    expected = {}
    for d, t in rows:
        for i, item in items:
            score = decontaminate.align(number(t), number(item))[0] / (2 * len(item.split()))
            three = {tuple(x) for x in np.lib.stride_tricks.sliding_window_view(number(item), 3).tolist()}
            if score >= 0.5 and not three.isdisjoint(map(tuple, np.lib.stride_tricks.sliding_window_view(number(t), 3).tolist())):
                expected[d, i] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == expected and {(i, i % 10) for i in range(10, 80)} <= set(got)


def test_alignment_against_a_table():
    rng = random.Random(1)
    for _ in range(60):
        a, b = [rng.randrange(4) for _ in range(rng.randint(0, 12))], [rng.randrange(4) for _ in range(rng.randint(0, 9))]
        h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, h))


# ---------------------------------------------------------------- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a href=a>Home</a></nav><article><h1>T</h1><p>One  <i>two</i>\n three.<p>Four.<script>if(a<b){}</script></article><div class='comments'><p>me too</p></div><footer>f</footer>", "T\nOne two three.\nFour."),
        ("<div id=sidebar>s</div><div class=content><p>First one here.</p><p>&lt;b&gt; second</p><aside>no</aside></div><div class=ad>Buy</div>", "First one here.\n<b> second"),
        ("<ul><li>x<li>y</ul><!-- gone -->", "x\ny"),
        ("<head><title>t</title></head><body><script>only</script></body>", ""),
    ],
)
def test_html(page, text):
    assert html_text.extract(page) == text


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("stone river lamp under bright slow garden".split()) for _ in range(n))


A, B, C, D, E = (f"<p>{prose(i)}</p>" for i in range(5))
SHORT = f"<p>{prose(9, 5)}</p>"


@pytest.mark.parametrize(
    "inner",
    [
        f"<h1>T</h1><section>{A * 6}</section><section>{B * 2}</section><section>{C}</section>",
        f"<h1>T</h1>{SHORT}<div>{A * 8}</div>",
        f"<h1>T</h1>{A}{B}<blockquote>{C}{D}</blockquote>{E}",
        f"<h1>T</h1>{A}{B}<ul>" + "".join(f"<li>{prose(20 + i, 40)}</li>" for i in range(12)) + "</ul>",
        f"Some words first.<br>{SHORT}<div>{A * 8}</div>",
        f"<div>{A * 6}</div><div>{B * 2}</div><div>{SHORT}</div>",
    ],
)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div id=page><div class='content with-sidebar'>{}</div></div>"])
def test_html_keeps_all_of_an_article(inner, around):
    words = lambda x: re.sub("<[^>]*>", " ", x).split()
    page = f"<body><nav><a href=a>Home</a></nav><div class=cookie-banner>We bake.</div>{around.format(inner)}<div><a href=b>More</a></div><footer>f</footer>"
    assert html_text.extract(page).split() == words(inner)


@pytest.mark.parametrize("around", ["<div class='content with-sidebar'>{}</div>", "<div class='site no-sidebar'>{}</div>", "<div id=menu-of-the-day>{}</div>", "<section class=related-work>{}</section>", "<form action=x><input name=y>{}</form>", "<form><div class=notice>{}</div></form>"])
def test_html_names_do_not_drop_the_article(around):
    page = f"<body><div class=ad>Buy now.</div>{around.format(A + B)}<div class='ad-1 wide'>Buy more.</div><form><p>Your mail</p></form></body>"
    assert html_text.extract(page).split() == (prose(0) + " " + prose(1)).split()


def test_html_long_comments_go():
    page = f"<body><article>{A}</article><div class=comments>{B * 5}</div></body>"
    assert html_text.extract(page) == prose(0)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, None, None, "x"), (None, "v", "<p>" + "word " * 50_000 + "</p>", "x")], "page_id long, url string, html string, text string")
    got = sorted((repr(r["page_id"]), repr(r["url"]), r["n_chars"]) for r in html_text.main_text(pages).collect())
    assert got == [("1", "'u'", 1), ("1", "None", 0), ("None", "'v'", 249_999)]


# ---------------------------------------------------------------- licences


def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "ALL RIGHTS RESERVED"), (3, "Licensed under the Apache License Version 2"), (4, None), (5, ""), (6, "word " * 3000), (7, "a\nLicensed under CC BY 4.0."), (None, "All rights reserved. !!!"), (8, "Released under the MIT License and more of other words that follow")]
    got = sorted((repr(r["doc_id"]), r["license"], r["line"]) for r in licenses.licence_hits(table(spark, rows)).collect())
    assert got == [("1", "MIT", 1), ("2", "all-rights-reserved", 0), ("3", "Apache-2.0", 0), ("7", "CC-BY-4.0", -1), ("7", "CC-BY-4.0", 1), ("None", "all-rights-reserved", 0)]
    full = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    split = spark.createDataFrame([(1, full.replace(", ", ",\n"))], "doc_id long, text string")
    assert [(r["license"], r["line"]) for r in licenses.licence_hits(split).where("line = -1").collect()] == [("MIT", -1)]
    assert licenses.licence_hits(table(spark, [])).count() == 0


def test_licences_of_several_lines(spark):
    """Notices wrapped at 80 columns above code, and licences in full."""
    texts = {(n, len(t)): t for n, t in licenses.TEMPLATES}
    longest = lambda name: max((t for n, t in licenses.TEMPLATES if n == name), key=len)
    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 76))
    code = "\n".join(f"value_{i} = run({i}, other_{i})" for i in range(60))
    rows = [(i, f"{mark} file {i}\n\n{wrap(longest(name), mark)}\n\n{code}") for i, (name, mark) in enumerate([("Apache-2.0", "# "), ("GPL-3.0", "// "), ("MIT", ""), ("BSD-2-Clause", " * "), ("BSD-3-Clause", "# ")])]
    rows += [(9, code), (10, "x\nReleased under the\nMIT License.\n" + code)]
    got = defaultdict(set)
    for r in licenses.licence_hits(table(spark, rows)).collect():
        if r["dice"] > 0.95:
            got[r["doc_id"]].add((r["license"], r["line"]))
    assert got == {0: {("Apache-2.0", 2)}, 1: {("GPL-3.0", 2)}, 2: {("MIT", 2)}, 3: {("BSD-2-Clause", 2)}, 4: {("BSD-3-Clause", 2)}, 10: {("MIT", 1)}}
    assert len(texts) == len(licenses.TEMPLATES)


# ---------------------------------------------------------------- top k


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).round(2).astype(np.float32)
    x[40:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (440, [])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for r in topk.exact_top_k(v, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    n = np.vstack([np.floor(64 * x.astype(np.float64)), np.zeros(8)]).astype(np.int64)
    ids = [*range(300), 440]
    for q in [i for i in ids if i % 20 == 0]:
        s = n @ n[ids.index(q)]
        assert got[q] == sorted(((i, int(v)) for i, v in zip(ids, s, strict=True) if i != q), key=lambda p: (-p[1], p[0]))[:5]
    assert topk.exact_top_k(v.limit(0), F.lit(True)).count() == 0


def test_maxscore_with_few_rows():
    rows, ids = np.array([[1, 2], [3, -4]]), np.array([7, 8])
    theta, last = topk.first_look(rows, ids, rows, ids, 20)
    got = topk.maxscore(rows, ids, rows, ids, 20, theta, last)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == [(0, 8, -5), (1, 7, -5)]
    assert all(len(x) == 0 for x in topk.maxscore(rows[:0], ids[:0], rows, ids, 20, theta[:0], last[:0]))
    assert all(len(x) == 0 for x in topk.maxscore(rows, ids, rows[:0], ids[:0], 20, theta, last))


@pytest.mark.parametrize("spread", [1, 30, 40_000])
def test_maxscore_against_all_scores(monkeypatch, spread):
    """Ties, repeated rows and ids, thresholds from other rows; also with numbers too large for short floats."""
    monkeypatch.setattr(topk, "AT_ONCE", 16)
    monkeypatch.setattr(topk, "ROWS_AT_ONCE", 64)
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (6, 12))
    rows = centres[rng.integers(0, 6, 700)] + rng.integers(-1, 2, (700, 12)) * rng.integers(0, 2, (700, 1))
    rows[100:400] = rows[100]
    ids = rng.permutation(900)[:700]
    ids[5] = ids[6]
    q, own, k = rows[::9], ids[::9], 7
    look = rng.permutation(700)[:60]
    theta, last = topk.first_look(q, own, rows[look], ids[look], k)
    place, found, score = topk.maxscore(q, own, rows, ids, k, theta, last)
    for i in range(len(q)):
        s = rows @ q[i]
        expected = sorted(((-int(v), int(x)) for v, x in zip(s, ids, strict=True) if x != own[i]))[:k]
        got = sorted((-int(v), int(x)) for v, x in zip(score[place == i], found[place == i], strict=True))
        assert got == expected


def test_top_k_in_shards_and_blocks(spark, monkeypatch):
    for name, n in (("QUERY_BLOCK", 10), ("SHARD_ROWS", 70), ("LOOK", 25)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (400, 5))
    df = spark.createDataFrame([(i, (v / 64).tolist(), 1, 2, "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, theta int, b int, query string")
    got = defaultdict(list)
    for r in topk.exact_top_k(topk.integer_vectors(df), F.col("vec_id") % 20 == 0, 6).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 400, 20):
        best = sorted((-int(v), i) for i, v in enumerate(x @ x[q]) if i != q)[:6]
        assert sorted(got[q]) == [(n + 1, i, -v) for n, (v, i) in enumerate(best)]


# ---------------------------------------------------------------- language


def test_language(spark):
    words = {"aa": "the and with house green", "bb": "der und mit haus grün", "cc": "дом и зелёный в"}
    rng = random.Random(6)
    say = lambda x, n: " ".join(rng.choice(words[x].split()) for _ in range(n))
    rows = [(i, say(x, 60), x) for i, x in enumerate(["aa", "bb", "cc"] * 30)]
    odd = [(500, None, "aa"), (501, "", "aa"), (502, "12 % 34", "aa"), (503, say("aa", 80) + " " + say("bb", 40), None), (504, say("cc", 5), None), (None, say("bb", 9), None), (505, "日本語", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = language.train_on_documents(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect()}
    assert any(held.values()) and all(got[i]["lang_pred"] == x for i, _, x in rows)
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and got[None]["lang_pred"] == "bb" and got[504]["lang_pred"] == "cc"
    assert [s["lang"] for s in got[503]["spans"]] == ["aa", "bb"] and abs(got[503]["spans"][0]["end"] - 80) <= 2 and 0.6 < got[503]["score"] < 0.72
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in rows + odd} - {500, 501, 502}
    none = language.train_on_documents(docs.where("lang = 'zz'"))
    assert language.identify(docs, none).select("lang_pred").distinct().collect()[0][0] == "und"


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(9)
    for _ in range(30):
        s = -np.abs(rng.normal(size=(5, 3))) * 3
        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(map(value, itertools.product(range(3), repeat=5)))
        assert value(language.labels_of(s, 1.5).tolist()) == pytest.approx(best)
