import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.functions import text as T
from placeweave.operators import browse, graph, keywords, resolve, scoring, tagging

NOW = dt.datetime(2026, 9, 12)
SIGNAL = "place_id long, source string, rating double, review_count long, observed_at timestamp, sentiment double, upvotes long, mention_count long, thread_score long"


def signals(spark, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (9 - len(r)) for r in rows], SIGNAL)


def places(spark, n):
    return spark.createDataFrame([(i, "m") for i in range(n)], "place_id long, city string")


def scores(spark, n, *rows):
    s = signals(spark, *rows)
    return {r["place_id"]: r for r in scoring.rescore(places(spark, n), s, F.lit(NOW)).collect()}


def test_scores(spark):
    fresh = NOW - dt.timedelta(days=30)
    got = scores(
        spark, 7,
        (0, "google_places", 4.5, 900, fresh), (1, "google_places", 4.5, 3, fresh), (2, "blog", None, None, fresh),
        (3, "google_places", 4.7, 900, fresh), (3, "yelp", 4.5, 300, fresh), (3, "reddit", None, 5, fresh, 0.9, 400, 5, 500),
        (5, "yelp", None, 10, fresh), (6, "reddit", None, None, fresh, -0.8, 900, 4, 300),
    )
    assert got[0]["score"] > got[1]["score"]  # more reviews, more trust
    assert 50 < got[2]["score"] < 60 and got[2]["raw_base"] == pytest.approx(0.66)
    assert got[3]["source_count"] == 3 and 0 < got[3]["bonus"] <= 0.12
    assert got[4]["score"] == 0 and got[4]["agreement"] == 1
    assert got[5]["raw_base"] == pytest.approx(0.66)  # rated source without a rating counts as listed
    assert got[6]["score"] < 50


def test_distribution_falls_back_and_floors(spark):
    few = signals(spark, *[(i, "yelp", 4.0 + i / 10, 5, None) for i in range(3)], *[(i, "google_places", 4.0, 5, None) for i in range(12)])
    got = {r["source"]: r for r in scoring.distributions(few, places(spark, 12)).collect()}
    assert (got["yelp"]["mean_rating"], got["yelp"]["sd_rating"], got["yelp"]["measured"]) == (4.10, 0.45, False)
    assert got["google_places"]["measured"] and got["google_places"]["sd_rating"] == 0
    z = scoring.score_signals(few, places(spark, 12), F.lit(NOW)).where("source = 'google_places'").select("z").distinct().collect()
    assert [r["z"] for r in z] == [0.0]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def make_records(n, seed):
    rng = random.Random(seed)
    names = ["Casa Dani", "Casa Lucio", "Sobrino de Botín", "Botín", "Museo del Prado", "Prado", "Retiro Park", "Parque del Retiro", "Toma Café"]
    return [(i, rng.choice(names), "m", 40.4 + rng.random() * 0.006, -3.7 + rng.random() * 0.008) for i in range(n)]


def key(name):
    plain = name.lower().translate(str.maketrans("íé", "ie"))
    words = plain.split()
    return " ".join([w for w in words if w not in C.NOISE_TOKENS] or words)


def metres(a, b):
    p, q = math.radians(a[3]), math.radians(b[3])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
    return 2 * C.EARTH_RADIUS_M * math.asin(math.sqrt(h))


def test_resolution_against_a_loop(spark):
    """Record after record against all survivors, as the sequential definition has it."""
    records = make_records(160, 3)
    survivors, expected = [], {}
    for r in records:
        best = None
        for s in survivors:
            sim, d = T.similarity(key(r[1]), key(s[1])), metres(r, s)
            if sim < C.MIN_SIMILARITY:
                continue
            anchored = bool({w for w in key(r[1]).split() if len(w) >= 4 and w not in C.GENERIC_TOKENS} & {w for w in key(s[1]).split() if len(w) >= 4 and w not in C.GENERIC_TOKENS})
            rule = next((i for i, (m, x, a, _) in enumerate(C.MERGE_RULES) if d <= m and sim >= x and (anchored or not a)), None)
            conf = 0.0 if d > C.MERGE_RADIUS_M else min(1.0, 0.55 * sim + 0.45 / (1 + (d / 90) ** 2) + 0.05 * anchored)
            if best is None or (rule is not None, conf) > best[0]:
                best = ((rule is not None, conf), s, sim)
        if best and best[0][0]:
            expected[r[0]] = (best[1][0], "merged")
            continue
        survivors.append(r)
        flagged = best is not None and best[0][1] >= C.REVIEW_CONFIDENCE and best[2] >= C.REVIEW_SIMILARITY
        expected[r[0]] = (r[0], "flagged" if flagged else "created")
    df = spark.createDataFrame(records, "place_id long, name string, city string, lat double, lng double")
    got = {r["place_id"]: (r["survivor"], r["decision"]) for r in resolve.resolve(df).collect()}
    assert got == expected
    assert any(d == "merged" for _, d in expected.values()) and any(d == "flagged" for _, d in expected.values())


def test_near_pairs_against_all_pairs(spark):
    records = make_records(200, 8)
    df = spark.createDataFrame(records, "place_id long, name string, city string, lat double, lng double")
    got = {(r["left_id"], r["right_id"]) for r in resolve.near_pairs(df, 120.0).collect()}
    assert got == {(a[0], b[0]) for a in records for b in records if a[0] < b[0] and metres(a, b) <= 120}


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(2)
    names = [" ".join(rng.choice(["old", "small", "red", "ring", "bolt", "gear", "gizmo"]) for _ in range(rng.randint(1, 3))) for _ in range(80)]
    df = spark.createDataFrame([(i, "m", n) for i, n in enumerate(names)], "id long, city string, key string")
    got = {(r["left_id"], r["right_id"]) for r in resolve.similar_names(df, 0.4).collect()}
    grams = [{("  " + w + " ")[i : i + 3] for w in n.split() for i in range(len(w) + 1)} for n in names]
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) > 0.4}


def test_names_without_coordinates(spark):
    p = spark.createDataFrame([(1, "m", "Museo Nacional del Prado"), (2, "m", "Sobrino de Botín"), (3, "m", "Casa Botella"), (4, "m", "Casa Dani"), (5, "m", "Casa Dani Retiro"), (6, "m", "Parque Retiro")], "place_id long, city string, name string")
    m = spark.createDataFrame([(1, "m", "the Prado"), (2, "m", "Botín"), (3, "m", "Guernica"), (4, "m", "Retiro"), (5, "m", "Casa Dani"), (6, "x", "the Prado")], "mention_id long, city string, name string")
    got = {r["mention_id"]: r["place_id"] for r in resolve.resolve_names(m, p).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None, 5: 4, 6: None}


def test_misspelt_names_without_coordinates(spark):
    p = spark.createDataFrame([(1, "m", "Botin"), (2, "m", "Museo del Prado"), (7, "m", "Botin")], "place_id long, city string, name string")
    m = spark.createDataFrame([(1, "m", "Botinn"), (2, "m", "Guernica"), (3, "m", "Botinn")], "mention_id long, city string, name string")
    got = {r["mention_id"]: (r["place_id"], r["decision"]) for r in resolve.resolve_names(m, p).collect()}
    assert got == {1: (1, "merged"), 2: (None, "dropped"), 3: (1, "merged")}


def test_near_pairs_at_the_poles_and_the_date_line(spark):
    rng = random.Random(4)
    lat = [*(rng.choice([-1, 1]) * rng.uniform(89.995, 90) for _ in range(40)), *(80 + rng.uniform(0, 0.004) for _ in range(40)), *(rng.uniform(0, 0.004) for _ in range(40))]
    lng = [*(rng.uniform(-180, 180) for _ in range(40)), *(20 + rng.uniform(0, 0.02) for _ in range(40)), *(rng.choice([-180 + rng.uniform(0, 0.002), 180 - rng.uniform(0, 0.002)]) for _ in range(40))]
    records = [(i, "n", "m", a, b) for i, (a, b) in enumerate(zip(lat, lng, strict=True))]
    df = spark.createDataFrame(records, "place_id long, name string, city string, lat double, lng double")
    got = [(r["left_id"], r["right_id"]) for r in resolve.near_pairs(df, 150.0).collect()]
    expected = {(a[0], b[0]) for a in records for b in records if a[0] < b[0] and metres(a, b) <= 150}
    assert len(got) == len(set(got)) and set(got) == expected and {a // 40 for a, _ in expected} == {0, 1, 2}


def test_fold_is_ordered(spark):
    rows = [(1, "reddit", i, s, u, 1, t, 1, dt.datetime(2026, 1, i + 1), url) for i, (s, u, t, url) in enumerate([(0.5, 10, 100, None), (-0.25, 3, 700, "u"), (0.125, None, 5, "v")])]
    schema = "place_id long, source string, seq int, sentiment double, upvotes long, mention_count long, thread_score long, review_count long, observed_at timestamp, url string"
    r = resolve.fold_signals(spark.createDataFrame(rows, schema)).first()
    one = round((0.5 * 11 + -0.25 * 4) / 15, 4)
    two = round((one * 14 + 0.125 * 1) / 15, 4)
    assert r["sentiment"] == pytest.approx(two) and r["upvotes"] == 13 and r["thread_score"] == 700 and r["mention_count"] == 3 and r["url"] == "u" and r["merged_mentions"] == 3


def snippets(spark, *texts):
    return spark.createDataFrame([(1, i, t, 1.0, 0.4) for i, t in enumerate(texts)], "place_id long, doc_id long, text string, weight double, sentiment double")


def tags(spark, *texts):
    return {r["tag"] for r in tagging.text_tags(snippets(spark, *texts), tagging.phrase_table(spark)).collect()}


def test_rules(spark):
    assert "laptop-friendly" not in tags(spark, "Tiny, no laptops, in and out.", "Bring your laptop, there are plugs.")
    assert "quiet" in tags(spark, "It's not cheap, but the quiet terrace is lovely.")
    assert "quiet" not in tags(spark, "Loud, fun, not a place for a quiet dinner.")
    assert "outdoor-seating" not in tags(spark, "Nice terrace.", *["Fine."] * 9)  # one in ten is too few
    assert "date-night" not in {r["tag"] for r in tagging.text_tags(snippets(spark, "Romantic.").withColumn("sentiment", F.lit(-0.5)), tagging.phrase_table(spark)).collect()}


def test_contradictions(spark):
    cases = [(["budget", "pricey"], 2, None, None, ["budget"]), (["budget", "pricey"], 3, None, None, ["pricey"]), (["budget", "pricey"], None, None, None, ["budget"]), (["lively", "quiet"], None, 0.4, 0.3, ["quiet"]), (["lively", "quiet"], None, 0.3, 0.3, []), (["hidden-gem", "touristy"], None, None, None, ["touristy"])]
    df = spark.createDataFrame([(i, t, p, q, v) for i, (t, p, q, v, _) in enumerate(cases)], "i int, t array<string>, p int, q double, v double")
    got = df.select("i", tagging.settle(F.col("t"), F.col("p"), F.col("q"), F.col("v")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [c[4] for c in cases]


def test_keywords(spark):
    texts = ["churros chocolate churros", "chocolate churros terrace", "museum paintings museum", "paintings guernica museum"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "place_id long, text string")
    names = spark.createDataFrame([(i, "Museum" if i == 2 else "x") for i in range(4)], "place_id long, name string")
    got = [(r["place_id"], r["term"]) for r in keywords.keywords(df, names).collect()]
    assert (0, "churros") in got and (3, "museum") in got and (2, "museum") not in got and (3, "guernica") not in got
    assert keywords.keywords(df.limit(2), names).count() == 0


def test_requests_out_of_range():
    for bad in ({"days": 0}, {"days": 15}, {"max_price_tier": 5}, {"limit": 0}, {"radius_m": 99}, {"min_score": 101}):
        with pytest.raises(ValueError):
            browse.check_request(**bad)


def test_status_and_queue(spark):
    p = spark.createDataFrame([(1, "m", None, ["a"], 5.0), (2, "m", 1, [], None), (3, "x", None, [], None)], "place_id long, city string, duplicate_of long, tags array<string>, score double")
    r = spark.createDataFrame([(1, 2, 0.7, False), (1, 3, 0.9, False), (2, 3, 0.8, True)], "left_id long, right_id long, confidence double, resolved boolean")
    s = signals(spark, (1, "yelp"), (1, "blog"), (3, "yelp"), (3, "blog"))
    assert browse.status(p, s, r, "m").first().asDict() == {"total": 2, "canonical": 1, "scored": 1, "tagged": 1, "multi": 2, "pending": 2}
    assert [x["confidence"] for x in browse.review_queue(r).collect()] == [0.9, 0.7]
