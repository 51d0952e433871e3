import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from placeweave.sources import cards, comments, feeds, mentions

NOW = dt.datetime(2026, 9, 12)


def test_map_feed(spark, tmp_path):
    at = {"latitude": 40.4, "longitude": -3.7}
    places = [
        {"id": "a", "displayName": {"text": "Mercado"}, "location": at, "types": ["market", "food"], "primaryType": "market", "rating": 4.5, "userRatingCount": 10, "priceLevel": "PRICE_LEVEL_EXPENSIVE", "regularOpeningHours": {"periods": [{"open": {"day": 1, "hour": 10, "minute": 0}, "close": {"day": 1, "hour": 20, "minute": 0}}]}, "editorialSummary": {"text": "Food hall"}},
        {"id": "a", "displayName": {"text": "Again"}, "location": at},
        {"id": "b", "displayName": {"text": "Nowhere"}},
        {"id": "c", "location": at},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"places": places}))
    rows = feeds.map_places(feeds.read_maps(spark, str(tmp_path / "m.json")), "Madrid", "ES", F.lit(NOW)).collect()
    assert [(r["source_place_id"], r["category"], r["price_tier"], len(r["evidence"])) for r in rows] == [("a", "restaurant", 3, 1)]
    assert [tuple(x) for x in rows[0]["hours"]["mon"]] == [("10:00", "20:00")]


def test_listing_feed(spark, tmp_path):
    at = {"latitude": 40.4, "longitude": -3.7}
    b = [
        {"id": "x", "name": "Bar", "coordinates": at, "categories": [{"alias": "pubs", "title": "Pubs"}], "location": {"city": " MADRID ", "display_address": ["A", "B"]}, "price": "€€", "rating": 4.0, "review_count": 7},
        {"id": "y", "name": "Far", "coordinates": at, "location": {"city": "Getafe", "display_address": []}, "price": "€€€€€", "review_count": 9},
        {"id": "", "name": "No id", "coordinates": at},
        {"id": "z", "coordinates": at},
    ]
    (tmp_path / "l.json").write_text(json.dumps({"businesses": b}))
    found = feeds.explode_listings(feeds.read_listings(spark, str(tmp_path / "l.json")))
    got = {r["source_place_id"]: r for r in feeds.listing_places(found, "Madrid", "ES", F.lit(NOW)).collect()}
    assert set(got) == {"x", "y"}
    assert (got["x"]["category"], got["x"]["price_tier"], got["x"]["neighborhood"], got["x"]["address"]) == ("bar", 2, None, "A, B")
    assert (got["y"]["category"], got["y"]["price_tier"], got["y"]["neighborhood"], got["y"]["address"]) == ("other", None, "Getafe", None)
    details = spark.createDataFrame([("y", [([(0, "0900", "1700")],)]), ("x", [([(1, "0900", "1700")],)])], "id string, hours array<struct<open: array<struct<day: int, start: string, end: string>>>>")
    reviews = spark.createDataFrame([("y", [("fine", None)])], "id string, reviews array<struct<text: string, url: string>>")
    more = {r["source_place_id"]: r for r in feeds.listing_places(feeds.with_details(found, details, reviews, 1), "Madrid", "ES", F.lit(NOW)).collect()}
    assert more["y"]["hours"]["mon"] and len(more["y"]["evidence"]) == 1 and more["x"]["hours"] is None  # only the most reviewed one


def listing(*children):
    return {"data": {"children": list(children)}}


def comment(body, score, *replies, kind="t1"):
    return {"kind": kind, "data": {"body": body, "score": score, "replies": listing(*replies) if replies else ""}}


def test_threads(spark):
    tree = [listing(), listing(comment("one", 2, comment("two", 5, comment("three", 9))), comment("low", 1, comment("kept", 3)), comment("[deleted]", 9), comment("more", 9, comment("never", 9), kind="more"))]
    rows = [("t1", "Best tapas", " ", 25, "m", "/r/1", 1.0, json.dumps(tree)), ("t1", "Best tapas", " ", 25, "m", "/r/1", 1.0, json.dumps(tree)), ("t2", "Low", "x", 24, "m", "", 1.0, json.dumps(tree))]
    t = spark.createDataFrame(rows, "id string, title string, selftext string, score int, subreddit string, permalink string, created_utc double, comments string")
    assert [(r["text"], r["url"]) for r in comments.thread_documents(t).collect()] == [("Best tapas", "https://www.reddit.com/r/1")]
    got = sorted(r["text"] for r in comments.comment_documents(t.limit(1)).collect())
    assert got == ["kept", "one", "three", "two"]


def test_mentions(spark):
    assert [n for n, _, _ in mentions.names_in("Honestly Casa Dani in Mercado de la Paz. It's great. Madrid!")] == ["Casa Dani", "Mercado de la Paz"]
    docs = [("t", "Botín is nice. We ate at Botín Grande.", 16, 100, "u1", "m", 5.0, 0), ("t", "I loved Casa Dani. Go to Casa Dani!", 0, 50, None, "m", 9.0, 1), ("s", "CASA DANI is terrible. casa? Casa Dani.", 4, 900, "u2", "x", 7.0, 2)]
    d = spark.createDataFrame([(t, x, s, ts, u, sub, c, q) for t, x, s, ts, u, sub, c, q in docs], "thread_id string, text string, score long, thread_score long, url string, subreddit string, created_utc double, seq long")
    got = {r["key"]: r for r in mentions.aggregate(mentions.extract(d), "madrid").collect()}
    assert "botin" not in got  # only ever begins a sentence
    r = got["casa dani"]
    assert (r["mention_count"], r["upvotes"], r["thread_score"], r["thread_count"], r["subreddits"]) == (2, 4, 900, 2, ["m", "x"])
    assert r["url"] == "u2" and r["source_place_id"].startswith("reddit:") and len(r["snippets"]) == 2


@pytest.mark.parametrize(("text", "sign"), [("mediocre at best", -1), ("a hidden gem", 1), ("not good", -1), ("The table stood there.", 0), ("", 0), ("very good!!!", 1)])
def test_sentiment(text, sign):
    v = mentions.sentiment(text)
    assert (v > 0) - (v < 0) == sign and -1 <= v <= 1


PAGE = """<section><h2>Eat</h2><p>x</p>
<span class="vcard"><span class="listing-name">Casa Uno [ dead link ]</span><span class="geo"><abbr class="latitude">40.41</abbr><abbr class="longitude">-3.70</abbr></span>
<span class="listing-hours">Mon-Sat 10:00-22:00</span><span class="listing-price">€12.50</span><span class="listing-url"><a href="//casa.example">w</a></span><span class="listing-content">Nice &amp; old.</span></span>
<div class="vcard"><b class="listing-name">Dos</b><a data-lat="40.5" data-lon="-3.6" class="external" href="/dos">m</a></div>
<span class="vcard"><span class="listing-name">No place</span></span><span class="vcard"><span class="geo"></span></span></section>
<section><h2>Get in</h2><span class="vcard"><span class="listing-name">Bus</span><i data-lat="1" data-lon="2"></i></span></section>"""


def test_cards(spark):
    pages = spark.createDataFrame([("w", "https://t.example/wiki/M", PAGE), ("e", "u", None)], "target_id string, url string, html string")
    got = {r["name"]: r for r in cards.card_places(cards.cards(pages), "Madrid", "ES").collect()}
    assert set(got) == {"Casa Uno", "Dos"}
    a, b = got["Casa Uno"], got["Dos"]
    assert (a["category"], a["lat"], a["price_tier"], a["url"], a["evidence_text"]) == ("restaurant", 40.41, 2, "https://casa.example", "Nice & old")
    assert a["hours"]["sat"] and not a["hours"]["sun"] and (b["lng"], b["url"], b["hours"]) == (-3.6, "https://t.example/dos", None)


def test_cache(spark):
    rows = [("g", "k1", NOW - dt.timedelta(days=1), '{"a": 1}'), ("g", "k2", NOW - dt.timedelta(days=8), "{}"), ("g", "k3", NOW, "{broken")]
    cache = spark.createDataFrame(rows, "namespace string, k string, fetched_at timestamp, body string").withColumn("digest", feeds.cache_key(F.col("k"))).drop("k")
    keys = spark.createDataFrame([("g", k) for k in ("k1", "k2", "k3", "k4")], "namespace string, key string")
    assert {r["key"]: r["body"] for r in feeds.cache_lookup(cache, keys, F.lit(NOW)).collect()} == {"k1": '{"a": 1}', "k2": None, "k3": None, "k4": None}


def test_sources_degrade(spark):
    fixture = lambda: spark.range(2)

    def broken():
        raise OSError("down")

    sources = [feeds.Source("reddit", broken, fixture), feeds.Source("yelp", fixture, fixture, has_credentials=False), feeds.Source("blog", None, broken)]
    got, runs = feeds.run_all(spark, sources, "m", "2026-01-01")
    assert [(r["source"], r["mode"], r["records_fetched"]) for r in runs.collect()] == [("yelp", "fixture", 2), ("blog", "failed", 0), ("reddit", "fixture", 2)]
    assert feeds.union_sources(got).select("source_rank").distinct().count() == 2


def test_targets_links_robots(spark):
    t = spark.createDataFrame([("a-madrid",), ("b",), ("c",)], "target_id string")
    assert {r[0] for r in feeds.select_targets(t, ["b"], "madrid").collect()} == {"a-madrid", "b"}
    assert feeds.robots_allow(None, "https://x.example/a", "me") and not feeds.robots_allow("User-agent: *\nDisallow: /", "https://x.example/a", "me")


def test_streams(spark, tmp_path):
    from placeweave.streaming.rescoring import upsert_stream, windowed_activity

    rows = [(1, "yelp", 4.0, NOW), (1, "yelp", 4.5, NOW + dt.timedelta(days=1)), (2, "blog", None, NOW)]
    spark.createDataFrame(rows, "place_id long, source string, rating double, observed_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("place_id long, source string, rating double, observed_at timestamp").parquet(str(tmp_path / "in"))
    upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r["place_id"], r["rating"]) for r in spark.read.parquet(str(tmp_path / "out" / "v=0")).collect()} == {(1, 4.5), (2, None)}
    assert windowed_activity(spark.createDataFrame([(NOW, "view", 1.0)], "ts timestamp, event_type string, value double")).count() == 1
