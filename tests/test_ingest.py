import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from placeweave.operators import resolve, tagging
from placeweave.plans import documents, ingest, itinerary, routing
from placeweave.sources import comments, mentions

NOW = dt.datetime(2026, 9, 12)
COLUMNS = "source_rank int, source string, source_place_id string, name string, city string, category string, lat double, lng double, price_tier int, rating double, review_count long, sentiment double, upvotes long"


def records(spark, rows):
    text = F.array(F.struct(F.concat(F.lit("about "), "name").alias("text"), F.lit(None).cast("string").alias("url"), F.lit(1.0).alias("weight")))
    return spark.createDataFrame(rows, COLUMNS).withColumn("evidence", text)


ROWS = [
    (0, "google_places", "g1", "Casa Botin", "m", "restaurant", 40.0, -3.0, None, 4.5, 100, None, None),
    (0, "google_places", "g1", "Casa Botin", "m", "restaurant", 40.0, -3.0, None, 4.6, 101, None, None),
    (0, "google_places", "g2", "Museo Prado", "m", "other", 40.1, -3.0, 2, 4.6, 10, None, None),
    (1, "yelp", "y1", "Casa Botín", "m", "other", 40.0001, -3.0, 3, 4.0, 20, None, None),
    (1, "yelp", "y2", "Elsewhere", "m", "cafe", 41.0, -3.0, 3, 4.0, 20, None, None),
    (3, "reddit", "r1", "botin", "m", "other", None, None, None, None, 2, 0.5, 3),
    (3, "reddit", "r2", "casa botin", "m", "other", None, None, None, None, 2, -0.5, 8),
    (3, "reddit", "r3", "unheard of", "m", "other", None, None, None, None, 2, -0.5, 8),
    (3, "reddit", None, "casa botin", "m", "other", None, None, None, None, 2, -0.5, 8),
]


def test_ingest_twice(spark):
    raw = records(spark, ROWS)
    x = ingest.ingest(raw)
    said = lambda t: sorted((r["source"], repr(r["source_place_id"]), r["decision"]) for r in t.outcomes.collect())
    first = [("google_places", "'g1'", "created"), ("google_places", "'g1'", "updated"), ("google_places", "'g2'", "created"), ("reddit", "'r1'", "merged"), ("reddit", "'r2'", "merged"), ("reddit", "'r3'", "dropped"), ("reddit", "None", "dropped"), ("yelp", "'y1'", "merged"), ("yelp", "'y2'", "created")]
    assert said(x) == first
    places = {r["name"]: r for r in x.places.collect()}
    assert set(places) == {"Casa Botin", "Museo Prado", "Elsewhere"} and places["Casa Botin"]["price_tier"] == 3
    signals = {(r["place_id"], r["source"]): r for r in x.signals.collect()}
    botin = places["Casa Botin"]["place_id"]
    assert signals[botin, "google_places"]["rating"] == 4.6  # the identity's last record
    folded = signals[botin, "reddit"]
    assert (folded["source_place_id"], folded["merged_mentions"], folded["upvotes"], folded["review_count"]) == ("r1", 2, 11, 4)
    assert folded["sentiment"] == pytest.approx(round((0.5 * 4 - 0.5 * 9) / 13, 4))
    assert x.evidence.where(F.col("place_id") == botin).count() == 3
    y = ingest.ingest(raw.where("source_place_id IN ('g2', 'y1')").withColumn("review_count", F.lit(7)), x)
    assert {d for _, _, d in said(y)} == {"updated"} and y.places.count() == 3 and y.evidence.count() == x.evidence.count()
    assert {r["review_count"] for r in y.signals.where("source_place_id IN ('g2', 'y1')").collect()} == {7} and y.reviews.count() == x.reviews.count()
    z = ingest.ingest(records(spark, []), y)
    assert z.places.count() == 3 and z.outcomes.count() == 0
    runs = spark.createDataFrame([("google_places", "m", "live", 3, None), ("blog", "m", "failed", 0, "down")], "source string, city string, mode string, records_fetched long, error string")
    lines = {r["source"]: r["line"] for r in ingest.summary_lines(ingest.run_rows(runs, x.outcomes)).collect()}
    assert lines["blog"] == "blog: down" and "created 2, merged 0, updated 1" in lines["google_places"]


def test_decisions_in_rounds_are_those_of_one_task(spark):
    rows = [(i, f"{'Old Stone Bar' if i % 3 else 'Old Stones Bar'} {'x' * (i % 4)}", "m", 40.0 + (i * 7 % 40) * 0.0003, -3.0, i % 9 == 0) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "place_id long, name string, city string, lat double, lng double, settled boolean")
    tell = lambda d: sorted((r["place_id"], r["survivor"], r["decision"], round(r["confidence"], 6), r["match"]) for r in d.collect())
    one, rounds = tell(resolve.resolve(df, "trigram")), tell(resolve.resolve(df, "trigram", one_task=0))
    assert one == rounds and {x[2] for x in one} >= {"merged", "created"}
    assert all(s == i for i, s, *_ in one if i % 9 == 0)  # settled places survive


def test_threads_to_mentions(spark):
    reply = {"kind": "t1", "data": {"body": "we like Casa Dani.", "score": 3, "replies": ""}}
    tree = json.dumps([{}, {"data": {"children": [{"kind": "t1", "data": {"body": "go to Casa Dani.", "score": 4, "replies": {"data": {"children": [reply, "odd"]}}}}]}}])
    rows = [("t1", "Where to eat", "we ate at Mercado Norte.", 30, "m", "/r/1", 5.0, tree, 2), ("t1", "Later copy", "", 99, "m", "/r/1", 5.0, tree, 7), ("t2", "x", None, 40, "m", "", None, "{broken", 3), ("t3", "x", "y", 40, "m", "", None, None, 4)]
    t = spark.createDataFrame(rows, comments.THREAD_SCHEMA + ", seq long")
    docs = comments.documents(t)
    assert [(r["thread_id"], r["part"]) for r in docs.orderBy("seq", "part").collect()] == [("t1", 0), ("t1", 1), ("t1", 2), ("t1", 3), ("t2", 0), ("t3", 0), ("t3", 1)]
    assert comments.unreadable_listings(t).first()["n"] == 1
    found = mentions.aggregate(mentions.extract(docs), "m")
    got = {r["key"]: r for r in found.collect()}
    assert got["casa dani"]["mention_count"] == 2 and got["mercado norte"]["mention_count"] == 1 if "mercado norte" in got else "norte" in got
    raw = mentions.raw_signals(found, "Madrid")
    assert ingest.conform(raw, ingest.RAW).where("name = 'Casa Dani' AND size(evidence) = 2 AND lat IS NULL").count() == 1


def test_feeds_of_many_partitions_do_not_overflow(spark):
    from placeweave.sources import feeds

    big = spark.createDataFrame([(2**62, [("a", ("Name",))]), (2**62 + 1, [("a", ("Later",))])], "seq long, places array<struct<id: string, displayName: struct<text: string>>>")
    whole = big.withColumn("places", F.from_json(F.to_json(F.struct("places")), feeds.MAP_SCHEMA)["places"])
    whole = whole.withColumn("places", F.transform("places", lambda p: p.withField("location", F.struct(F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude")))))
    assert [r["name"] for r in feeds.map_places(whole, "m", "ES", F.lit(NOW)).collect()] == ["Name"]


def test_cache_write_and_list(spark):
    from placeweave.sources import feeds

    old = spark.createDataFrame([("g", "k1", NOW - dt.timedelta(days=9), "{}")], "namespace string, k string, fetched_at timestamp, body string").select("namespace", feeds.cache_key(F.col("k")).alias("digest"), "fetched_at", "body")
    new = feeds.cache_write(old, spark.createDataFrame([("g", "k1", '{"a": 1}'), ("g", "k2", "{broken")], "namespace string, key string, body string"), F.lit(NOW))
    assert {r["fresh"] for r in feeds.cache_entries(new, "g", F.lit(NOW)).collect()} == {True, False} and new.count() == 2
    assert not feeds.cache_entries(old, "g", F.lit(NOW)).first()["fresh"]


POINTS = [{"lat": 40.0, "lng": -3.0}, {"lat": 40.01, "lng": -3.0}]


def test_routing():
    table = json.dumps({"code": "Ok", "distances": [[0, 1250.0], [None, 0]], "durations": [[0, 7.0], [None, 0]]})
    estimate = routing.Estimate().matrix(POINTS)
    assert routing.StreetTable(lambda p, q: table).matrix(POINTS) == [[0.0, 1000.0], [estimate[1][0], 0.0]]
    assert routing.StreetTable(lambda p, q: table, trust_durations=True).matrix(POINTS) == [[0.0, 7.0], [0.0, 0.0]]
    assert routing.StreetTable(lambda p, q: table, mode="transit").matrix(POINTS)[0][1] == pytest.approx(1250 / 4.2 + 360)
    for bad in ("nothing", "[]", '{"code": "No"}', '{"code": "Ok"}'):
        assert routing.StreetTable(lambda p, q, a=bad: a).matrix(POINTS) == estimate

    def down(*_):
        raise OSError("down")

    assert routing.StreetTable(down).matrix(POINTS) == estimate == routing.RouteMatrix(down).matrix(POINTS)
    assert routing.StreetTable(down).matrix(POINTS[:1]) == [[0.0]] and len(routing.StreetTable(down).matrix(POINTS * 50)) == 100
    elements = json.dumps([{"originIndex": 0, "destinationIndex": 1, "duration": "42s"}, {"originIndex": 1, "destinationIndex": 0, "duration": "soon"}, {"originIndex": 1, "destinationIndex": 1, "duration": "9s"}, {}])
    assert routing.RouteMatrix(lambda b: elements).matrix(POINTS) == [[0.0, 42.0], [estimate[1][0], 0.0]]
    kept = routing.provider("osrm", street=lambda p, q: table, street_url="http://own.example")
    kept.matrix(POINTS)
    kept.matrix([{"lat": p["lat"] + 1e-9, "lng": p["lng"]} for p in POINTS])
    assert (kept.hits, kept.misses, kept.name) == (1, 1, "cached:osrm")
    assert routing.provider("osrm", street=down, street_url="https://router.project-osrm.org").name == "cached:haversine" == routing.provider("google").name


def test_documents(spark):
    hours = {d: [("00:00", "23:59")] for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")}
    rows = [(i, f"P{i}", "m", 40.0 + i * 0.002, -3.0, "restaurant" if i % 3 == 0 else "museum" if i % 3 else "park", 1, ["a"], hours, 50.0 + i) for i in range(40)]
    places = spark.createDataFrame(rows, "place_id long, name string, city string, lat double, lng double, category string, price_tier int, tags array<string>, hours map<string, array<struct<open: string, close: string>>>, score double")
    signals = spark.createDataFrame([(1, "yelp", 4.0, 3, None, NOW, None), (1, "reddit", None, 2, "u", NOW, 5)], "place_id long, source string, rating double, review_count long, url string, observed_at timestamp, upvotes long")
    docs = {r["place_id"]: json.loads(r["document"]) for r in documents.place_documents(places, signals).collect()}
    assert docs[1]["source_count"] == 2 and docs[1]["source_signals"][0]["extra"]["upvotes"] == "5" and docs[1]["source_signals"][1]["url"] is None
    assert docs[2]["source_count"] == 0 and not docs[2]["source_signals"] and docs[2]["hours"]["mon"] == [{"open": "00:00", "close": "23:59"}]
    r = itinerary.Request("m", dt.date(2026, 9, 18), days=2)
    plan = itinerary.itineraries(places, {"trip": r}).cache()
    d = json.loads(documents.itinerary_documents(plan, places, {"trip": r}).first()["document"])
    assert d["total_stops"] == plan.where("day IS NOT NULL").count() and [x["weekday"] for x in d["days"]] == ["Friday", "Saturday"] and d["start_date"] == "2026-09-18"
    assert [s["position"] for s in d["days"][0]["stops"]] == list(range(1, len(d["days"][0]["stops"]) + 1)) and len(d["not_scheduled"]) <= 40
    assert d["total_travel_minutes"] == pytest.approx(sum(x["travel_minutes"] for x in d["days"]), abs=0.2)


def test_settle_against_its_rules(spark):
    import itertools

    words = ("budget", "pricey", "quiet", "lively", "hidden-gem", "tourist-trap", "touristy")
    rows = [(list(t), p, q, v) for n in range(len(words) + 1) for t in itertools.combinations(words, n) for p, q, v in ((None, 0.3, 0.2), (3, 0.2, 0.2), (2, None, 0.4))]
    df = spark.createDataFrame(rows, "tags array<string>, price int, q double, v double")
    for r in df.withColumn("out", tagging.settle(F.col("tags"), F.col("price"), F.col("q"), F.col("v"))).collect():
        left = set(r["tags"])
        if {"budget", "pricey"} <= left:
            left.discard("pricey" if (r["price"] or 0) <= 2 else "budget")
        if {"quiet", "lively"} <= left:
            q, v = r["q"] or 0.0, r["v"] or 0.0
            left -= {"quiet", "lively"} if q == v else {"lively"} if q > v else {"quiet"}
        if "hidden-gem" in left and left & {"tourist-trap", "touristy"}:
            left.discard("hidden-gem")
        assert r["out"] == sorted(left)


def test_late_rows_of_a_stream(spark, tmp_path):
    from placeweave.streaming.rescoring import upsert_stream

    schema = "place_id long, source string, rating double, observed_at timestamp"
    for n, (rating, day) in enumerate([(4.0, 5), (3.0, 2), (5.0, 9)]):
        spark.createDataFrame([(1, "yelp", rating, NOW + dt.timedelta(days=day))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out" / f"v={n}")).first()["rating"] == (4.0, 4.0, 5.0)[n]
    assert not (tmp_path / "out" / "v=0").exists() and (tmp_path / "out" / "v=1").exists()


def test_name_similarity_against_plain_tables():
    import random

    from placeweave.functions import text as T

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert T.ratio(a, b) == (2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)
        short, long = sorted((a, b), key=len)
        windows = {long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))} - {""}
        assert T.partial_ratio(a, b) == max((2 * lcs(short, w) / (len(short) + len(w)) for w in windows), default=0.0)
