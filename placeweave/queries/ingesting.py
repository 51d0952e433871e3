"""Ingest queries: feeds, threads, the whole batch and its documents, over records derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave import views as V
from placeweave.functions import hours as H
from placeweave.functions import text as T
from placeweave.operators import browse
from placeweave.operators.graph import cut, spread
from placeweave.plans import documents, ingest, routing
from placeweave.sources import comments, feeds, mentions

_ID = "p_partkey"
#: Places 550 m apart at least, so that only the same place of two feeds is near enough to merge.
_LAT, _LNG = "40.0D + ({id} % 200) * 0.005D", "-3.7D + CAST(floor({id} / 200) AS BIGINT) * 0.01D"


def grid_records(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records of three feeds: places, most of them again in a second feed a few metres off, and mentions of names."""
    part = spread(V.table(spark, sf, "part").select(_ID, "p_name")).selectExpr(f"{_ID} AS id", "p_name", f"{_LAT.format(id=_ID)} AS lat", f"{_LNG.format(id=_ID)} AS lng")
    common = ["'grid' AS city", "named_struct('payload', id, 'at', 0L) AS seq"]
    a = part.where("id % 3 <> 0").selectExpr("0 AS source_rank", "'google_places' AS source", "concat('g', id) AS source_place_id", "p_name AS name", "CASE WHEN id % 4 = 0 THEN 'other' ELSE 'museum' END AS category", "lat", "lng", "3.0D + (id % 5) * 0.25D AS rating", "id % 1000 AS review_count", "array(named_struct('text', concat('about ', p_name), 'url', CAST(NULL AS STRING), 'weight', 1.0D)) AS evidence", *common)
    b = part.where("id % 2 = 0").selectExpr("1 AS source_rank", "'yelp' AS source", "concat('y', id) AS source_place_id", "upper(p_name) AS name", "'restaurant' AS category", "lat + 0.0001D AS lat", "lng", "CAST(1 + id % 4 AS INT) AS price_tier", "2.0D + (id % 5) * 0.5D AS rating", "id % 77 AS review_count", "array(named_struct('text', concat(' ABOUT ', p_name), 'url', CAST(NULL AS STRING), 'weight', 1.0D)) AS evidence", *common)
    c = part.where("id % 7 = 0 AND (id % 3 <> 0 OR id % 2 = 0)").selectExpr("3 AS source_rank", "'reddit' AS source", "concat('r', id) AS source_place_id", "p_name AS name", "'other' AS category", "1 AS review_count", "1 + id % 3 AS mention_count", "id % 11 AS upvotes", "id % 977 AS thread_score", "(id % 21 - 10) / 10.0D AS sentiment", "1 AS thread_count", "array(concat('s', id % 3)) AS subreddits", *common)
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def ingest_places(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.ingest(grid_records(spark, sf)).places.select("name", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), "category", "price_tier")


def ingest_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = ingest.ingest(grid_records(spark, sf))
    named = out.signals.join(out.places.select("place_id", "name"), "place_id")
    return named.select("source", "source_place_id", "name", "rating", "review_count", "mention_count", "upvotes", "thread_score", F.round("sentiment", 3).alias("sentiment"), "merged_mentions", F.array_join("subreddits", ",").alias("subreddits"))


def ingest_evidence(spark: SparkSession, sf: str) -> DataFrame:
    out = ingest.ingest(grid_records(spark, sf))
    return out.evidence.join(out.places.select("place_id", "name"), "place_id").groupBy("name", "source", "text").agg(F.count("*").alias("cnt"))


def ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twice: what was new first is an update then."""
    raw = grid_records(spark, sf)
    first = ingest.ingest(raw)
    # the second run reads these many times
    again = ingest.ingest(raw, ingest.Tables(cut(first.places), cut(first.signals), first.evidence, first.reviews))
    tell = lambda x, n: x.outcomes.groupBy("source", "decision").agg(F.count("*").alias("cnt")).withColumn("run", F.lit(n))
    return tell(first, 1).union(tell(again, 2).where("source <> 'reddit'"))


def map_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Search payloads of 20 places, through JSON and back; every tenth place again in the next payload."""
    part = V.table(spark, sf, "part").selectExpr(f"{_ID} AS id", "p_name")
    copies = part.withColumn("again", F.lit(0)).union(part.where("id % 10 = 0").withColumn("again", F.lit(1)))
    place = """named_struct('again', again, 'n', id, 'id', concat('p', id), 'displayName', named_struct('text', CASE WHEN id % 13 = 0 THEN '' WHEN again = 1 THEN 'again' ELSE p_name END),
      'location', CASE WHEN id % 17 <> 0 THEN named_struct('latitude', 40.0D + id * 0.0001D, 'longitude', -3.0D) END,
      'types', array(element_at(array('night_club', 'coffee_shop', 'art_gallery', 'zoo', 'lodging', 'food', 'unknown_kind'), CAST(id % 7 + 1 AS INT)), 'point_of_interest'),
      'rating', id % 50 / 10.0D, 'userRatingCount', id % 900, 'priceLevel', element_at(array('PRICE_LEVEL_FREE', 'PRICE_LEVEL_MODERATE', 'PRICE_LEVEL_EXPENSIVE', 'PRICE_LEVEL_VERY_EXPENSIVE', 'OTHER'), CAST(id % 5 + 1 AS INT)),
      'regularOpeningHours', named_struct('periods', array(named_struct('open', named_struct('day', id % 7, 'hour', 9, 'minute', 5), 'close', CASE WHEN id % 11 <> 0 THEN named_struct('day', id % 7, 'hour', 18, 'minute', 30) END))),
      'websiteUri', CASE WHEN id % 2 = 0 THEN concat('w', id) END, 'googleMapsUri', concat('m', id), 'editorialSummary', CASE WHEN id % 3 = 0 THEN named_struct('text', concat('all of ', p_name)) END)"""
    payloads = copies.groupBy(F.floor(F.col("id") / 20).alias("seq0"), "again").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.expr(place))).alias("places"))).alias("body"))
    read = payloads.select((F.col("seq0") + 100_000_000 * F.col("again")).alias("seq"), F.from_json("body", feeds.MAP_SCHEMA).alias("p")).select("seq", "p.places")
    out = feeds.map_places(read, "grid", "ES", F.lit(V.NOW).cast("timestamp"))
    slot = F.try_element_at(F.flatten(F.map_values("hours")), F.lit(1))
    return out.select("source_place_id", "name", "category", "price_tier", "rating", "review_count", "url", F.size("evidence").alias("n_evidence"), slot["open"].alias("opens"), slot["close"].alias("closes"))


def listing_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Business payloads of 20, through JSON and back."""
    part = V.table(spark, sf, "part").selectExpr(f"{_ID} AS id", "p_name")
    business = """named_struct('n', id, 'id', CASE WHEN id % 19 <> 0 THEN concat('b', id) END, 'name', CASE WHEN id % 13 = 0 THEN '' ELSE p_name END, 'coordinates', CASE WHEN id % 17 <> 0 THEN named_struct('latitude', 40.0D, 'longitude', -3.0D) END,
      'categories', array(named_struct('alias', element_at(array('danceclubs', 'cocktailbars', 'coffeeroasteries', 'museums', 'hotels', 'tapasmallplates', 'plumbing'), CAST(id % 7 + 1 AS INT)), 'title', 'Kind')),
      'location', named_struct('city', element_at(array('Grid ', 'Outer', CAST(NULL AS STRING)), CAST(id % 3 + 1 AS INT)), 'display_address', CASE WHEN id % 4 = 0 THEN array() ELSE array('One', concat('No ', id)) END),
      'price', CASE WHEN id % 6 > 0 THEN repeat('€', CAST(id % 6 AS INT)) END, 'rating', id % 50 / 10.0D, 'review_count', id % 900, 'url', concat('u', id),
      'hours', array(named_struct('open', array(named_struct('day', id % 7, 'start', '0930', 'end', CASE WHEN id % 11 = 0 THEN 'later' ELSE '0130' END)))), 'reviews', CASE WHEN id % 5 = 0 THEN array(named_struct('text', 'fine', 'url', 'x'), named_struct('text', '', 'url', 'y')) END)"""
    payloads = part.groupBy(F.floor(F.col("id") / 20).alias("seq")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.expr(business))).alias("businesses"))).alias("body"))
    read = payloads.select("seq", F.from_json("body", feeds.LISTING_SCHEMA).alias("p")).select("seq", "p.businesses")
    out = feeds.listing_places(feeds.explode_listings(read), "Grid", "ES", F.lit(V.NOW).cast("timestamp"))
    slot = F.try_element_at(F.flatten(F.map_values("hours")), F.lit(1))
    return out.select("source_place_id", "name", "category", "price_tier", "neighborhood", "address", F.size("evidence").alias("n_evidence"), slot["open"].alias("opens"))


def thread_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Threads with a text, a comment and a reply to it, some of them found twice; signals of the names they mention."""
    names = "array('Quill', 'Ember', 'Harbor', 'Lantern', 'Mosaic')"
    orders = V.table(spark, sf, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS k", f"element_at({names}, CAST(o_custkey % 5 + 1 AS INT)) AS one", f"element_at({names}, CAST(o_custkey % 3 + 1 AS INT)) AS two")
    found = orders.selectExpr("*", "k AS seq", "CAST(k % 60 AS INT) AS score").union(orders.where("k % 40 = 0").selectExpr("*", "k + 10000000000 AS seq", "59 AS score"))
    reply = "named_struct('kind', 't1', 'data', named_struct('body', 'we like Zaffre Ember.', 'score', 3, 'replies', ''))"
    listing = f"to_json(named_struct('data', named_struct('children', array(named_struct('kind', 't1', 'data', named_struct('body', concat('also Zaffre ', two, ' is fine.'), 'score', k % 5, 'replies', named_struct('data', named_struct('children', array({reply})))))))))"
    threads = found.selectExpr("concat('t', k) AS id", "seq", "score", "'plans for today' AS title", "concat('we ate at Zaffre ', one, ' with friends.') AS selftext", "element_at(array('m', 'n'), CAST(k % 8 / 4 AS INT) + 1) AS subreddit", "concat('/r/', k) AS permalink", "CAST(k AS DOUBLE) AS created_utc", f"CASE WHEN k % 28 = 0 THEN '{{broken' ELSE {listing} END AS comments")
    out = mentions.aggregate(mentions.extract(comments.documents(threads)), "grid")
    return out.select("source_place_id", "key", "name", "mention_count", "upvotes", "thread_score", "thread_count", F.array_join("subreddits", ",").alias("subreddits"), F.row_number().over(mentions.in_order()).alias("position"))


def place_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON documents of all places, read back."""
    docs = documents.place_documents(V.scored_places(spark, sf), V.signals(spark, sf))
    at = lambda path: F.get_json_object("document", path)
    return docs.select("place_id", at("$.name").alias("name"), at("$.price_tier").cast("int").alias("price_tier"), at("$.source_count").cast("long").alias("source_count"), F.coalesce(at("$.source_signals[0].source"), F.lit("")).alias("first_source"), F.round(at("$.composite_score").cast("double"), 4).alias("score"))


def routed_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds of a routing service's distance table: legs that it can't route are estimated."""
    part = V.table(spark, sf, "part").selectExpr(f"{_ID} AS id", f"{_LAT.format(id=_ID)} AS lat", f"{_LNG.format(id=_ID)} AS lng")
    legs = part.selectExpr("id AS i", "id + 1 AS j", "lat AS lat1", "lng AS lng1", "lat + 0.002D AS lat2", "lng AS lng2", "CASE WHEN id % 5 <> 0 THEN CAST(id % 3000 AS DOUBLE) END AS metres")
    return legs.select("i", "j", F.round(routing.leg_seconds("transit"), 3).alias("seconds"))


def link_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Links, tidied names and prices in words."""
    p = V.table(spark, sf, "part").selectExpr(f"{_ID} AS id", "p_name", "element_at(array('//x.example/', '/', 'https://y.example/', ''), CAST(p_partkey % 4 + 1 AS INT)) AS lead")
    href = F.when(F.col("lead") != "", F.concat("lead", F.col("id").cast("string"))).otherwise("")
    price = F.element_at(F.array(*map(F.lit, ("€€", "Free entry", "€9", "from €25,50", "$ 45", "€99.9", "ask"))), (F.col("id") % 7 + 1).cast("int"))
    return p.select("id", feeds.absolute_url(href, F.lit("https://base.example/wiki/M")).alias("link"), T.tidy_name(F.concat(F.lit(" - "), "p_name", F.lit("  [dead link] ;"))).alias("name"), T.price_tier(price).alias("tier"))


def parsed_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hours in words, for each weekday."""
    said = F.element_at(F.array(*map(F.lit, ("Mon-Fri 09:00-17:30", "daily 10:00-22:00", "Sat-Sun 11:00-02:00", "closed for now"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = V.table(spark, sf, "part").select("p_partkey", H.parse_text(said).alias("hours"))
    return p.select("p_partkey", F.size(F.filter(F.map_values("hours"), lambda d: F.size(d) > 0)).alias("open_days"))


def health(spark: SparkSession, sf: str) -> DataFrame:
    return browse.health(spark)


QUERIES = {f.__name__: f for f in (ingest_places, ingest_signals, ingest_evidence, ingest_counters, map_feed, listing_feed, thread_mentions, place_documents, routed_legs, link_texts, parsed_hours, health)}

_GRID = """
v_grid AS (SELECT p_partkey AS id, p_name, 40.0::DOUBLE + (p_partkey % 200) * 0.005::DOUBLE AS lat, -3.7::DOUBLE + (p_partkey // 200) * 0.01::DOUBLE AS lng FROM part),
v_new AS (
  SELECT id, CASE WHEN id % 3 <> 0 THEN 0 ELSE 1 END AS rank, CASE WHEN id % 3 <> 0 THEN p_name ELSE upper(p_name) END AS name, p_name, CASE WHEN id % 3 <> 0 THEN lat ELSE lat + 0.0001 END AS lat, lng,
    CASE WHEN id % 3 = 0 THEN 'restaurant' WHEN id % 4 <> 0 THEN 'museum' ELSE 'restaurant' END AS category, CASE WHEN id % 2 = 0 THEN CAST(1 + id % 4 AS INTEGER) END AS price_tier
  FROM v_grid WHERE id % 3 <> 0 OR id % 2 = 0),
v_first AS (SELECT p_name, first(id ORDER BY rank, id) AS place, first(name ORDER BY rank, id) AS name FROM v_new GROUP BY 1)"""
_FOLD = """
v_said AS (SELECT first(name) AS name, min(id) AS lead, list(struct_pack(s := (id % 21 - 10) / 10.0::DOUBLE, u := CAST(id % 11 AS BIGINT)) ORDER BY id) AS items, sum(1 + id % 3) AS mention_count, sum(id % 11) AS upvotes, max(id % 977) AS thread_score, count(*) AS n, string_agg(DISTINCT 's' || (id % 3), ',' ORDER BY 's' || (id % 3)) AS subreddits
  FROM (SELECT g.id, f.place, f.name FROM v_grid g JOIN v_first f USING (p_name) WHERE g.id % 7 = 0 AND (g.id % 3 <> 0 OR g.id % 2 = 0)) GROUP BY place)"""
_THREADS = """
WITH o AS (SELECT o_orderkey AS k, ['Quill', 'Ember', 'Harbor', 'Lantern', 'Mosaic'][o_custkey % 5 + 1] AS one, ['Quill', 'Ember', 'Harbor', 'Lantern', 'Mosaic'][o_custkey % 3 + 1] AS two FROM orders WHERE o_orderkey % 4 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM (SELECT *, k AS seq, k % 60 AS score FROM o UNION ALL SELECT *, k + 10000000000, 59 FROM o WHERE k % 40 = 0) WHERE score >= 25) WHERE r = 1),
d AS (
  SELECT k, one AS name, score AS up, score FROM t
  UNION ALL SELECT k, two, k % 5, score FROM t WHERE k % 28 <> 0 AND k % 5 >= 2
  UNION ALL SELECT k, 'Ember', 3, score FROM t WHERE k % 28 <> 0)
SELECT 'reddit:' || substring(sha1('grid|zaffre ' || lower(name)), 1, 20) AS source_place_id, 'zaffre ' || lower(name) AS key, 'Zaffre ' || name AS name, count(*) AS mention_count, CAST(sum(up) AS BIGINT) AS upvotes, max(score) AS thread_score,
  count(DISTINCT k) AS thread_count, string_agg(DISTINCT ['m', 'n'][k % 8 // 4 + 1], ',' ORDER BY ['m', 'n'][k % 8 // 4 + 1]) AS subreddits, CAST(row_number() OVER (ORDER BY count(*) DESC, sum(up) DESC, 'zaffre ' || lower(name)) AS INTEGER) AS position
FROM d GROUP BY name"""

ORACLE_SQL = {
    "ingest_places": V.with_views("SELECT name, round(lat, 5) AS lat, round(lng, 5) AS lng, category, price_tier FROM v_new", _GRID),
    "ingest_signals": V.with_views(
        """SELECT 'google_places' AS source, 'g' || id AS source_place_id, p_name AS name, 3.0::DOUBLE + (id % 5) * 0.25::DOUBLE AS rating, CAST(id % 1000 AS BIGINT) AS review_count, 0::BIGINT AS mention_count, 0::BIGINT AS upvotes, 0::BIGINT AS thread_score, NULL::DOUBLE AS sentiment, 1 AS merged_mentions, NULL AS subreddits FROM v_grid WHERE id % 3 <> 0
UNION ALL SELECT 'yelp', 'y' || id, CASE WHEN id % 3 <> 0 THEN p_name ELSE upper(p_name) END, 2.0::DOUBLE + (id % 5) * 0.5::DOUBLE, CAST(id % 77 AS BIGINT), 0, 0, 0, NULL, 1, NULL FROM v_grid WHERE id % 2 = 0
UNION ALL SELECT 'reddit', 'r' || lead, name, NULL, n, CAST(mention_count AS BIGINT), CAST(upvotes AS BIGINT), thread_score, round(list_reduce(items, lambda a, x: struct_pack(s := round_even((a.s * (a.u + 1) + x.s * (x.u + 1)) / (a.u + x.u + 2), 4)::DOUBLE, u := a.u + x.u)).s, 3), CAST(n AS INTEGER), subreddits FROM v_said""",
        _GRID, _FOLD,
    ),
    "ingest_evidence": V.with_views("SELECT name, source, text, count(*) AS cnt FROM (SELECT p_name AS name, 'google_places' AS source, 'about ' || p_name AS text FROM v_grid WHERE id % 3 <> 0 UNION ALL SELECT upper(p_name), 'yelp', 'ABOUT ' || p_name FROM v_grid WHERE id % 2 = 0 AND id % 3 = 0) GROUP BY 1, 2, 3", _GRID),
    "ingest_counters": V.with_views(
        """SELECT source, decision, count(*) AS cnt, run FROM (
  SELECT 'google_places' AS source, 'created' AS decision, 1 AS run FROM v_grid WHERE id % 3 <> 0 UNION ALL SELECT 'yelp', CASE WHEN id % 3 <> 0 THEN 'merged' ELSE 'created' END, 1 FROM v_grid WHERE id % 2 = 0
  UNION ALL SELECT 'reddit', 'merged', 1 FROM v_grid WHERE id % 7 = 0 AND (id % 3 <> 0 OR id % 2 = 0)
  UNION ALL SELECT 'google_places', 'updated', 2 FROM v_grid WHERE id % 3 <> 0 UNION ALL SELECT 'yelp', 'updated', 2 FROM v_grid WHERE id % 2 = 0) GROUP BY source, decision, run""",
        _GRID,
    ),
    "map_feed": """SELECT 'p' || p_partkey AS source_place_id, p_name AS name, ['nightlife', 'cafe', 'museum', 'attraction', 'hotel', 'restaurant', 'other'][p_partkey % 7 + 1] AS category, [1, 2, 3, 4, NULL][p_partkey % 5 + 1] AS price_tier,
  p_partkey % 50 / 10.0::DOUBLE AS rating, CAST(p_partkey % 900 AS INTEGER) AS review_count, CASE WHEN p_partkey % 2 = 0 THEN 'w' || p_partkey ELSE 'm' || p_partkey END AS url, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n_evidence, CASE WHEN p_partkey % 11 = 0 THEN '00:00' ELSE '09:05' END AS opens, CASE WHEN p_partkey % 11 = 0 THEN '23:59' ELSE '18:30' END AS closes
FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 <> 0""",
    "listing_feed": """SELECT 'b' || p_partkey AS source_place_id, p_name AS name, ['nightlife', 'bar', 'cafe', 'museum', 'hotel', 'restaurant', 'other'][p_partkey % 7 + 1] AS category, CASE WHEN p_partkey % 6 BETWEEN 1 AND 4 THEN CAST(p_partkey % 6 AS INTEGER) END AS price_tier,
  CASE WHEN p_partkey % 3 = 1 THEN 'Outer' END AS neighborhood, CASE WHEN p_partkey % 4 <> 0 THEN 'One, No ' || p_partkey END AS address, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS n_evidence, CASE WHEN p_partkey % 11 <> 0 THEN '09:30' END AS opens
FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0""",
    "thread_mentions": _THREADS,
    "place_documents": V.with_views("SELECT place_id, name, price_tier, source_count, coalesce(first_source, '') AS first_source, round(score, 4) AS score FROM v_full LEFT JOIN (SELECT place_id, min(source) AS first_source FROM v_signal GROUP BY 1) USING (place_id)", V.PLACES, V.SIGNALS, V.SCORES),
    "routed_legs": "SELECT p_partkey AS i, p_partkey + 1 AS j, round(m / 4.2 + CASE WHEN m > 800 THEN 360 ELSE 0 END, 3)::DOUBLE AS seconds FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 3000 AS DOUBLE) ELSE 1.35 * 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians((40.0::DOUBLE + (p_partkey % 200) * 0.005::DOUBLE + 0.002::DOUBLE) - (40.0::DOUBLE + (p_partkey % 200) * 0.005::DOUBLE)) / 2), 2))) END AS m FROM part)",
    "link_texts": "SELECT p_partkey AS id, ['https://x.example/' || p_partkey, 'https://base.example/' || p_partkey, 'https://y.example/' || p_partkey, NULL][p_partkey % 4 + 1] AS link, p_name AS name, [2, 1, 1, 2, 3, 4, NULL][p_partkey % 7 + 1] AS tier FROM part",
    "parsed_hours": "SELECT p_partkey, [5, 7, 2, NULL][p_partkey % 4 + 1] AS open_days FROM part",
    "health": "SELECT 'ok' AS status, 1 AS answer",
}
