"""Browse queries: filters, facets, provenance, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave import views as V
from placeweave.operators import browse

ALL = (V.PLACES, V.SIGNALS, V.SCORES)
D = "CASE WHEN true THEN 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))) END"


def distance_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return D.format(a=lat1, b=lat2, c=lng1, d=lng2)


def places_filtered(spark: SparkSession, sf: str) -> DataFrame:
    out = browse.list_places(V.scored_places(spark, sf), V.signals(spark, sf), "city-2", categories=("restaurant", "museum", "park"), tags=("ring", "promo"), max_price_tier=3, min_score=40.0, min_sources=2, limit=200)
    return out.select("place_id", "category", "price_tier", F.round("score", 4).alias("score"))


def places_in_radius(spark: SparkSession, sf: str) -> DataFrame:
    return browse.in_radius(V.places(spark, sf), V.HOME, 1609.0).select("place_id", F.round("distance_m", 3).alias("distance_m"))


def avoid_tags(spark: SparkSession, sf: str) -> DataFrame:
    p = V.places(spark, sf)
    return p.where(~F.arrays_overlap("tags", F.array(F.lit("promo"), F.lit("brand#11"))) & ~F.col("category").isin("hotel")).select("place_id", "category")


def facet_categories(spark: SparkSession, sf: str) -> DataFrame:
    return browse.facet(V.places(spark, sf), "category")


def facet_tags(spark: SparkSession, sf: str) -> DataFrame:
    return browse.facet(V.places(spark, sf), "tags")


def facet_prices(spark: SparkSession, sf: str) -> DataFrame:
    return browse.facet(V.places(spark, sf), "price_tier")


def facet_sources(spark: SparkSession, sf: str) -> DataFrame:
    return browse.source_facet(V.places(spark, sf), V.signals(spark, sf))


def facet_score_range(spark: SparkSession, sf: str) -> DataFrame:
    return browse.score_range(V.scored_places(spark, sf)).select(F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), "place_count")


def facets_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return browse.facets(V.places(spark, sf), V.signals(spark, sf))


def latest_run_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return browse.latest_runs(V.runs(spark, sf)).select("source", "mode", "run_id", "fetched")


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    sources = F.element_at(F.array(*map(F.lit, ("google_places", "yelp", "blog", "reddit", "other"))), F.substring("source", 1, 1).cast("int"))
    runs = V.runs(spark, sf).withColumn("source", sources)
    return browse.provenance(runs, V.signals(spark, sf)).select("source", "mode", "is_live", "run_id", "signals_in_db")


def signals_per_place(spark: SparkSession, sf: str) -> DataFrame:
    out = browse.with_signals(V.places(spark, sf), V.signals(spark, sf))
    return out.select("place_id", "source_count", F.array_join("source_signals.source", ",").alias("sources"))


def status_counters(spark: SparkSession, sf: str) -> DataFrame:
    reviews = V.table(spark, sf, "orders").select((F.col("o_orderkey") % 3 == 0).alias("resolved"))
    return browse.status(V.scored_places(spark, sf), V.signals(spark, sf), reviews, "city-0")


def tag_chips(spark: SparkSession, sf: str) -> DataFrame:
    return browse.chips(V.places(spark, sf))


def base_pins(spark: SparkSession, sf: str) -> DataFrame:
    scored = V.scored_places(spark, sf)
    return browse.base_pins(scored, scored.where("score > 60")).select("place_id", F.round("radius", 5).alias("radius"))


def place_violations(spark: SparkSession, sf: str) -> DataFrame:
    shifted = V.places(spark, sf).withColumn("price_tier", F.col("price_tier") + F.when(F.col("place_id") % 10 == 0, 3).otherwise(0)).withColumn("lat", F.col("lat") + F.when(F.col("place_id") % 17 == 0, 60.0).otherwise(0.0))
    return browse.violations(shifted).select("place_id", F.array_join("broken", ",").alias("broken"))


def place_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return V.places(spark, sf).where("place_id = 42").select("place_id", "name", "city")


QUERIES = {
    f.__name__: f
    for f in (places_filtered, places_in_radius, avoid_tags, facet_categories, facet_tags, facet_prices, facet_sources, facet_score_range, facets_bundle, latest_run_per_source, provenance, signals_per_place, status_counters, tag_chips, base_pins, place_violations, place_by_id)
}

_RUNS = "v_run AS (SELECT o_orderpriority AS source, o_orderstatus AS mode, o_orderdate AS started_at, o_orderkey AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS fetched FROM orders)"
_TAGS = "(SELECT unnest(tags) AS value FROM v_place)"

ORACLE_SQL = {
    "places_filtered": V.with_views("SELECT place_id, category, price_tier, round(score, 4) AS score FROM v_full WHERE city = 'city-2' AND category IN ('restaurant', 'museum', 'park') AND list_has_any(tags, ['ring', 'promo']) AND (price_tier IS NULL OR price_tier <= 3) AND score >= 40 AND source_count >= 2 ORDER BY v_full.score DESC, place_id LIMIT 200", *ALL),
    "places_in_radius": V.with_views(f"SELECT place_id, round(d, 3) AS distance_m FROM (SELECT place_id, {distance_sql('40.4168::DOUBLE', '(-3.7038)::DOUBLE', 'lat', 'lng')} AS d FROM v_place) WHERE d <= 1609", V.PLACES),
    "avoid_tags": V.with_views("SELECT place_id, category FROM v_place WHERE NOT list_has_any(tags, ['promo', 'brand#11']) AND category <> 'hotel'", V.PLACES),
    "facet_categories": V.with_views("SELECT category AS value, count(*) AS cnt FROM v_place GROUP BY 1", V.PLACES),
    "facet_tags": V.with_views(f"SELECT value, count(*) AS cnt FROM {_TAGS} GROUP BY 1", V.PLACES),
    "facet_prices": V.with_views("SELECT price_tier AS value, count(*) AS cnt FROM v_place WHERE price_tier IS NOT NULL GROUP BY 1", V.PLACES),
    "facet_sources": V.with_views("SELECT source AS value, count(*) AS cnt FROM v_signal JOIN v_place USING (place_id) GROUP BY 1", V.PLACES, V.SIGNALS),
    "facet_score_range": V.with_views("SELECT round(min(score), 5) AS lo, round(max(score), 5) AS hi, count(*) AS place_count FROM v_full", *ALL),
    "facets_bundle": V.with_views(
        f"SELECT 'category' AS facet, category AS value, count(*) AS cnt FROM v_place GROUP BY 2 UNION ALL SELECT 'price', CAST(price_tier AS VARCHAR), count(*) FROM v_place WHERE price_tier IS NOT NULL GROUP BY 2 UNION ALL SELECT 'tag', value, count(*) FROM {_TAGS} GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM v_signal JOIN v_place USING (place_id) GROUP BY 2",
        V.PLACES, V.SIGNALS,
    ),
    "latest_run_per_source": f"WITH {_RUNS} SELECT source, mode, run_id, fetched FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY started_at DESC) AS r FROM v_run) WHERE r = 1",
    "provenance": V.with_views(
        "SELECT source, mode, mode = 'live' AS is_live, run_id, coalesce(n, 0) AS signals_in_db FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY started_at DESC) AS r FROM (SELECT ['google_places', 'yelp', 'blog', 'reddit', 'other'][CAST(source[1] AS INTEGER)] AS source, mode, started_at, run_id FROM v_run)) LEFT JOIN (SELECT source, count(*) AS n FROM v_signal GROUP BY 1) USING (source) WHERE r = 1",
        V.PLACES, V.SIGNALS, _RUNS,
    ),
    "signals_per_place": V.with_views("SELECT place_id, coalesce(n, 0) AS source_count, coalesce(sources, '') AS sources FROM v_place LEFT JOIN (SELECT place_id, count(DISTINCT source) AS n, string_agg(source, ',' ORDER BY source) AS sources FROM v_signal GROUP BY 1) USING (place_id)", V.PLACES, V.SIGNALS),
    "status_counters": V.with_views("SELECT count(*) AS total, count(*) AS canonical, count(score) AS scored, count(*) FILTER (WHERE len(tags) > 0) AS tagged, (SELECT count(*) FROM (SELECT place_id FROM v_signal GROUP BY 1 HAVING count(DISTINCT source) > 1)) AS multi, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS pending FROM v_full WHERE city = 'city-0'", *ALL),
    "tag_chips": V.with_views(f"SELECT value, count(*) AS cnt FROM {_TAGS} GROUP BY 1 ORDER BY cnt DESC, value LIMIT 22", V.PLACES),
    "base_pins": V.with_views("SELECT place_id, round(3.0 + greatest(0.0, (score - 30.0) / 16.0), 5)::DOUBLE AS radius FROM v_full WHERE NOT score > 60", *ALL),
    "place_violations": V.with_views("SELECT place_id, concat_ws(',', CASE WHEN p > 4 THEN 'price_tier' END, CASE WHEN abs(l) > 90 THEN 'lat' END) AS broken FROM (SELECT place_id, price_tier + CASE WHEN place_id % 10 = 0 THEN 3 ELSE 0 END AS p, lat + CASE WHEN place_id % 17 = 0 THEN 60.0 ELSE 0.0 END AS l FROM v_place) WHERE coalesce(p > 4, false) OR abs(l) > 90", V.PLACES),
    "place_by_id": V.with_views("SELECT place_id, name, city FROM v_place WHERE place_id = 42", V.PLACES),
}
