"""Filter, facet, provenance and status queries over places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.functions.geo import haversine_m, within_box


def check_request(**given: object) -> None:
    """Raises ValueError for values out of the ranges that requests allow."""
    ranges = {"days": (1, 14), "max_price_tier": (1, 4), "min_score": (0, 100), "min_sources": (1, 4), "radius_m": (100, 50_000), "limit": (1, 2000)}
    for name, value in given.items():
        if value is not None and not ranges[name][0] <= value <= ranges[name][1]:
            raise ValueError(f"{name} must be between {ranges[name][0]} and {ranges[name][1]}")


def affordable(max_tier: int) -> Column:
    """An unknown price counts as affordable."""
    return F.col("price_tier").isNull() | (F.col("price_tier") <= max_tier)


def canonical(places: DataFrame, city: str | None = None) -> DataFrame:
    """Places of a city that are no duplicate of another."""
    out = places.where(F.col("duplicate_of").isNull()) if "duplicate_of" in places.columns else places
    return out if city is None else out.where(F.col("city") == city)


def in_radius(places: DataFrame, centre: tuple[float, float], radius_m: float) -> DataFrame:
    """Places within a radius, with distance_m; a bounding box goes first."""
    near = places.where(within_box(F.col("lat"), F.col("lng"), centre, radius_m))
    return near.withColumn("distance_m", haversine_m(F.lit(centre[0]), F.lit(centre[1]), F.col("lat"), F.col("lng"))).where(F.col("distance_m") <= radius_m)


def corroborated(places: DataFrame, signals: DataFrame, min_sources: int) -> DataFrame:
    """Places with signals of so many sources at least; no filter for one."""
    if min_sources <= 1:
        return places
    known = signals.groupBy("place_id").agg(F.countDistinct("source").alias("n")).where(F.col("n") >= min_sources)
    return places.join(known, "place_id", "left_semi")


def ranked(places: DataFrame, limit: int) -> DataFrame:
    """The first `limit` places by falling score, unscored ones last, ties by place_id, with `rank`."""
    check_request(limit=limit)
    top = places.orderBy(F.desc_nulls_last("score"), "place_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "place_id")))  # at most 2000 rows


def list_places(
    places: DataFrame,
    signals: DataFrame,
    city: str,
    *,
    categories: Sequence[str] = (),
    tags: Sequence[str] = (),
    max_price_tier: int | None = None,
    min_score: float | None = None,
    min_sources: int | None = None,
    centre: tuple[float, float] | None = None,
    radius_m: float | None = None,
    limit: int = 500,
) -> DataFrame:
    """The places of a map view: every given filter holds; tags are any-of."""
    check_request(max_price_tier=max_price_tier, min_score=min_score, min_sources=min_sources, radius_m=radius_m, limit=limit)
    out = canonical(places, city)
    if categories:
        out = out.where(F.col("category").isin(*categories))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if max_price_tier is not None:
        out = out.where(affordable(max_price_tier))
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    if centre is not None and radius_m:
        out = in_radius(out, centre, radius_m)
    return ranked(corroborated(out, signals, min_sources or 1), limit)


def with_signals(places: DataFrame, signals: DataFrame) -> DataFrame:
    """Places with their signals nested and source_count; an empty list without any."""
    nested = signals.groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct("source", "rating", "review_count", "observed_at"))).alias("source_signals"))
    none = F.expr("CAST(array() AS array<struct<source: string, rating: double, review_count: bigint, observed_at: timestamp>>)")
    held = places.join(nested, "place_id", "left").withColumn("source_signals", F.coalesce("source_signals", none))
    return held.withColumn("source_count", F.size(F.array_distinct("source_signals.source")).cast("long"))


def facet(places: DataFrame, column: str) -> DataFrame:
    """(value, cnt) of a column's known values; each element counts for an array."""
    value = F.explode(column) if column == "tags" else F.col(column)
    return places.select(value.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("cnt"))


def source_facet(places: DataFrame, signals: DataFrame) -> DataFrame:
    return signals.join(places.select("place_id"), "place_id").groupBy(F.col("source").alias("value")).agg(F.count("*").alias("cnt"))


def score_range(places: DataFrame) -> DataFrame:
    return places.agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("score"), F.lit(0.0)).alias("hi"), F.count("*").alias("place_count"))


def facets(places: DataFrame, signals: DataFrame) -> DataFrame:
    """All facets as one table (facet, value, cnt), in one pass over places for the scalar ones."""
    one = places.select(F.explode(F.array(F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")), F.struct(F.lit("price").alias("facet"), F.col("price_tier").cast("string").alias("value")))).alias("f")).select("f.*")
    tags = places.select(F.lit("tag").alias("facet"), F.explode("tags").alias("value"))
    sources = signals.join(places.select("place_id"), "place_id").select(F.lit("source").alias("facet"), F.col("source").alias("value"))
    return one.unionByName(tags).unionByName(sources).where(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("cnt"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each source; ties stay. The maximum is pre-aggregated, so a source's runs meet nowhere."""
    last = runs.groupBy("source").agg(F.max("started_at").alias("last"))
    return runs.join(last, "source").where(F.col("started_at") == F.col("last")).drop("last")


def provenance(runs: DataFrame, signals: DataFrame) -> DataFrame:
    counts = signals.groupBy("source").agg(F.count("*").alias("signals_in_db"))
    return latest_runs(runs).join(counts, "source", "left").withColumn("signals_in_db", F.coalesce("signals_in_db", F.lit(0))).withColumn("is_live", F.col("mode") == "live")


def status(places: DataFrame, signals: DataFrame, reviews: DataFrame, city: str) -> DataFrame:
    """One row of counters; `multi` counts corroborated places of all cities, the others the city's."""
    own = places.where(F.col("city") == city)
    dup = F.col("duplicate_of").isNull() if "duplicate_of" in places.columns else F.lit(True)
    a = own.agg(F.count("*").alias("total"), F.count_if(dup).alias("canonical"), F.count_if(F.col("score").isNotNull()).alias("scored"), F.count_if(F.size("tags") > 0).alias("tagged"))
    b = signals.groupBy("place_id").agg(F.countDistinct("source").alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi"))
    c = reviews.agg(F.count_if(~F.col("resolved")).alias("pending"))
    return a.crossJoin(b).crossJoin(c)  # three single rows


def review_queue(reviews: DataFrame) -> DataFrame:
    return reviews.where(~F.col("resolved")).orderBy(F.desc("confidence"), "left_id", "right_id")


def chips(places: DataFrame, n: int = 22) -> DataFrame:
    """The most common tags that are offered as filters: no topics and no categories."""
    kept = facet(places, "tags").where(~F.col("value").startswith("topic:") & ~F.col("value").startswith("category:"))
    return kept.orderBy(F.desc("cnt"), "value").limit(n)


def base_pins(places: DataFrame, stops: DataFrame) -> DataFrame:
    """Pins of places that no shown day visits, with their radius."""
    radius = 3.0 + F.greatest(F.lit(0.0), (F.coalesce("score", F.lit(40.0)) - 30.0) / 16.0)
    return places.join(stops.select("place_id"), "place_id", "left_anti").select("place_id", "lat", "lng", radius.alias("radius"))


def violations(places: DataFrame) -> DataFrame:
    """Rows that break a table constraint, each with the names of those it breaks."""
    rules = {
        "price_tier": F.col("price_tier").isNull() | F.col("price_tier").between(1, 4),
        "lat": F.col("lat").between(-90, 90),
        "lng": F.col("lng").between(-180, 180),
        "category": F.col("category").isin(*C.CATEGORIES),
    }
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return places.withColumn("broken", broken).where(F.size("broken") > 0)


def health(spark: SparkSession) -> DataFrame:
    """One row if the session answers."""
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(1).alias("answer"))
