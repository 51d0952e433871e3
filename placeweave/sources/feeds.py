"""JSON listings of two services as raw places, their order, cache and audit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.functions import hours as H
from placeweave.functions import text as T

#: Businesses that get their details, by falling review count.
DETAILED = 15
CACHE_TTL_S = 7 * 24 * 3600

# Price levels of the map service.
PRICE_LEVELS = {"PRICE_LEVEL_FREE": 1, "PRICE_LEVEL_INEXPENSIVE": 1, "PRICE_LEVEL_MODERATE": 2, "PRICE_LEVEL_EXPENSIVE": 3, "PRICE_LEVEL_VERY_EXPENSIVE": 4}

_AT = "struct<day: int, hour: int, minute: int>"
MAP_SCHEMA = (
    "places array<struct<id: string, displayName: struct<text: string>, formattedAddress: string, location: struct<latitude: double, longitude: double>, types: array<string>, primaryType: string, "
    f"rating: double, userRatingCount: int, priceLevel: string, regularOpeningHours: struct<periods: array<struct<open: {_AT}, close: {_AT}>>>, websiteUri: string, googleMapsUri: string, editorialSummary: struct<text: string>>>"
)
LISTING_SCHEMA = (
    "businesses array<struct<id: string, name: string, alias: string, coordinates: struct<latitude: double, longitude: double>, categories: array<struct<alias: string, title: string>>, "
    "location: struct<city: string, country: string, display_address: array<string>>, price: string, rating: double, review_count: int, url: string, is_closed: boolean, "
    "hours: array<struct<open: array<struct<day: int, start: string, end: string>>>>, reviews: array<struct<text: string, url: string>>>>"
)
_EVIDENCE = "array<struct<text: string, url: string, weight: double>>"


def first_seen(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the one that comes first by `seq`. The smallest seq is pre-aggregated."""
    return df.join(df.groupBy(key).agg(F.min("seq").alias("seq")), [key, "seq"], "left_semi")


def _struct_text(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url"), F.lit(1.0).alias("weight"))).cast(_EVIDENCE)


def map_places(payloads: DataFrame, city: str, country: str, fetched_at: Column) -> DataFrame:
    """Raw places of search payloads(places, seq) of MAP_SCHEMA: the first of each id; without coordinates or a name there is none."""
    p = payloads.select("seq", F.posexplode("places").alias("at", "p"))
    p = p.select(F.struct(F.col("seq").alias("payload"), "at").alias("seq"), "p.*").where("id IS NOT NULL")
    p = first_seen(p, "id").where("location.latitude IS NOT NULL AND location.longitude IS NOT NULL AND displayName.text <> ''")
    types = F.coalesce("types", F.expr("CAST(array() AS array<string>)"))
    summary = F.col("editorialSummary.text")
    tier = None
    for level, n in PRICE_LEVELS.items():
        tier = F.when(F.col("priceLevel") == level, n) if tier is None else tier.when(F.col("priceLevel") == level, n)
    return p.select(
        "seq", F.lit("google_places").alias("source"), F.col("id").alias("source_place_id"), F.col("displayName.text").alias("name"), F.lit(city).alias("city"), F.lit(country).alias("country_code"),
        T.category(types, T.MAP_TYPES, F.col("primaryType")).alias("category"), F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lng"), F.col("formattedAddress").alias("address"), F.lit(None).cast("string").alias("neighborhood"),
        tier.alias("price_tier"), H.from_periods(F.col("regularOpeningHours.periods")).alias("hours"), "rating", F.col("userRatingCount").alias("review_count"), F.coalesce("websiteUri", "googleMapsUri").alias("url"), fetched_at.alias("observed_at"),
        F.when(summary != "", _struct_text(F.array(F.struct(summary.alias("text"), F.col("googleMapsUri").alias("url"))))).otherwise(F.expr(f"CAST(array() AS {_EVIDENCE})")).alias("evidence"), F.slice(types, 1, 8).alias("types"),
    )


def with_details(businesses: DataFrame, details: DataFrame, reviews: DataFrame, most: int = DETAILED) -> DataFrame:
    """businesses with hours and reviews of the `most` most reviewed ones; those that failed stay as they are."""
    top = businesses.orderBy(F.desc_nulls_last("review_count"), "id").limit(most).select("id")
    chosen = lambda df, c: df.join(top, "id", "left_semi").select("id", F.col(c).alias(f"new_{c}"))
    out = businesses.join(chosen(details, "hours"), "id", "left").join(chosen(reviews, "reviews"), "id", "left")
    return out.withColumns({c: F.coalesce(f"new_{c}", c) for c in ("hours", "reviews")}).drop("new_hours", "new_reviews")


def explode_listings(payloads: DataFrame) -> DataFrame:
    """One row a business of payloads(businesses, seq) of LISTING_SCHEMA, the first of each id."""
    b = payloads.select("seq", F.posexplode("businesses").alias("at", "b")).select(F.struct(F.col("seq").alias("payload"), "at").alias("seq"), "b.*")
    return first_seen(b.where("id IS NOT NULL AND id <> ''"), "id")


def listing_places(businesses: DataFrame, city: str, country: str, fetched_at: Column) -> DataFrame:
    """Raw places of businesses; one needs coordinates, a name and an id."""
    b = businesses.where("coordinates.latitude IS NOT NULL AND coordinates.longitude IS NOT NULL AND name <> ''")
    none = F.expr("CAST(array() AS array<string>)")
    aliases, titles = F.coalesce("categories.alias", none), F.coalesce("categories.title", none)
    own = F.lower(F.trim(F.coalesce("location.city", F.lit(""))))
    return b.select(
        "seq", F.lit("yelp").alias("source"), F.col("id").alias("source_place_id"), "name", F.lit(city).alias("city"), F.coalesce("location.country", F.lit(country)).alias("country_code"),
        T.category(F.concat(aliases, titles), T.LISTING_TYPES).alias("category"), F.col("coordinates.latitude").alias("lat"), F.col("coordinates.longitude").alias("lng"), F.nullif(F.array_join(F.coalesce("location.display_address", none), ", "), F.lit("")).alias("address"),
        F.when(own != city.lower(), F.col("location.city")).alias("neighborhood"), F.when(F.length("price").between(1, 4), F.length("price")).alias("price_tier"), H.from_entries(F.try_element_at(F.col("hours"), F.lit(1))["open"]).alias("hours"),
        "rating", "review_count", "url", fetched_at.alias("observed_at"), F.coalesce(_struct_text(F.filter("reviews", lambda r: r["text"] != "")), F.expr(f"CAST(array() AS {_EVIDENCE})")).alias("evidence"), F.slice(aliases, 1, 6).alias("types"),
    )


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).json(path, multiLine=True).withColumn("seq", F.monotonically_increasing_id())


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTING_SCHEMA).json(path, multiLine=True).withColumn("seq", F.monotonically_increasing_id())


# ---------------------------------------------------------------- cache, order, runs


def cache_key(key: Column) -> Column:
    return F.substring(F.sha1(key), 1, 24)


def cache_lookup(cache: DataFrame, keys: DataFrame, now: Column, ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """keys(namespace, key) with `body` where the cache has a sound entry not older than the limit; a body that is no JSON is none."""
    fresh = cache.where((F.unix_timestamp(now) - F.unix_timestamp("fetched_at") <= ttl_s) & F.try_parse_json("body").isNotNull())
    return keys.withColumn("digest", cache_key(F.col("key"))).join(fresh.select("namespace", "digest", "body"), ["namespace", "digest"], "left")


@dataclass
class Fetched:
    places: DataFrame | None
    mode: str
    note: str = ""


@dataclass
class Source:
    """A feed: how to fetch it live, and a recorded fixture to fall back to when that cannot be done or fails."""

    name: str
    live: Callable[[], DataFrame] | None
    fixture: Callable[[], DataFrame]
    has_credentials: bool = True

    def fetch(self, force_fixture: bool = False) -> Fetched:
        if force_fixture:
            return Fetched(self.fixture(), "fixture", "forced")
        if self.live is None or not self.has_credentials:
            return Fetched(self.fixture(), "fixture", "no credentials")
        try:
            return Fetched(self.live(), "live")
        except Exception as e:  # noqa: BLE001  any failure of a feed falls back
            return Fetched(self.fixture(), "fixture", f"live fetch failed: {e}")


def union_sources(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds in the order in which they resolve, with source_rank."""
    out = None
    for rank, name in enumerate(C.SOURCES):
        if name in feeds:
            part = feeds[name].withColumn("source_rank", F.lit(rank))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out


def run_all(spark: SparkSession, sources: list[Source], city: str, started_at: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(feeds, runs): what each source gave, and an audit row for each; one that fails keeps no other from running."""
    feeds, rows = {}, []
    for s in sorted(sources, key=lambda s: C.SOURCES.index(s.name)):
        try:
            got = s.fetch()
            feeds[s.name] = got.places
            rows.append((s.name, city, got.mode, got.places.count(), got.note, None, started_at))
        except Exception as e:  # noqa: BLE001  reported in the audit row
            rows.append((s.name, city, "failed", 0, "", str(e)[:2000], started_at))
    return feeds, spark.createDataFrame(rows, "source string, city string, mode string, records_fetched long, note string, error string, started_at string")


def select_targets(targets: DataFrame, wanted: list[str], slug: str) -> DataFrame:
    """Registered pages that are wanted by id or end in the city's name."""
    return targets.where(F.col("target_id").isin(*wanted) | F.col("target_id").endswith(f"-{slug}"))


def cache_write(cache: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """cache(namespace, digest, fetched_at, body) with entries(namespace, key, body) in place of those of the same key; of repeated keys the largest body."""
    new = entries.withColumn("digest", cache_key(F.col("key"))).groupBy("namespace", "digest").agg(F.max("body").alias("body")).withColumn("fetched_at", now)
    return cache.join(new.select("namespace", "digest"), ["namespace", "digest"], "left_anti").unionByName(new)


def cache_entries(cache: DataFrame, namespace: str, now: Column, ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """(digest, fetched_at, fresh, n_chars) of a namespace's entries, the newest first."""
    fresh = (F.unix_timestamp(now) - F.unix_timestamp("fetched_at") <= ttl_s) & F.try_parse_json("body").isNotNull()
    return cache.where(F.col("namespace") == namespace).select("digest", "fetched_at", F.coalesce(fresh, F.lit(False)).alias("fresh"), F.length("body").alias("n_chars")).orderBy(F.desc("fetched_at"), "digest")


def absolute_url(href: Column, base: Column) -> Column:
    """A link made absolute."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.nullif(href, F.lit("")))


def robots_allow(robots: str | None, url: str, agent: str) -> bool:
    """Whether a robots file allows a page; one that could not be read allows all."""
    if robots is None:
        return True
    from urllib.robotparser import RobotFileParser

    parser = RobotFileParser()
    parser.parse(robots.splitlines())
    return parser.can_fetch(agent, url)
