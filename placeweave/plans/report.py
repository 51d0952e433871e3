"""Text reports: score explanations, itineraries, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.functions.hours import clock, duration


def find_place(places: DataFrame, city: str, name: str, least: float = 0.3) -> DataFrame:
    """The place most like a name: the same key, the name inside its own, or enough shared trigrams."""
    key = T.name_key(F.lit(name))
    keyed = places.where(F.col("city") == city).withColumn("key", T.name_key(F.col("name")))
    found = keyed.withColumn("sim", T.jaccard(T.trigrams(F.col("key")), T.trigrams(key)))
    near = (F.col("key") == key) | F.lower("name").contains(name.lower()) | (F.col("sim") > least)
    return found.where(near).orderBy(F.desc("sim"), "place_id").limit(1)


def signal_lines(scored: DataFrame, total: Column) -> DataFrame:
    """scored with `line`: how much of a place's weight a signal has, and why."""
    line = F.format_string("%-15s quality %.3f   weight %.3f  (%.0f%% of total) = credibility %.2f x volume %.2f x recency %.2f", "source", "quality", "weight", 100 * F.col("weight") / total, "credibility", "volume", "recency")
    return scored.withColumn("line", line)


def itinerary_lines(plan: DataFrame, places: DataFrame) -> DataFrame:
    """(request, day, position, line) of visits."""
    visits = plan.where(F.col("day").isNotNull()).join(places.select("place_id", "name", "category", "price_tier", "score"), "place_id")
    free = F.when(F.col("free") > 0, F.concat(duration(F.col("free")), F.lit(" free, "))).when(F.col("travel_s") > 0, F.concat(duration(F.col("travel_s") / 60), F.lit(" travel, "))).otherwise("")
    late = F.when(F.col("end") >= 1440, "+1d ").otherwise(" ")
    tier = F.coalesce(F.repeat(F.lit("€"), F.col("price_tier")), F.lit("?"))
    line = F.concat(free, clock(F.col("start")), F.lit("-"), clock(F.col("end")), late, "name", F.lit(" · "), "category", F.lit(" · "), tier, F.lit(" · score "), F.round("score", 0).cast("int").cast("string"))
    return visits.select("request", "day", "position", line.alias("line"))


def unused_lines(plan: DataFrame, places: DataFrame, most: int = 8) -> list[str]:
    """The first stops without a day, by place_id, with their reasons, and how many more there are."""
    left = plan.where(F.col("day").isNull()).join(places.select("place_id", "name"), "place_id").select("place_id", "name", "reason")
    rows = left.orderBy("place_id").limit(most).collect()
    more = left.count() - len(rows)
    return [f"{r['name']} - {r['reason']}" for r in rows] + ([f"... and {more} more"] if more > 0 else [])


def breakdown_lines(composite: DataFrame) -> DataFrame:
    """(place_id, line): how a composite score comes about."""
    line = F.format_string("score %.1f of 100 = base %.4f (confidence %.4f in evidence %.4f) + bonus %.4f (agreement %.4f of %d sources)", "score", "base", "confidence", "evidence", "bonus", "agreement", "source_count")
    return composite.select("place_id", line.alias("line"))
