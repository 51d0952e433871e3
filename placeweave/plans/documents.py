"""JSON documents of places and itineraries, as an API returns them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.functions.hours import clock
from placeweave.plans.itinerary import Request

_EXTRA = ("sentiment", "upvotes", "mention_count", "thread_score", "thread_count", "subreddits", "merged_mentions")
#: Stops without a day that a document lists.
LISTED = 40


def place_documents(places: DataFrame, signals: DataFrame) -> DataFrame:
    """(place_id, document): a place with its signals nested, what sources add to them under `extra`; nulls are kept as fields."""
    extra = F.struct(*(c for c in _EXTRA if c in signals.columns)) if set(_EXTRA) & set(signals.columns) else F.create_map()
    items = [c for c in ("source", "rating", "review_count", "url") if c in signals.columns]
    nested = signals.groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct(*items, F.to_json(extra).alias("extra"), F.col("observed_at").alias("last_updated")))).alias("s"))
    held = places.join(nested, "place_id", "left")
    signal = lambda s: F.struct(*(s[c].alias(c) for c in items), F.from_json(s["extra"], "map<string,string>").alias("extra"), s["last_updated"].alias("last_updated"))
    listed = F.when(F.col("s").isNotNull(), F.transform("s", signal)).otherwise(F.filter(F.transform(F.array_repeat(F.element_at("s", 1), 0), signal), lambda x: F.lit(False)))
    known = [c for c in ("name", "city", "lat", "lng", "category", "price_tier", "tags", "hours", "address", "neighborhood") if c in places.columns]
    count = F.coalesce(F.size(F.array_distinct("s.source")), F.lit(0))
    document = F.struct(F.col("place_id").cast("string").alias("id"), *known, F.col("score").alias("composite_score"), listed.alias("source_signals"), F.greatest(F.lit(0), count).alias("source_count"))
    return held.select("place_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def itinerary_documents(plan: DataFrame, places: DataFrame, requests: dict[str, Request], provider: str = "haversine") -> DataFrame:
    """(request, document) of plans: days with their stops and totals, and the first LISTED places without a day, by place_id.

    A request's plan has a bounded number of rows. Days without a stop are left out.
    """
    rounded = lambda c: F.round(c / 60.0, 1)
    r = plan.join(places.select("place_id", "name", "lat", "lng", "category", "price_tier", "tags", "score"), "place_id")
    stop = F.struct(
        "position", F.col("place_id").cast("string").alias("place_id"), "name", "lat", "lng", "category", "price_tier", "tags", F.col("score").alias("composite_score"), clock(F.col("start")).alias("start_time"), clock(F.col("end")).alias("end_time"),
        (F.col("end") >= 1440).alias("crosses_midnight"), rounded(F.col("travel_s")).alias("travel_minutes_from_previous"), F.col("wait").alias("wait_minutes"), F.col("free").alias("free_minutes"), F.col("assumed").alias("hours_assumed"),
    )
    days = r.where(F.col("day").isNotNull()).groupBy("request", "day").agg(F.array_sort(F.collect_list(stop)).alias("stops"), F.sum("travel_s").alias("t"), F.sum(F.col("end") - F.col("start")).alias("dwell"), F.sum("free").alias("free"))
    starts = F.create_map(*(x for name, q in requests.items() for x in (F.lit(name), F.lit(q.start))))
    date = F.date_add(F.element_at(starts, F.col("request")), F.col("day") - 1)
    day = F.struct(F.col("day").alias("day_index"), date.alias("date"), F.date_format(date, "EEEE").alias("weekday"), rounded(F.col("t")).alias("travel_minutes"), F.col("dwell").alias("dwell_minutes"), F.col("free").alias("free_minutes"), "stops")
    trips = days.groupBy("request").agg(F.array_sort(F.collect_list(day)).alias("days"), F.sum(F.size("stops")).alias("n"), F.sum("t").alias("t"))
    left = r.where(F.col("day").isNull()).groupBy("request").agg(F.slice(F.array_sort(F.collect_list(F.struct("place_id", "name", "reason"))), 1, LISTED).alias("left"), F.count("*").alias("n_left"))
    asked = plan.sparkSession.createDataFrame([(n, q.city, q.start, q.pace, q.mode, list(q.tags), q.max_price_tier) for n, q in requests.items()], "request string, city string, start_date date, pace string, travel_mode string, requested_tags array<string>, max_price_tier int")
    held = asked.join(trips, "request", "left").join(left, "request", "left")
    n = F.coalesce("n", F.lit(0))
    document = F.struct(
        "city", "start_date", "pace", "travel_mode", F.lit(provider).alias("routing_provider"), (n + F.coalesce("n_left", F.lit(0))).alias("pool_size"), "requested_tags", "max_price_tier", n.alias("total_stops"),
        F.coalesce(rounded(F.col("t")), F.lit(0.0)).alias("total_travel_minutes"), "days", F.transform("left", lambda x: F.struct(x["name"].alias("name"), x["reason"].alias("reason"))).alias("not_scheduled"),
    )
    return held.select("request", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
