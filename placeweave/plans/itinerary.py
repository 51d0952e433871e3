"""Itineraries: a candidate pool by DataFrame, then one request at a time in a grouped kernel."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.operators.browse import affordable, canonical, check_request, in_radius
from placeweave.plans.cluster import by_day, medoid
from placeweave.plans.kernel import Day, metres


@dataclass(frozen=True)
class Request:
    city: str
    start: dt.date
    days: int = 3
    pace: str = "moderate"
    tags: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    max_price_tier: int = 4
    centre: tuple[float, float] | None = None
    radius_m: float | None = None
    mode: str = "walk"

    def __post_init__(self) -> None:
        check_request(days=self.days, max_price_tier=self.max_price_tier, radius_m=self.radius_m)
        if self.pace not in C.PACES:
            raise ValueError(f"unknown pace {self.pace}")

    @property
    def pool(self) -> int:
        return max(C.POOL_MIN, self.days * C.PACES[self.pace]["stops"] * C.POOL_OVERSAMPLE)


def candidates(places: DataFrame, r: Request) -> DataFrame:
    """The best scored places of a request, at most r.pool, with `boosted` (score raised by wanted tags) and `rank` by it.

    The pool is cut by plain score: wanted tags reorder it and bring nothing in.
    """
    out = canonical(places, r.city).where(F.col("score").isNotNull() & ~F.col("category").isin(*C.LODGING))
    if r.max_price_tier < 4:
        out = out.where(affordable(r.max_price_tier))
    if r.avoid:
        out = out.where(~F.arrays_overlap("tags", F.array(*map(F.lit, r.avoid))))
    if r.centre and r.radius_m:
        out = in_radius(out, r.centre, r.radius_m).drop("distance_m")
    pool = out.orderBy(F.desc("score"), "place_id").limit(r.pool)
    wanted = {t.lower() for t in r.tags}
    share = F.size(F.filter("tags", lambda t: F.lower(t).isin(*wanted))) / float(len(wanted)) if wanted else F.lit(0.0)
    boosted = pool.withColumn("boosted", F.col("score") * (1.0 + C.TAG_BOOST * share))
    return boosted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("boosted"), "place_id")))  # a pool's rows


def meal_quota(ordered: list[dict], size: int, meals: int) -> list[dict]:
    """The first `size` stops, the weakest others replaced by the next best meals until there are `meals`."""
    head = ordered[:size]
    missing = meals - sum(s["category"] in C.MEALS for s in head)
    more = [s for s in ordered[size:] if s["category"] in C.MEALS][: max(0, missing)]
    for _ in more:
        weakest = next((i for i in range(len(head) - 1, -1, -1) if head[i]["category"] not in C.MEALS), None)
        if weakest is not None:
            head.pop(weakest)
    return head + more


def build(stops: list[dict], r: Request) -> tuple[list[list], list[tuple[dict, str]]]:
    """(visits of each day, stops without a day and why) of a pool by falling rank_score."""
    pace = C.PACES[r.pace]
    capacity = max(pace["stops"] + 2, -(-len(stops) // r.days))
    groups = sorted(by_day(stops, r.days, capacity), key=lambda g: -sum(s["rank_score"] for s in g))
    size = pace["stops"] * C.SHORTLIST_MULTIPLE + 2
    days, unused, carried = [], [], []
    for i, group in enumerate(groups):
        anchor = medoid(group)
        near = lambda s, a=anchor: -(s["rank_score"] - C.COMPACTNESS_PER_KM * metres(s, a) / 1000.0)
        short = meal_quota(sorted(group, key=near), size, pace["meals"])
        keys = {s["key"] for s in short}
        unused += [(s, "outranked by stronger places in the same area") for s in group if s["key"] not in keys]
        offered, carried = short + carried, []
        date = r.start + dt.timedelta(days=i)
        visits, dropped = Day(offered, date.weekday(), pace["start"] * 60, pace["end"] * 60, r.mode).plan(pace["stops"]) if offered else ([], [])
        days.append(visits)
        placed = {v.stop["key"] for v in visits}
        for at, reason in dropped:
            if offered[at]["key"] in placed:
                continue
            if i + 1 < r.days and "closed" in reason:
                carried.append(offered[at])
            else:
                unused.append((offered[at], reason))
    return days, unused + [(s, "no remaining day could accommodate it") for s in carried]


SCHEMA = "request string, day int, position int, place_id long, arrival int, start int, end int, travel_s double, wait int, free int, assumed boolean, reason string"


def itineraries(places: DataFrame, requests: dict[str, Request]) -> DataFrame:
    """The plans of several requests: a row a visit (day and position from 1), and a row without day for what is left, with its reason.

    Pools are cut by Spark; each request's pool, of bounded size, is planned in one group, so requests run side by side.
    """
    pools = None
    for name, r in requests.items():
        pool = candidates(places, r).select(F.lit(name).alias("request"), "place_id", "name", "lat", "lng", "category", "score", "boosted", "rank", F.to_json("hours").alias("hours"))
        pools = pool if pools is None else pools.unionByName(pool)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        import json

        name = df["request"].iloc[0]
        stops = [{"key": int(x.place_id), "name": x.name, "lat": x.lat, "lng": x.lng, "category": x.category, "score": x.score, "rank_score": x.boosted, "hours": json.loads(x.hours) if x.hours else None} for x in df.sort_values("rank").itertuples(index=False)]
        days, unused = build(stops, requests[name])
        out = [(name, d, p, v.stop["key"], v.arrival, v.start, v.end, v.travel_s, v.wait, v.free, v.assumed, None) for d, visits in enumerate(days, 1) for p, v in enumerate(visits, 1)]
        out += [(name, None, None, s["key"], None, None, None, None, None, None, None, why) for s, why in unused]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return pools.groupBy("request").applyInPandas(run, SCHEMA)


def totals(plan: DataFrame) -> DataFrame:
    """(request, day, stops, travel_s, dwell, wait, free) by day, and for the trip with day null."""
    visits = plan.where(F.col("day").isNotNull())
    sums = [F.count("*").alias("stops"), F.sum("travel_s").alias("travel_s"), F.sum(F.col("end") - F.col("start")).alias("dwell"), F.sum("wait").alias("wait"), F.sum("free").alias("free")]
    return visits.groupingSets([["request", "day"], ["request"]], "request", "day").agg(*sums)
