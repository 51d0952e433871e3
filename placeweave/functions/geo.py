"""Distances and travel times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import config as C


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres on a sphere."""
    half = lambda d: F.sin(F.radians(d) / 2)
    a = F.pow(half(lat2 - lat1), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lng2 - lng1), F.lit(2.0))
    return F.lit(2 * C.EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def within_box(lat: Column, lng: Column, centre: tuple[float, float], radius_m: float) -> Column:
    """A bounding box around a circle: plain comparisons, which reach the Parquet scan."""
    import math

    d_lat = math.degrees(radius_m / C.EARTH_RADIUS_M) * 1.0001
    d_lng = d_lat / max(0.01, math.cos(math.radians(abs(centre[0]) + d_lat)))
    return lat.between(centre[0] - d_lat, centre[0] + d_lat) & lng.between(centre[1] - d_lng, centre[1] + d_lng)


def proximity(distance_m: Column) -> Column:
    """1 at distance 0, one half at PROXIMITY_HALF_M."""
    r = distance_m / C.PROXIMITY_HALF_M
    return F.when(distance_m <= 0, 1.0).otherwise(1.0 / (1.0 + r * r))


def merge_confidence(similarity: Column, distance_m: Column, anchored: Column) -> Column:
    score = 0.55 * similarity + 0.45 * proximity(distance_m) + F.when(anchored, 0.05).otherwise(0.0)
    return F.when(distance_m > C.MERGE_RADIUS_M, 0.0).otherwise(F.least(F.lit(1.0), score))


def merge_rule(similarity: Column, distance_m: Column, anchored: Column) -> Column:
    """1-based number of the first merge rule that a pair satisfies; null for none."""
    out = None
    for i, (most, least, needs_anchor, _) in enumerate(C.MERGE_RULES, 1):
        holds = (distance_m <= most) & (similarity >= least)
        holds = holds & anchored if needs_anchor else holds
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return out


def travel_seconds(metres: Column, mode: str = "walk") -> Column:
    """Door-to-door seconds over a straight-line distance."""
    street = metres * C.DETOUR
    seconds = street / C.SPEED_MPS[mode]
    return seconds + F.when(street > C.TRANSIT_FROM_M, C.TRANSIT_OVERHEAD_S).otherwise(0.0) if mode == "transit" else seconds


def projected(lat: Column, lng: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin (equirectangular)."""
    return F.radians(lng - lng0) * C.EARTH_RADIUS_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * C.EARTH_RADIUS_M
