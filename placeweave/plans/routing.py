"""Travel times from routing services: their answers parsed, gaps estimated, matrices remembered. Nothing here needs a network.

A service is given as a function that fetches a request's answer, so a caller brings its own client, or a recorded answer.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.functions import geo
from placeweave.plans.kernel import seconds, travel_matrix

# Points of a street service's table at most, its public hosts (which know cars only), and the map service's modes.
STREET_POINTS = 90
PUBLIC_HOSTS = ("router.project-osrm.org",)
MODES = {"walk": "WALK", "transit": "TRANSIT", "drive": "DRIVE"}

Point = dict
Matrix = list[list[float]]


class Provider(Protocol):
    name: str

    def matrix(self, points: list[Point]) -> Matrix:
        """Seconds between all points(lat, lng); 0 on the diagonal."""
        ...


def ridden(metres: float, mode: str) -> float:
    """Seconds for metres of street."""
    return metres / C.SPEED_MPS[mode] + (C.TRANSIT_OVERHEAD_S if mode == "transit" and metres > C.TRANSIT_FROM_M else 0.0)


def leg_seconds(mode: str = "walk") -> Column:
    """Seconds of legs(lat1, lng1, lat2, lng2, metres) as a column: by a service's metres, or estimated where it has none."""
    m = F.coalesce("metres", geo.haversine_m(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")) * C.DETOUR)
    return m / C.SPEED_MPS[mode] + F.when(m > C.TRANSIT_FROM_M, float(C.TRANSIT_OVERHEAD_S)).otherwise(0.0) if mode == "transit" else m / C.SPEED_MPS[mode]


@dataclass
class Estimate:
    mode: str = "walk"
    name: str = "haversine"

    def matrix(self, points: list[Point]) -> Matrix:
        return travel_matrix(points, self.mode)


def parse_street_table(answer: str, points: list[Point], mode: str, trust_durations: bool) -> Matrix:
    """Seconds from a street service's table: its durations if they are trusted, else its distances at our speed; legs without a route are estimated.

    ValueError if the answer is no table.
    """
    found = json.loads(answer)
    if not isinstance(found, dict) or found.get("code") != "Ok":
        raise ValueError("no table")
    if trust_durations and found.get("durations"):
        return [[float(x or 0.0) for x in row] for row in found["durations"]]
    if not found.get("distances"):
        raise ValueError("no distances")
    cell = lambda i, j, m: 0.0 if i == j else seconds(points[i], points[j], mode) if m is None else ridden(float(m), mode)
    return [[cell(i, j, m) for j, m in enumerate(row)] for i, row in enumerate(found["distances"])]


def parse_route_elements(answer: str, points: list[Point], mode: str) -> Matrix:
    """Seconds from a map service's list of elements; durations are like 123s, unreadable ones are estimated, missing ones are 0."""
    out = [[0.0] * len(points) for _ in points]
    for e in json.loads(answer):
        i, j = e.get("originIndex"), e.get("destinationIndex")
        if i is None or j is None or i == j:
            continue
        try:
            out[i][j] = float(str(e.get("duration") or "0s").rstrip("s"))
        except ValueError:
            out[i][j] = seconds(points[i], points[j], mode)
    return out


@dataclass
class StreetTable:
    """fetch(path, parameters) gives the answer's text and may fail; then, and beyond STREET_POINTS, times are estimated."""

    fetch: Callable[[str, dict], str]
    mode: str = "walk"
    profile: str = "foot"
    trust_durations: bool = False
    name: str = "osrm"

    def matrix(self, points: list[Point]) -> Matrix:
        if len(points) < 2 or len(points) > STREET_POINTS:
            return travel_matrix(points, self.mode)
        path = f"/table/v1/{self.profile}/" + ";".join(f"{p['lng']},{p['lat']}" for p in points)
        try:
            return parse_street_table(self.fetch(path, {"annotations": "duration,distance" if self.trust_durations else "distance"}), points, self.mode, self.trust_durations)
        except (OSError, ValueError, KeyError, TypeError):
            return travel_matrix(points, self.mode)


@dataclass
class RouteMatrix:
    """fetch(body) gives the answer's text and may fail; then times are estimated."""

    fetch: Callable[[dict], str]
    mode: str = "walk"
    name: str = "google_directions"

    def matrix(self, points: list[Point]) -> Matrix:
        if len(points) < 2:
            return travel_matrix(points, self.mode)
        ends = [{"waypoint": {"location": {"latLng": {"latitude": p["lat"], "longitude": p["lng"]}}}} for p in points]
        try:
            return parse_route_elements(self.fetch({"origins": ends, "destinations": ends, "travelMode": MODES[self.mode]}), points, self.mode)
        except (OSError, ValueError, AttributeError):
            return travel_matrix(points, self.mode)


@dataclass
class Remembered:
    """Matrices by their points' coordinates to six digits."""

    inner: Provider
    hits: int = 0
    misses: int = 0
    known: dict[tuple, Matrix] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"cached:{self.inner.name}"

    def matrix(self, points: list[Point]) -> Matrix:
        key = tuple((round(p["lat"], 6), round(p["lng"], 6)) for p in points)
        if key in self.known:
            self.hits += 1
        else:
            self.misses += 1
            self.known[key] = self.inner.matrix(points)
        return self.known[key]


def provider(choice: str = "haversine", mode: str = "walk", *, street: Callable[[str, dict], str] | None = None, street_url: str = "", allow_public: bool = False, routes: Callable[[dict], str] | None = None) -> Remembered:
    """The provider of a configuration, remembered; one that isn't set up is the estimate. Public street hosts know cars only and are used only if allowed."""
    choice = (choice or "haversine").strip().lower()
    public = any(h in street_url for h in PUBLIC_HOSTS)
    if choice == "google" and routes is not None:
        return Remembered(RouteMatrix(routes, mode))
    if choice == "osrm" and street is not None and (allow_public or not public):
        return Remembered(StreetTable(street, mode, trust_durations=not public))
    return Remembered(Estimate(mode))
