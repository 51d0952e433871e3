import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeweave import config as C
from placeweave.plans import cluster, kernel
from placeweave.plans.itinerary import Request, build, meal_quota


def stop(i, category, lat=40.41, lng=-3.70, score=60.0, hours=None):
    return {"key": i, "name": f"s{i}", "lat": lat, "lng": lng, "category": category, "score": score, "rank_score": score, "hours": hours}


def week(o, c, closed=()):
    return {d: [] if d in closed else [{"open": o, "close": c}] for d in C.DAYS}


STOPS = [
    stop(0, "nightlife", 40.4140, -3.7010, 70, week("23:30", "05:30")),
    stop(1, "museum", 40.4138, -3.6921, 80, week("10:00", "20:00", ("mon",))),
    stop(2, "restaurant", 40.4153, -3.7080, 75, {d: [{"open": "13:00", "close": "16:00"}, {"open": "20:00", "close": "23:30"}] for d in C.DAYS}),
    stop(3, "restaurant", 40.4125, -3.6990, 72, {d: [{"open": "13:00", "close": "16:00"}, {"open": "20:00", "close": "23:30"}] for d in C.DAYS}),
    stop(4, "park", 40.4152, -3.6844, 78, None),
]


def check(visits, day):
    previous = None
    for v in visits:
        assert v.arrival <= v.start < v.end <= day.end and v.wait <= 60 and (v.free == 0 or v.wait == 0)
        i = day.stops.index(v.stop)
        windows = day.windows[i][0]
        assert windows is None or any(o <= v.start and v.end <= c for o, c in windows)
        if previous:
            assert previous.end <= v.start and v.travel_s <= day.most * 60
        previous = v
    for kind, limit in C.DAILY_LIMIT.items():
        assert sum(v.stop["category"] == kind for v in visits) <= limit
    for kind, gap in C.CATEGORY_GAP.items():
        starts = [v.start for v in visits if v.stop["category"] == kind]
        assert all(b - a >= gap for a, b in zip(starts, starts[1:], strict=False))


def test_friday_and_monday():
    friday = kernel.Day(STOPS, 4, 9 * 60, 26 * 60)
    visits, _ = friday.plan(8)
    check(visits, friday)
    kinds = [v.stop["category"] for v in visits]
    assert kinds.count("restaurant") == 2 and all(v.start >= 23 * 60 + 30 for v in visits if v.stop["category"] == "nightlife")
    monday = kernel.Day(STOPS, 0, 9 * 60, 23 * 60)
    visits, dropped = monday.plan(8)
    check(visits, monday)
    assert "museum" not in [v.stop["category"] for v in visits] and any(monday.stops[i]["key"] == 1 for i, _ in dropped)


def test_reasons_of_an_impossible_day():
    day = kernel.Day([stop(0, "museum", hours=week("10:00", "11:00"))], 1, 540, 1380)
    assert day.plan(4) == ([], [(0, "open window too short for a 105-minute visit at 10:00")])


def test_close_stops_are_not_both_visited():
    day = kernel.Day([stop(0, "attraction"), stop(1, "park", lat=40.4105)], 2, 540, 1380)
    visits, dropped = day.plan(4)
    assert len(visits) == 1 and [r for _, r in dropped] == ["not selected for this day"]


def test_two_opt_and_starts():
    rng = random.Random(1)
    points = [(rng.random(), rng.random()) for _ in range(9)]
    m = [[((a - c) ** 2 + (b - d) ** 2) ** 0.5 for c, d in points] for a, b in points]
    first = kernel.nearest_neighbour(m, 0)
    better = kernel.two_opt(first, m)
    assert sorted(better) == list(range(9)) and better[0] == 0 and kernel.tour_cost(better, m) <= kernel.tour_cost(first, m)
    assert kernel.tour_cost(kernel.optimize_order(m), m) <= kernel.tour_cost(better, m)
    assert kernel.two_opt([2, 1, 0], m) == [2, 1, 0] and kernel.optimize_order([]) == [] and kernel.optimize_order([[0]]) == [0]
    assert sorted(kernel.optimize_order(m, feasible=lambda o: False)) == list(range(9))


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 5), st.integers(0, 60), st.integers(0, 10**6))
def test_groups_partition_the_points(days, n, seed):
    rng = random.Random(seed)
    points = [stop(i, "park", 40.4 + rng.random() / 50, -3.7 + rng.random() / 50, rng.random() * 100) for i in range(n)]
    capacity = max(6, -(-n // days))
    groups = cluster.by_day(points, days, capacity)
    assert len(groups) == days and all(len(g) <= capacity for g in groups)
    keys = [p["key"] for g in groups for p in g]
    assert len(keys) == len(set(keys)) and (days == 1 or len(keys) == n)
    assert groups == cluster.by_day(points, days, capacity)


@settings(max_examples=15, deadline=None)
@given(st.sampled_from(sorted(C.PACES)), st.integers(1, 4), st.integers(0, 10**6))
def test_plans_are_valid(pace, days, seed):
    rng = random.Random(seed)
    hours = [None, week("10:00", "20:00", ("mon",)), week("18:00", "02:00"), {}]
    stops = [stop(i, rng.choice([c for c in C.CATEGORIES if c != "hotel"]), 40.4 + rng.random() / 40, -3.7 + rng.random() / 40, rng.random() * 100, rng.choice(hours)) for i in range(40)]
    r = Request("m", dt.date(2026, 9, 18), days=days, pace=pace)
    plans, unused = build(stops, r)
    assert len(plans) == days
    placed = [v.stop["key"] for p in plans for v in p]
    assert len(placed) == len(set(placed)) and not set(placed) & {s["key"] for s, _ in unused}
    if days > 1:
        assert set(placed) | {s["key"] for s, _ in unused} == set(range(40))
    for i, p in enumerate(plans):
        w = C.PACES[pace]
        check(p, kernel.Day([v.stop for v in p], (r.start + dt.timedelta(days=i)).weekday(), w["start"] * 60, w["end"] * 60))


def test_meal_quota():
    stops = [stop(i, "park") for i in range(4)] + [stop(9, "restaurant"), stop(10, "restaurant")]
    assert [s["key"] for s in meal_quota(stops, 3, 2)] == [0, 9, 10]
    assert [s["key"] for s in meal_quota(stops, 3, 0)] == [0, 1, 2]


def test_bad_requests():
    with pytest.raises(ValueError):
        Request("m", dt.date(2026, 1, 1), days=0)
    with pytest.raises(ValueError):
        Request("m", dt.date(2026, 1, 1), pace="frantic")
