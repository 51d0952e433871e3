"""Queries over all places, without SQL, against plain loops; ids begin above the subsets of the queries with SQL."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.queries import planning
from tests.test_operators import metres

SF = "/root/testdata/sf0.001"


@pytest.fixture
def records(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(5000 + i, " ".join(rng.choice(["old", "small", "red", "ring", "bolt", "gear", "gizmo"]) for _ in range(rng.randint(1, 3))), f"city-{i % 2}", 40 + rng.uniform(0, 0.02), rng.uniform(0, 0.02), rng.choice(["cafe", "museum"])) for i in range(90)]
    df = spark.createDataFrame(rows, "place_id long, name string, city string, lat double, lng double, category string")
    monkeypatch.setattr(planning.V, "places", lambda *_: df)
    return rows


def test_block_pairs(spark, records):
    grams = {r[0]: {("  " + w + " ")[i : i + 3] for w in r[1].split() for i in range(len(w) + 1)} for r in records}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    expected = {(a[0], b[0]) for a in records for b in records if a[0] < b[0] and a[2] == b[2] and (metres(a, b) <= C.BLOCK_RADIUS_M or alike(a[0], b[0]) > 0.35)}
    got = [(r["left_id"], r["right_id"]) for r in planning.block_pairs(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_cluster_medoid(spark, records):
    groups = defaultdict(list)
    for r in records:
        groups[r[2], r[5]].append(r)
    expected = {k: min((round(sum(metres(a, b) for b in g), 3), a[0]) for a in g)[::-1] for k, g in groups.items()}
    got = {(r["city"], r["category"]): (r["place_id"], r["total_m"]) for r in planning.cluster_medoid(spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(got[k][1] == pytest.approx(v[1], abs=0.01) for k, v in expected.items())


def test_travel_matrix(spark, records, monkeypatch):
    monkeypatch.setattr(planning, "_pool", lambda *_: planning.V.places().where("city = 'city-1'"))
    pool = [r for r in records if r[2] == "city-1"]
    got = {(r["i"], r["j"]): r["seconds"] for r in planning.travel_matrix(spark, SF).collect()}
    street = lambda a, b: metres(a, b) * C.DETOUR
    seconds = lambda a, b: 0.0 if a is b else street(a, b) / C.SPEED_MPS["transit"] + (C.TRANSIT_OVERHEAD_S if street(a, b) > C.TRANSIT_FROM_M else 0)
    assert len(got) == len(pool) ** 2 and all(got[a[0], b[0]] == pytest.approx(seconds(a, b), abs=0.01) for a in pool for b in pool)


def test_name_only_resolution_over_all_places(spark, records, monkeypatch):
    mentions = spark.range(1, 31).select(F.col("id").alias("c_custkey"))
    monkeypatch.setattr(planning.V, "table", lambda *_: mentions)
    found = {r["mention_id"]: r["found"] for r in planning.name_only_resolution(spark, SF).collect()}
    here = lambda k: any(r[2] == f"city-{k % 5}" and sorted(r[1].split()) == ["ring", "small"] for r in records)
    assert len(found) == 30 and any(found.values()) and all(found[k] for k in found if k % 3 == 0 and here(k))
