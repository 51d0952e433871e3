"""Places are never broadcast, whatever their file's size, and what is settled in rounds or pruned is what a loop finds."""

import random

import pytest

from placeweave.operators import resolve
from placeweave.queries import planning
from tests.test_operators import make_records, metres

SF = "/root/testdata/sf0.001"
PLACE = "place_id long, name string, city string, lat double, lng double"


@pytest.mark.parametrize("name", ["near_pairs", "pair_decision", "review_queue", "decision_counters"])
def test_places_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in planning.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_medoid_sums_few_places(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "n", "m", 40 + rng.gauss(0, 0.01), rng.gauss(0, 0.01), "cafe") for i in range(600)]
    monkeypatch.setattr(planning.V, "places", lambda *_: spark.createDataFrame(rows, PLACE + ", category string"))
    out = planning.cluster_medoid(spark, SF, blocks=4)
    got = out.first()
    expected = min((round(sum(metres(a, b) for b in rows), 3), a[0]) for a in rows)
    assert got["place_id"] == expected[1] and got["total_m"] == pytest.approx(expected[0], abs=0.01)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastNestedLoop" not in plan


def test_block_pairs_are_not_shuffled(spark):
    plan = planning.block_pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Union")[0]
    assert "Exchange" not in top and "Aggregate" not in top


def test_block_pairs_of_repeated_ids(spark):
    rows = [(*r[:2], "m", *r[3:]) for r in make_records(30, 5)]
    df = spark.createDataFrame(rows + rows[:5], PLACE)
    got = [tuple(r) for r in resolve.block_pairs(df).collect()]
    once = {tuple(r) for r in resolve.block_pairs(spark.createDataFrame(rows, PLACE)).collect()}
    assert len(got) == len(set(got)) and set(got) == once


@pytest.mark.parametrize("one_task", [0, 30, 10_000])
def test_absorbed_as_in_a_loop(spark, one_task):
    rng = random.Random(6)
    edges = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(140)} | {(i, i + 1) for i in range(100, 150)}, key=lambda e: e[1])
    gone = set()
    for a, b in edges:
        if a not in gone:
            gone.add(b)
    found = resolve.absorbed(spark.createDataFrame(edges, "left_id long, right_id long"), one_task).collect()
    assert sorted(r["place_id"] for r in found) == sorted(gone)
