import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_commands(spark, tmp_path, capsys):
    from placeweave import cli
    from placeweave import views as V

    d = str(tmp_path)
    V.hours_of(V.places(spark, SF)).write.parquet(f"{d}/places")
    V.signals(spark, SF).write.parquet(f"{d}/signals")
    V.evidence(spark, SF).selectExpr("*", "0.1D AS sentiment").write.parquet(f"{d}/evidence")
    V.runs(spark, SF).selectExpr("*", "'city-1' AS city").write.parquet(f"{d}/runs")
    spark.createDataFrame([(1, 2, 0.7, False)], "left_id long, right_id long, confidence double, resolved boolean").write.parquet(f"{d}/reviews")
    for args in (["score", "--now", V.NOW], ["tag"], ["resolve"], ["status", "--city", "city-1"], ["review"], ["provenance", "--city", "city-1"], ["explain", "ring", "--city", "city-1", "--now", V.NOW], ["itinerary", "--city", "city-1", "--start", "2026-09-18", "--days", "2"]):
        cli.main(["--data", d, *args], spark)
    out = capsys.readouterr().out
    assert "canonical" in out and "conf=0.70" in out and "quality" in out and "Day 1 - 2026-09-18" in out and "  1. " in out
    assert spark.read.parquet(f"{d}/places_tagged").where("array_contains(tags, 'category:park')").count() > 0
    with pytest.raises(SystemExit):
        cli.main(["--data", d, "explain", "zzzz", "--city", "city-1"], spark)


def test_ingest_command(spark, tmp_path, capsys):
    """Feeds to places, twice: the second time all are known."""
    import json

    from placeweave import cli

    for name in ("google_places", "yelp", "reddit"):
        (tmp_path / "feeds" / name).mkdir(parents=True)
    at = {"latitude": 40.4, "longitude": -3.7}
    (tmp_path / "feeds/google_places/a.json").write_text(json.dumps({"places": [{"id": "a", "displayName": {"text": "Casa Dani"}, "location": at, "types": ["restaurant"], "rating": 4.5, "userRatingCount": 9, "editorialSummary": {"text": "Old house."}}]}))
    (tmp_path / "feeds/yelp/b.json").write_text(json.dumps({"businesses": [{"id": "b", "name": "Casa Dani", "coordinates": at, "price": "€€", "rating": 4.0, "review_count": 7, "url": "u"}]}))
    tree = {"data": {"children": [{"kind": "t1", "data": {"body": "go to Casa Dani, it is great.", "score": 9, "replies": ""}}]}}
    (tmp_path / "feeds/reddit/c.json").write_text(json.dumps([{"id": "t", "title": "where", "selftext": "", "score": 50, "subreddit": "m", "permalink": "/x", "created_utc": 5.0, "comments": tree}]))
    args = ["--data", str(tmp_path / "data"), "ingest", "--feeds", str(tmp_path / "feeds"), "--city", "Madrid", "--now", "2026-01-01 00:00:00"]
    cli.main(args, spark)
    cli.main(args, spark)
    out = capsys.readouterr().out
    assert "created 1, merged 0, updated 0" in out and "created 0, merged 1, updated 0" in out and out.count("created 0, merged 0, updated 1") == 3
    places = spark.read.parquet(str(tmp_path / "data/places")).collect()
    assert [(r["name"], r["price_tier"], r["city"]) for r in places] == [("Casa Dani", 2, "Madrid")]
    signals = {r["source"]: r for r in spark.read.parquet(str(tmp_path / "data/signals")).collect()}
    assert set(signals) == {"google_places", "yelp", "reddit"} and signals["reddit"]["sentiment"] > 0 and signals["reddit"]["merged_mentions"] == 1
    assert spark.read.parquet(str(tmp_path / "data/evidence")).count() == 2 and spark.read.parquet(str(tmp_path / "data/runs")).count() == 6
    for more in (["score", "--now", "2026-01-01 00:00:00"], ["documents"], ["health"]):
        cli.main(["--data", str(tmp_path / "data"), *more], spark)
    document = json.loads(spark.read.parquet(str(tmp_path / "data/place_documents")).first()["document"])
    assert document["source_count"] == 3 and document["composite_score"] > 0 and "ok" in capsys.readouterr().out
