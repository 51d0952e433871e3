"""Scoring queries: distributions, signals, composites, top lists, breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave import views as V
from placeweave.operators import scoring

ALL = (V.PLACES, V.SIGNALS, V.SCORES)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def source_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scoring.distributions(V.signals(spark, sf), V.places(spark, sf)), 6, "mean_rating", "sd_rating")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_signals(V.signals(spark, sf), V.places(spark, sf), F.lit(V.NOW).cast("timestamp"))


def signal_score(spark: SparkSession, sf: str) -> DataFrame:
    out = _rounded(_scored(spark, sf), 6, "quality", "weight", "volume", "recency", "z", "shrunk", "age")
    return out.select("place_id", "source", "kind", "quality", "weight", "credibility", "volume", "recency", "z", "shrunk", "age")


def composite_score(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scoring.composite(_scored(spark, sf)), 5, "raw_base", "evidence", "confidence", "base", "agreement", "bonus", "score")


def weight_share(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("place_id"))
    return _scored(spark, sf).select("place_id", "source", F.round(share, 6).alias("share"))


def score_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """The audit documents' numbers, read back from their JSON."""
    scored = _scored(spark, sf)
    found = scoring.breakdown(scored, scoring.composite(scored))
    d = lambda p: F.get_json_object("breakdown", p)
    return found.select("place_id", d("$.composite_score").cast("double").alias("composite_score"), d("$.source_count").cast("int").alias("source_count"), d("$.signals[0].source").alias("top_source"), d("$.model_version").alias("model_version"))


def places_scored(spark: SparkSession, sf: str) -> DataFrame:
    out = V.scored_places(spark, sf)
    return out.select("place_id", "city", F.round("score", 4).alias("score"), "source_count")


def top_places_corroborated(spark: SparkSession, sf: str) -> DataFrame:
    from placeweave.operators.browse import corroborated, ranked

    kept = corroborated(V.scored_places(spark, sf).where("city = 'city-1'"), V.signals(spark, sf), 3)
    return ranked(kept.withColumn("score", F.round("score", 4)), 50).select("place_id", "city", "score", "source_count", "rank")


QUERIES = {f.__name__: f for f in (source_distribution, signal_score, composite_score, weight_share, score_breakdown, places_scored, top_places_corroborated)}

ORACLE_SQL = {
    "source_distribution": V.with_views("SELECT city, source, round(mean_rating::DOUBLE, 6) AS mean_rating, round(sd_rating::DOUBLE, 6) AS sd_rating, n, measured FROM v_dist", *ALL),
    "signal_score": V.with_views("SELECT place_id, source, kind, round(quality, 6) AS quality, round(credibility * volume * recency, 6) AS weight, credibility, round(volume, 6) AS volume, round(recency, 6) AS recency, round(z, 6) AS z, round(shrunk, 6) AS shrunk, round(age, 6) AS age FROM v_scored", *ALL),
    "composite_score": V.with_views("SELECT place_id, round(raw_base, 5) AS raw_base, round(evidence, 5) AS evidence, round(confidence, 5) AS confidence, round(base, 5) AS base, round(agreement::DOUBLE, 5) AS agreement, round(bonus::DOUBLE, 5) AS bonus, round(score, 5) AS score, source_count FROM v_score", *ALL),
    "weight_share": V.with_views("SELECT place_id, source, round(credibility * volume * recency / sum(credibility * volume * recency) OVER (PARTITION BY place_id), 6) AS share FROM v_scored", *ALL),
    "score_breakdown": V.with_views(
        "SELECT s.place_id, round(score, 2) AS composite_score, CAST(source_count AS INTEGER) AS source_count, top_source, '1.0' AS model_version FROM v_score s JOIN (SELECT place_id, arg_max(source, credibility * volume * recency) AS top_source FROM v_scored GROUP BY place_id) t USING (place_id)", *ALL
    ),
    "places_scored": V.with_views("SELECT place_id, city, round(score, 4) AS score, source_count FROM v_full", *ALL),
    "top_places_corroborated": V.with_views(
        "SELECT place_id, city, score, source_count, CAST(row_number() OVER (ORDER BY score DESC, place_id) AS INTEGER) AS rank FROM (SELECT place_id, city, round(score, 4) AS score, source_count FROM v_full WHERE city = 'city-1' AND source_count >= 3) ORDER BY score DESC, place_id LIMIT 50", *ALL
    ),
}
