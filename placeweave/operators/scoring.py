"""Scores of places from the signals of several sources, with every term kept.

signals(place_id, source, rating, review_count, observed_at, sentiment, upvotes, mention_count, thread_score): one row for a
place and source. A source's ratings are measured per city; a place's score is aggregated in one shuffle by place_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.functions import score as S


def distributions(signals: DataFrame, places: DataFrame) -> DataFrame:
    """(city, source, mean_rating, sd_rating, n, measured) of the ratings there are; a prior where fewer than MIN_SAMPLES are."""
    rated = signals.where(F.col("rating").isNotNull()).join(places.select("place_id", "city"), "place_id")
    found = rated.groupBy("city", "source").agg(F.avg("rating").alias("m"), F.stddev_samp("rating").alias("s"), F.count("*").alias("n"))
    measured = F.col("n") >= C.MIN_SAMPLES
    prior = lambda i: S.by_source({k: v[i] for k, v in C.FALLBACK_DISTRIBUTION.items()}, C.FALLBACK_UNKNOWN[i], F.col("source"))
    return found.select(
        "city",
        "source",
        F.when(measured, F.col("m")).otherwise(prior(0)).alias("mean_rating"),
        F.when(measured, F.col("s")).otherwise(prior(1)).alias("sd_rating"),
        "n",
        measured.alias("measured"),
    )


def score_signals(signals: DataFrame, places: DataFrame, now: Column, by_city: DataFrame | None = None) -> DataFrame:
    """signals with (city, quality, weight, credibility, volume, recency, age, shrunk, z).

    Rated sources are centred on their own distribution; mentions take damped sentiment; listings, and rated sources
    without a rating, count as listed, with the trust of a listing.
    """
    by_city = distributions(signals, places) if by_city is None else by_city
    # a row for each city and source
    joined = signals.join(places.select("place_id", "city"), "place_id").join(by_city.select("city", "source", "mean_rating", "sd_rating"), ["city", "source"], "left")
    source = F.col("source")
    mean = F.coalesce("mean_rating", S.by_source({k: v[0] for k, v in C.FALLBACK_DISTRIBUTION.items()}, C.FALLBACK_UNKNOWN[0], source))
    sd = F.greatest(F.lit(C.MIN_SD), F.coalesce("sd_rating", S.by_source({k: v[1] for k, v in C.FALLBACK_DISTRIBUTION.items()}, C.FALLBACK_UNKNOWN[1], source)))
    kind = F.when(source == "reddit", "mention").when((source == "blog") | F.col("rating").isNull(), "listed").otherwise("rated")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    mentions = F.when(zero("mention_count") != 0, zero("mention_count")).otherwise(zero("review_count"))
    evidence = F.log1p(F.greatest(F.lit(0.0), zero("upvotes"))) + mentions
    trusted = evidence / (evidence + C.MENTION_EVIDENCE_HALF)
    visible = zero("thread_score") / (zero("thread_score") + C.THREAD_SCORE_HALF)
    out = joined.withColumns({"kind": kind, "age": S.age_days(F.col("observed_at"), now), "shrunk": F.when(kind == "rated", S.shrunk_rating(F.col("rating"), F.col("review_count"), mean))})
    out = out.withColumns(
        {
            "z": (F.col("shrunk") - mean) / sd,
            "credibility": F.when(F.col("kind") == "listed", C.CREDIBILITY["blog"]).otherwise(S.by_source(C.CREDIBILITY, C.CREDIBILITY_UNKNOWN, source)),
            "volume": F.when(F.col("kind") == "mention", C.MENTION_SHARE * trusted + C.THREAD_SHARE * visible).when(F.col("kind") == "listed", C.VOLUME_UNKNOWN).otherwise(S.volume_weight(F.col("review_count"))),
            "recency": S.recency_weight(F.col("age")),
        }
    )
    mention_quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.5 * zero("sentiment") * trusted))
    quality = F.when(F.col("kind") == "mention", mention_quality).when(F.col("kind") == "listed", C.LISTED_QUALITY).otherwise(S.sigmoid(F.col("z") * C.Z_SLOPE))
    return out.withColumns({"quality": quality, "weight": F.col("credibility") * F.col("volume") * F.col("recency")}).drop("mean_rating", "sd_rating")


def composite(scored: DataFrame) -> DataFrame:
    """(place_id, raw_base, evidence, confidence, base, agreement, bonus, score, source_count) of places with signals."""
    q, w = F.col("quality"), F.col("weight")
    sums = scored.groupBy("place_id").agg(F.sum(w).alias("evidence"), F.sum(q * w).alias("qw"), F.sum(q * q * w).alias("qqw"), F.avg(q).alias("plain"), F.countDistinct("source").alias("source_count"))
    has = F.col("evidence") > 0
    mean = F.col("qw") / F.col("evidence")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("qqw") / F.col("evidence") - mean * mean))
    several = (F.col("source_count") >= 2) & has
    out = sums.withColumns({"raw_base": F.when(has, mean).otherwise(F.col("plain")), "confidence": F.col("evidence") / (F.col("evidence") + C.EVIDENCE_HALF), "agreement": F.when(several, F.greatest(F.lit(0.0), 1.0 - spread / C.DISAGREEMENT_MAX)).otherwise(1.0)})
    out = out.withColumns({"base": C.NEUTRAL + (F.col("raw_base") - C.NEUTRAL) * F.col("confidence"), "bonus": F.when(several, C.BONUS_MAX * (1.0 - 1.0 / F.col("source_count")) * F.col("agreement")).otherwise(0.0)})
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("base") + F.col("bonus"))) * C.SCALE
    return out.select("place_id", "raw_base", "evidence", "confidence", "base", "agreement", "bonus", score.alias("score"), "source_count")


def rescore(places: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """Every place with its score and terms; a place without signals scores 0 with agreement 1."""
    found = composite(score_signals(signals, places, now))
    zero = {c: F.coalesce(c, F.lit(0.0)).alias(c) for c in ("raw_base", "evidence", "confidence", "base", "bonus", "score")}
    return places.join(found, "place_id", "left").select(*places.columns, *zero.values(), F.coalesce("agreement", F.lit(1.0)).alias("agreement"), F.coalesce("source_count", F.lit(0)).cast("long").alias("source_count"))


def breakdown(scored: DataFrame, composites: DataFrame) -> DataFrame:
    """(place_id, breakdown): the audit document of each place, rounded for display, signals by falling weight."""
    r = lambda c, d: F.round(c, d).alias(c)
    parts = F.struct(r("credibility", 4), r("volume", 4), r("recency", 4)).alias("weight_components")
    signal = F.struct((-F.col("weight")).alias("order"), "source", r("quality", 4), r("weight", 4), parts, "rating", F.round("shrunk", 3).alias("shrunk_rating"), F.round("z", 3).alias("z_score"), "review_count", F.round("age", 1).alias("age_days"))
    signals = scored.groupBy("place_id").agg(F.array_sort(F.collect_list(signal)).alias("signals"))
    kept = F.transform("signals", lambda s: s.dropFields("order")).alias("signals")
    document = F.struct(F.round("score", 2).alias("composite_score"), r("raw_base", 4), r("evidence", 4), F.round("confidence", 4).alias("evidence_confidence"), r("base", 4), F.round("bonus", 4).alias("corroboration_bonus"), r("agreement", 4), "source_count", kept, F.lit(C.MODEL_VERSION).alias("model_version"))
    return composites.join(signals, "place_id").select("place_id", F.to_json(document).alias("breakdown"))
