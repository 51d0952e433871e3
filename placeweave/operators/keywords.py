"""TF-IDF keywords of places."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.operators.tagging import RULES

PREFIX = "topic:"
MAX_KEYWORDS, MIN_WEIGHT, MAX_SHARE, MIN_PLACES, MIN_DOCUMENTS = 4, 0.20, 0.5, 2, 3

# Words too common in texts about places.
PLACE_STOPS = (
    "madrid", "spain", "spanish", "place", "places", "really", "very", "just", "good", "great", "nice", "best", "better", "worth", "like", "want", "know",
    "think", "going", "went", "come", "came", "make", "made", "thing", "things", "time", "times", "people", "definitely", "honestly", "actually", "probably",
    "maybe", "food", "drink", "drinks", "eat", "dinner", "lunch", "breakfast", "restaurant", "restaurants", "bar", "bars", "cafe", "coffee", "menu", "service",
    "staff", "area", "night", "day", "days", "week", "weekend", "morning", "hour", "hours", "euros", "euro", "price", "prices", "expensive", "cheap", "works",
    "work", "open", "opens", "right", "real", "visit", "visited", "ticket", "tickets", "entry", "plate", "seating", "minutes", "getting", "looking", "trying",
    "recommend", "recommended",
)


def rule_words() -> set[str]:
    """Words of the tag rules, which keywords must not repeat."""
    out: set[str] = set()
    for r in RULES:
        out |= {r.tag, *r.tag.split("-")}
        for p in r.include + r.exclude:
            out.update(re.findall(r"[\w']+", p.lower()))
    return out


def stop_words(english: tuple[str, ...] = ()) -> set[str]:
    """Stop words; the general English list is passed in."""
    return {*english, *PLACE_STOPS, *rule_words()}


def weights(texts: DataFrame, stops: set[str] = frozenset()) -> DataFrame:
    """(place_id, term, weight): 1 + ln(tf) times ln((1 + N) / (1 + df)) + 1, scaled to unit length for each place.

    texts(place_id, text) has any number of rows a place. Terms of fewer than MIN_PLACES or more than MAX_SHARE of the
    places drop out before the scaling. Terms are counted per place with partial aggregation; document frequency is a count
    of these counts.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_][\p{L}\p{N}_'\-]*[\p{L}\p{N}_])"), F.lit(1))
    terms = texts.where(F.trim("text") != "").select("place_id", F.explode(words).alias("term"))
    if stops:
        terms = terms.where(~F.col("term").isin(*sorted(stops)))
    tf = terms.groupBy("place_id", "term").agg(F.count("*").alias("tf"))
    n = texts.where(F.trim("text") != "").agg(F.countDistinct("place_id").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    kept = df.crossJoin(F.broadcast(n)).where((F.col("n") >= MIN_DOCUMENTS) & (F.col("df") >= MIN_PLACES) & (F.col("df") <= MAX_SHARE * F.col("n")))  # one row
    w = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    raw = tf.join(kept, "term").select("place_id", "term", w.alias("w"))
    length = raw.groupBy("place_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, "place_id").select("place_id", "term", (F.col("w") / F.col("length")).alias("weight"))


def keywords(texts: DataFrame, names: DataFrame, stops: set[str] = frozenset(), most: int = MAX_KEYWORDS, least: float = MIN_WEIGHT) -> DataFrame:
    """(place_id, term, weight, rank, tag): a place's heaviest terms that are plain words and no words of its own name."""
    own = names.select("place_id", F.explode(F.split(F.lower("name"), r"[\s\-]+")).alias("term")).distinct()
    plain = weights(texts, stops).where((F.col("weight") >= least) & F.col("term").rlike(r"^[a-zA-Záéíóúñü]{4,}$"))
    kept = plain.join(own, ["place_id", "term"], "left_anti")
    w = Window.partitionBy("place_id").orderBy(F.desc("weight"), "term")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumn("tag", F.concat(F.lit(PREFIX), F.col("term")))
