"""Ingest end to end: records of all feeds to places, signals, evidence, reviews and the outcome of each record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.operators import resolve as R
from placeweave.operators.browse import canonical
from placeweave.operators.graph import cut

_HOURS = "map<string, array<struct<open: string, close: string>>>"
_PLACE = f"name string, city string, country_code string, category string, lat double, lng double, address string, neighborhood string, price_tier int, hours {_HOURS}"
_VALUES = "rating double, review_count long, url string, observed_at timestamp, mention_count long, upvotes long, thread_score long, sentiment double, thread_count long, subreddits array<string>"
RAW = f"source_rank int, seq struct<payload: bigint, at: bigint>, source string, source_place_id string, {_PLACE}, {_VALUES}, evidence array<struct<text: string, url: string, weight: double>>"
PLACES = f"place_id long, {_PLACE}"
SIGNALS = f"place_id long, source string, source_place_id string, {_VALUES}, merged_mentions int"
EVIDENCE = "place_id long, source string, content_hash string, text string, url string, weight double"
REVIEWS = "left_id long, right_id long, similarity double, distance_m double, confidence double, resolved boolean"
_OUTCOME = ("record_id", "source", "source_place_id", "place_id", "decision", "confidence")


@dataclass
class Tables:
    places: DataFrame
    signals: DataFrame
    evidence: DataFrame
    reviews: DataFrame


@dataclass
class Ingested(Tables):
    outcomes: DataFrame


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema: missing ones null, others left out."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def empty(spark: SparkSession) -> Tables:
    return Tables(*(spark.createDataFrame([], s) for s in (PLACES, SIGNALS, EVIDENCE, REVIEWS)))


def ingest(raw: DataFrame, known: Tables | None = None, similarity: str = "fuzzy") -> Ingested:
    """The tables after a batch of raw records (RAW; missing columns are null), and what became of each record.

    Records come in the order of source_rank, seq and source_place_id. A record of a known source identity updates its
    signal. One with coordinates joins a place or becomes one; one with a name only joins a place or is dropped. Joined
    records fill gaps of their place, fold into its one signal of their source, and leave their texts, each once a place.
    Pairs too likely to ignore become reviews. decision is updated, created, merged, flagged or dropped. A repeated
    identity in a batch resolves once, its last record's values count. Records without a source identity or a name are
    dropped; an empty batch leaves the tables as they were.
    """
    known = known or empty(raw.sparkSession)
    places, signals, evidence, reviews = (conform(t, s) for t, s in zip((known.places, known.signals, known.evidence, known.reviews), (PLACES, SIGNALS, EVIDENCE, REVIEWS), strict=True))
    base = (places.agg(F.max("place_id")).first()[0] or 0) + 1
    # ids rise with the order, over the partitions of the sort; the cut keeps them
    ordered = conform(raw, RAW).orderBy("source_rank", "seq", "source_place_id").withColumn("record_id", F.lit(base) + F.monotonically_increasing_id())
    ordered = cut(ordered)
    identity = ["source", "source_place_id"]
    sound = ordered.where("source IS NOT NULL AND source_place_id IS NOT NULL AND trim(name) <> ''")
    firsts = sound.groupBy(*identity).agg(F.min("record_id").alias("first_id"))
    held = signals.groupBy(*identity).agg(F.min("place_id").alias("known_place"))
    new = sound.join(firsts, identity).where(F.col("record_id") == F.col("first_id")).join(held, identity, "left_anti")

    here = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    spot = lambda df, i, settled: df.select(F.col(i).alias("place_id"), "name", "city", "lat", "lng", F.lit(settled).alias("settled"))
    decided = R.resolve(spot(canonical(places), "place_id", True).union(spot(new.where(here), "record_id", False)), similarity).where(F.col("place_id") >= base)
    decided = cut(decided)
    created = new.join(decided.where(F.col("survivor") == F.col("place_id")).select(F.col("place_id").alias("record_id")), "record_id", "left_semi").select(F.col("record_id").alias("place_id"), "name", "city")
    names = R.resolve_names(new.where(~here).select(F.col("record_id").alias("mention_id"), "city", "name"), canonical(places).select("place_id", "name", "city").union(created), similarity)
    found = decided.select(F.col("place_id").alias("record_id"), F.col("survivor").alias("place_id"), "decision", "confidence").union(names.select("mention_id", "place_id", "decision", F.col("similarity").alias("confidence")))
    found = cut(found)

    of_identity = firsts.join(held, identity, "left").join(found.withColumnRenamed("record_id", "first_id"), "first_id", "left")
    place = F.coalesce("known_place", "place_id")
    first_one = (F.col("record_id") == F.col("first_id")) & F.col("known_place").isNull()
    joined = ordered.join(of_identity.select(*identity, "first_id", "known_place", place.alias("place_id"), F.col("decision").alias("first_decision"), "confidence"), identity, "left")
    decision = F.when(F.col("place_id").isNull(), "dropped").when(first_one, F.col("first_decision")).otherwise("updated")
    joined = cut(joined.withColumns({"decision": decision, "confidence": F.when(first_one | F.col("place_id").isNull(), F.coalesce("confidence", F.lit(0.0))).otherwise(1.0)}))
    attached = joined.where("place_id IS NOT NULL")

    pool = places.withColumn("survivor", F.col("place_id")).unionByName(attached.select(F.col("record_id").alias("place_id"), *(c for c in places.columns if c != "place_id"), F.col("place_id").alias("survivor")))
    places_out = conform(R.enrich(pool.drop("survivor"), pool.select("place_id", "survivor")), PLACES)

    values = [f.name for f in raw.sparkSession.createDataFrame([], _VALUES).schema.fields]
    last = attached.groupBy("place_id", *identity).agg(F.max_by(F.struct(*values), "record_id").alias("v"), F.min("record_id").alias("first_id"), F.bool_or(F.col("known_place").isNotNull()).alias("old"))
    fresh = last.select("place_id", *identity, F.when(F.col("old"), -1).otherwise(F.col("first_id")).cast("long").alias("seq"), "v.*", F.lit(1).alias("merged_mentions"))
    kept = signals.join(fresh.select(*identity), identity, "left_anti").withColumn("seq", F.lit(-1).cast("long"))
    signals_out = conform(R.fold_signals(kept.unionByName(fresh)), SIGNALS)

    texts = attached.select("place_id", "source", "record_id", F.posexplode("evidence").alias("at", "e")).select("place_id", "source", F.struct("record_id", "at").alias("order"), F.trim("e.text").alias("text"), "e.url", F.coalesce("e.weight", F.lit(1.0)).alias("weight")).where("text <> ''")
    texts = texts.withColumn("content_hash", T.content_hash(F.col("text")))
    once = texts.groupBy("place_id", "content_hash").agg(F.min_by(F.struct("source", F.substring("text", 1, 4000).alias("text"), "url", "weight"), "order").alias("e")).select("place_id", "content_hash", "e.*")
    evidence_out = evidence.unionByName(conform(once.join(evidence, ["place_id", "content_hash"], "left_anti"), EVIDENCE))

    doubts = R.reviews(decided.where("decision = 'flagged'").select(F.col("match").alias("left_id"), F.col("place_id").alias("right_id"), "similarity", "distance_m", "confidence", "decision"))
    reviews_out = reviews.unionByName(conform(doubts.join(reviews, ["left_id", "right_id"], "left_anti"), REVIEWS))
    return Ingested(places_out, signals_out, evidence_out, reviews_out, joined.select(*_OUTCOME))


def run_rows(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """runs(source, ...) with places_created, places_merged, places_updated, flagged_for_review and dropped of each source; flagged records are created ones too."""
    n = lambda *d: F.count_if(F.col("decision").isin(*d))
    counts = outcomes.groupBy("source").agg(n("created", "flagged").alias("places_created"), n("merged").alias("places_merged"), n("updated").alias("places_updated"), n("flagged").alias("flagged_for_review"), n("dropped").alias("dropped"))
    return runs.join(counts, "source", "left").fillna(0, ["places_created", "places_merged", "places_updated", "flagged_for_review", "dropped"])


def summary_lines(runs: DataFrame) -> DataFrame:
    """(source, line) of run_rows."""
    line = F.format_string("%-15s %-8s fetched %d, created %d, merged %d, updated %d, flagged %d, dropped %d", "source", "mode", "records_fetched", "places_created", "places_merged", "places_updated", "flagged_for_review", "dropped")
    return runs.select("source", F.when(F.col("error").isNotNull(), F.concat("source", F.lit(": "), "error")).otherwise(line).alias("line"))
