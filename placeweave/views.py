"""Places, signals, evidence and runs derived from the driver's tables, as DataFrames and as the same SQL for an oracle.

All derived numbers come from integers with at most one multiplication by a double, so engines agree on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.operators.graph import spread

#: Observation time of the derived signals' scores.
NOW = "2002-01-01 00:00:00"
HOME = (40.4168, -3.7038)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, name, city, lat, lng, category, price_tier, tags, open_min, close_min, closed_day).

    open_min is null where hours are unknown; close_min may pass midnight; closed_day is the weekday without hours.
    """
    k = "p_partkey"
    name = f"array({', '.join(repr(c) for c in C.CATEGORIES)})"
    return spread(table(spark, sf_dir, "part").select(k, "p_name", "p_size", "p_type", "p_brand")).selectExpr(
        f"{k} AS place_id",
        "p_name AS name",
        f"concat('city-', {k} % 5) AS city",
        f"40.4168D + (({k} * {k} * 31 + {k} * 7919) % 2003 - 1000) * 0.00002D AS lat",
        f"-3.7038D + (({k} * {k} * 17 + {k} * 1301) % 1999 - 1000) * 0.000026D AS lng",
        f"element_at({name}, p_size % 10 + 1) AS category",
        f"CASE WHEN p_size % 6 <> 0 THEN CAST(1 + {k} % 4 AS INT) END AS price_tier",
        "concat(array(lower(p_type), lower(p_brand)), split(lower(p_name), ' ')) AS tags",
        "CASE p_size % 3 WHEN 1 THEN 480 + 30 * (p_size % 7) WHEN 2 THEN 1080 + 60 * (p_size % 4) END AS open_min",
        "CASE p_size % 3 WHEN 1 THEN 1080 + 60 * (p_size % 5) WHEN 2 THEN 1440 + 60 * (p_size % 5) END AS close_min",
        "p_size % 7 AS closed_day",
    )


PLACES = """
v_place AS (
  SELECT p_partkey AS place_id, p_name AS name, 'city-' || (p_partkey % 5) AS city,
    40.4168::DOUBLE + ((p_partkey * p_partkey * 31 + p_partkey * 7919) % 2003 - 1000) * 0.00002::DOUBLE AS lat,
    -3.7038::DOUBLE + ((p_partkey * p_partkey * 17 + p_partkey * 1301) % 1999 - 1000) * 0.000026::DOUBLE AS lng,
    ['restaurant', 'cafe', 'bar', 'attraction', 'museum', 'park', 'shopping', 'hotel', 'nightlife', 'other'][p_size % 10 + 1] AS category,
    CASE WHEN p_size % 6 <> 0 THEN CAST(1 + p_partkey % 4 AS INTEGER) END AS price_tier,
    [lower(p_type), lower(p_brand)] || string_split(lower(p_name), ' ') AS tags,
    CASE p_size % 3 WHEN 1 THEN 480 + 30 * (p_size % 7) WHEN 2 THEN 1080 + 60 * (p_size % 4) END AS open_min,
    CASE p_size % 3 WHEN 1 THEN 1080 + 60 * (p_size % 5) WHEN 2 THEN 1440 + 60 * (p_size % 5) END AS close_min,
    p_size % 7 AS closed_day
  FROM part
)"""


def hours_of(df: DataFrame) -> DataFrame:
    """df with `hours`: weekday to intervals of HH:MM, null where unknown, no interval on closed_day."""
    clock = lambda m: F.format_string("%02d:%02d", (m % 1440 / 60).cast("int"), (m % 60).cast("int"))
    interval = F.array(F.struct(clock(F.col("open_min")).alias("open"), clock(F.col("close_min")).alias("close")))
    none = F.expr("CAST(array() AS array<struct<open: string, close: string>>)")
    days = F.create_map(*(x for i, d in enumerate(C.DAYS) for x in (F.lit(d), F.when(F.col("closed_day") == i, none).otherwise(interval))))
    return df.withColumn("hours", F.when(F.col("open_min").isNotNull(), days))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, source, rating, review_count, observed_at, sentiment, upvotes, mention_count, thread_score), thinned to 0 to 4 sources a place."""
    found = (
        table(spark, sf_dir, "lineitem")
        .selectExpr("l_partkey AS place_id", "CAST(l_suppkey % 4 AS INT) AS s", "l_quantity", "l_shipdate", "CAST(round(l_discount * 100) AS BIGINT) AS discount", "CAST(round(l_tax * 100) AS BIGINT) AS tax", "CAST(floor(l_extendedprice / 50) AS BIGINT) AS price")
        .where("(place_id * place_id * (s + 1) + place_id * 3 + s) % 13 < 7")
        .groupBy("place_id", "s")
        .agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.max("l_shipdate").alias("observed_at"), F.sum("discount").alias("discount"), F.sum("tax").alias("tax"), F.max("price").alias("price"))
    )
    return found.selectExpr(
        "place_id",
        "element_at(array('google_places', 'yelp', 'blog', 'reddit'), s + 1) AS source",
        "CASE WHEN s < 2 THEN 1 + 4 * (q / n) / 50 END AS rating",
        "CAST(q AS BIGINT) * CASE WHEN s = 0 THEN 200 ELSE 1 END AS review_count",
        "CAST(observed_at AS TIMESTAMP) AS observed_at",
        "CASE WHEN s = 3 THEN discount * 20.0D / (100 * n) - 1 END AS sentiment",
        "CASE WHEN s = 3 THEN tax * 10 END AS upvotes",
        "CASE WHEN s = 3 THEN n END AS mention_count",
        "CASE WHEN s = 3 THEN price END AS thread_score",
    )


SIGNALS = """
v_signal AS (
  SELECT place_id, ['google_places', 'yelp', 'blog', 'reddit'][s + 1] AS source,
    CASE WHEN s < 2 THEN 1 + 4 * (q / n) / 50 END AS rating,
    CAST(q AS BIGINT) * CASE WHEN s = 0 THEN 200 ELSE 1 END AS review_count, observed_at,
    CASE WHEN s = 3 THEN discount * 20.0::DOUBLE / (100 * n) - 1 END AS sentiment,
    CASE WHEN s = 3 THEN tax * 10 END AS upvotes, CASE WHEN s = 3 THEN n END AS mention_count, CASE WHEN s = 3 THEN price END AS thread_score
  FROM (
    SELECT l_partkey AS place_id, CAST(l_suppkey % 4 AS INTEGER) AS s, sum(l_quantity) AS q, count(*) AS n, max(l_shipdate) AS observed_at,
      CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
      max(CAST(floor(l_extendedprice / 50) AS BIGINT)) AS price
    FROM lineitem WHERE (l_partkey * l_partkey * (l_suppkey % 4 + 1) + l_partkey * 3 + l_suppkey % 4) % 13 < 7
    GROUP BY l_partkey, l_suppkey % 4
  )
)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, doc_id, text, weight): documents dealt to places by their id."""
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("n_places"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).crossJoin(F.broadcast(parts))  # one row
    return docs.select((F.col("doc_id") % F.col("n_places")).alias("place_id"), "doc_id", "text", (1 + F.col("doc_id") % 7).cast("double").alias("weight"))


EVIDENCE = """
v_evidence AS (
  SELECT doc_id % (SELECT count(*) FROM part) AS place_id, doc_id, text, CAST(1 + doc_id % 7 AS DOUBLE) AS weight FROM documents
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, mode, started_at, fetched) of ingest runs."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS source", "o_orderstatus AS mode", "o_orderdate AS started_at", "o_orderkey AS run_id", "CAST(o_totalprice AS BIGINT) AS fetched")


#: Scores of signals and places, on top of v_place and v_signal.
SCORES = f"""
v_dist AS (
  SELECT city, source, CASE WHEN n >= 8 THEN m WHEN source = 'google_places' THEN 4.45 WHEN source = 'yelp' THEN 4.10 ELSE 0.0 END AS mean_rating,
    CASE WHEN n >= 8 THEN s WHEN source = 'google_places' THEN 0.25 WHEN source = 'yelp' THEN 0.45 WHEN source = 'reddit' THEN 0.40 ELSE 1.0 END AS sd_rating,
    n, n >= 8 AS measured
  FROM (SELECT city, source, avg(rating) AS m, stddev_samp(rating) AS s, count(*) AS n FROM v_signal JOIN v_place USING (place_id) WHERE rating IS NOT NULL GROUP BY city, source)
), v_terms AS (
  SELECT g.*, p.city,
    CASE WHEN g.source = 'reddit' THEN 'mention' WHEN g.source = 'blog' OR rating IS NULL THEN 'listed' ELSE 'rated' END AS kind,
    coalesce(mean_rating, CASE g.source WHEN 'google_places' THEN 4.45 WHEN 'yelp' THEN 4.10 ELSE 0.0 END)::DOUBLE AS mean_rating,
    greatest(0.08, coalesce(sd_rating, CASE g.source WHEN 'google_places' THEN 0.25 WHEN 'yelp' THEN 0.45 ELSE 0.4 END))::DOUBLE AS sd_rating,
    greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(observed_at)) / 86400000000.0::DOUBLE) AS age,
    ln(1 + coalesce(upvotes, 0)) + coalesce(nullif(mention_count, 0), review_count, 0) AS ev
  FROM v_signal g JOIN v_place p USING (place_id) LEFT JOIN v_dist d ON d.city = p.city AND d.source = g.source
), v_z AS (
  SELECT *, CASE WHEN kind = 'rated' THEN (review_count * rating + 50.0 * mean_rating) / (review_count + 50.0) END AS shrunk FROM v_terms
), v_scored AS (
  SELECT *, (shrunk - mean_rating) / sd_rating AS z,
    CASE WHEN kind = 'mention' THEN least(1.0, greatest(0.0, 0.5 + 0.5 * sentiment * (ev / (ev + 6.0)))) WHEN kind = 'listed' THEN 0.66
      ELSE 1.0 / (1.0 + exp(-0.8 * (shrunk - mean_rating) / sd_rating)) END::DOUBLE AS quality,
    CASE WHEN kind = 'listed' OR source = 'blog' THEN 0.45 WHEN source = 'google_places' THEN 1.0 WHEN source = 'yelp' THEN 0.85 ELSE 0.8 END::DOUBLE AS credibility,
    CASE WHEN kind = 'mention' THEN 0.65 * (ev / (ev + 6.0)) + 0.35 * (thread_score / (thread_score + 400.0)) WHEN kind = 'listed' THEN 0.35 ELSE review_count / (review_count + 120.0) END::DOUBLE AS volume,
    greatest(0.15, pow(0.5, age / 540.0))::DOUBLE AS recency
  FROM v_z
), v_sums AS (
  SELECT place_id, sum(credibility * volume * recency) AS evidence, sum(quality * credibility * volume * recency) AS qw,
    sum(quality * quality * credibility * volume * recency) AS qqw, count(DISTINCT source) AS source_count FROM v_scored GROUP BY place_id
), v_comp0 AS (
  SELECT place_id, evidence, source_count, qw / evidence AS raw_base, evidence / (evidence + 0.35) AS confidence,
    CASE WHEN source_count >= 2 THEN greatest(0.0, 1.0 - sqrt(greatest(0.0, qqw / evidence - pow(qw / evidence, 2))) / 0.30) ELSE 1.0 END AS agreement FROM v_sums
), v_comp AS (
  SELECT *, 0.5 + (raw_base - 0.5) * confidence AS base, CASE WHEN source_count >= 2 THEN 0.12 * (1.0 - 1.0 / source_count) * agreement ELSE 0.0 END AS bonus FROM v_comp0
), v_score AS (
  SELECT *, least(1.0, greatest(0.0, base + bonus)) * 100.0 AS score FROM v_comp
), v_full AS (
  SELECT p.*, coalesce(s.score, 0.0)::DOUBLE AS score, coalesce(s.source_count, 0) AS source_count FROM v_place p LEFT JOIN v_score s USING (place_id)
)"""


def with_views(body: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


def scored_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """places with `score` and `source_count`; 0 without signals."""
    from placeweave.operators.scoring import rescore

    return rescore(places(spark, sf_dir), signals(spark, sf_dir), F.lit(NOW).cast("timestamp"))
