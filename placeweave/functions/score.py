"""The scoring model's terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import config as C


def sigmoid(x: Column) -> Column:
    return F.when(x < -60, 0.0).when(x > 60, 1.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def shrunk_rating(rating: Column, reviews: Column, mean: Column) -> Column:
    n = F.greatest(F.lit(0.0), F.coalesce(reviews, F.lit(0)).cast("double"))
    return (n * rating + C.PRIOR_REVIEWS * mean) / (n + C.PRIOR_REVIEWS)


def volume_weight(reviews: Column) -> Column:
    n = F.greatest(F.lit(0.0), reviews.cast("double"))
    return F.when(reviews.isNull(), C.VOLUME_UNKNOWN).otherwise(n / (n + C.VOLUME_HALF))


def age_days(observed_at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(observed_at)) / 86_400_000_000.0)


def recency_weight(age: Column) -> Column:
    return F.when(age.isNull(), C.RECENCY_UNKNOWN).otherwise(F.greatest(F.lit(C.RECENCY_FLOOR), F.pow(F.lit(0.5), age / C.RECENCY_HALF_LIFE_DAYS)))


def by_source(values: dict[str, float], otherwise: float, source: Column) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    return out.otherwise(otherwise)
