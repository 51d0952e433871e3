import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from placeweave.functions import geo, score
from placeweave.functions import hours as H
from placeweave.functions import text as T


def one(spark, *columns, **values):
    row = spark.createDataFrame([Row(**(values or {"x": 1}))])
    return row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_name_keys(spark):
    names = ["Café Rivas", "Restaurante Botín", "El Museo", "Museo Nacional del Prado", "Mercado de San Miguel", ""]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", T.name_key(F.col("n")).alias("k"), T.distinctive_tokens(T.name_key(F.col("n"))).alias("d")).orderBy("i").collect()
    assert [r["k"] for r in rows] == ["cafe rivas", "botin", "el museo", "nacional prado", "mercado san miguel", ""]
    assert rows[0]["d"] == ["rivas"] and rows[3]["d"] == ["prado"]


GOLDEN = [
    ("cafe rivas", "cafe rivas palermo", 30, 0.8571, "merged"),
    ("retiro park", "parque retiro", 14, 0.6667, "merged"),
    ("prado", "nacional prado", 15, 0.7632, "merged"),
    ("reina sofia", "nacional centro arte reina sofia", 15, 0.7558, "merged"),
    ("botin", "sobrino botin", 14, 0.7778, "merged"),
    ("mercado san miguel", "mercado san miguel", 10, 1.0, "merged"),
    ("casa lucio", "casa botin", 40, 0.6529, "flagged"),
    ("casa dani", "mercado paz", 15, 0.4353, None),
    ("toma cafe", "toma cafe", 800, 1.0, "created"),
    ("toma cafe", "toma cafe", 240, 1.0, "merged"),
]


def test_golden_pairs(spark):
    from placeweave.operators.resolve import decide

    for a, b, _, s, _ in GOLDEN:
        assert T.similarity(a, b) == pytest.approx(s, abs=1e-4)
    rows = [(i, a, b, float(m)) for i, (a, b, m, _, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i int, left_key string, right_key string, distance_m double")
    df = df.withColumn("anchored", F.arrays_overlap(T.distinctive_tokens(F.col("left_key")), T.distinctive_tokens(F.col("right_key"))))
    got = {r["i"]: r["decision"] for r in decide(df, T.name_similarity("left_key", "right_key")).collect()}
    assert [got.get(i) for i in range(len(GOLDEN))] == [g[4] for g in GOLDEN]


def test_proximity_and_confidence(spark):
    r = one(spark, geo.proximity(F.lit(90.0)), geo.proximity(F.lit(0.0)), geo.merge_confidence(F.lit(1.0), F.lit(251.0), F.lit(True)), geo.merge_confidence(F.lit(1.0), F.lit(0.0), F.lit(True)))
    assert (r[0], r[1], r[2], r[3]) == (0.5, 1.0, 0.0, 1.0)


def test_haversine_and_box(spark):
    d = one(spark, geo.haversine_m(F.lit(40.4138), F.lit(-3.6921), F.lit(40.4153), F.lit(-3.6844)))[0]
    assert 600 < d < 700
    assert one(spark, geo.within_box(F.lit(40.4168), F.lit(-3.7038), (40.4168, -3.7038), 100.0))[0]


@pytest.mark.parametrize(("text", "phrase", "hits"), [("Tiny, no laptops, in and out.", "laptops", 0), ("Loud, fun, not a place for a quiet dinner.", "quiet", 0), ("It's not cheap, but the quiet terrace is lovely.", "quiet", 1), ("It's quiet. No music.", "quiet", 1), ("Book online for updates", "line", 0), ("", "quiet", 0)])
def test_phrases(spark, text, phrase, hits):
    assert one(spark, T.phrase_hits(T.tokens(F.lit(text)), T.tokens(F.lit(phrase))))[0] == hits


def test_price_texts(spark):
    texts = ["€€", "free entry", "€12", "€12.50", "from €31,5", "€61", "cheap", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.price_tier(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in rows] == [2, 1, 1, 2, 3, 4, None, None]


def test_categories(spark):
    types = F.array(*map(F.lit, ("market", "tourist_attraction", "food")))
    assert one(spark, T.category(types, T.MAP_TYPES))[0] == "attraction"
    assert one(spark, T.category(types, T.MAP_TYPES, F.lit("market")))[0] == "restaurant"
    assert one(spark, T.category(F.array(F.lit("zzz")), T.LISTING_TYPES))[0] == "other"


@pytest.fixture(scope="module")
def week(spark):
    return spark.createDataFrame([({"mon": [("10:00", "20:00")], "fri": [("23:00", "03:00"), ("x", "y")], "sun": []},), (None,), ({},)], f"h {H.TYPE}")


def test_hours(week):
    h = F.col("h")
    rows = week.select(H.intervals(h, F.lit(4)).alias("fri"), H.intervals(h, F.lit(6)).alias("sun"), H.intervals(h, F.lit(1)).alias("tue"), H.earliest_open(h, F.lit(0), F.lit(480)).alias("a"), H.earliest_open(h, F.lit(0), F.lit(1380)).alias("b"), H.open_during(h, F.lit(6), F.lit(600), F.lit(660)).alias("c"), H.open_during(h, F.lit(0), F.lit(1150), F.lit(1210)).alias("d")).collect()
    assert [tuple(x) for x in rows[0]["fri"]] == [(1380, 1620)] and rows[0]["sun"] == [] and rows[0]["tue"] is None
    assert (rows[0]["a"], rows[0]["b"], rows[0]["c"], rows[0]["d"]) == (600, None, False, False)
    for r in rows[1:]:
        assert r["fri"] is None and (r["a"], r["c"]) == (480, True)


def test_hours_from_sources(spark):
    at = "struct<day: int, hour: int, minute: int>"
    df = spark.createDataFrame([([((1, 10, 0), (1, 20, 30)), ((0, 9, 0), None), ((9, 1, 1), None)],), (None,)], f"p array<struct<open: {at}, close: {at}>>")
    r = df.select(H.from_periods(F.col("p")).alias("h")).collect()
    assert [tuple(x) for x in r[0]["h"]["mon"]] == [("10:00", "20:30")] and [tuple(x) for x in r[0]["h"]["sun"]] == [("00:00", "23:59")] and r[0]["h"]["tue"] == [] and r[1]["h"] is None
    df = spark.createDataFrame([([(4, "2300", "0300"), (9, "0100", "0200"), (None, None, None), (1, "9", "1000")],)], "p array<struct<day: int, start: string, end: string>>")
    h = df.select(H.from_entries(F.col("p")).alias("h")).first()["h"]
    assert [tuple(x) for x in h["fri"]] == [("23:00", "03:00")] and h["tue"] == []


@pytest.mark.parametrize(("text", "day", "expected"), [("Mon-Sat 10:00-22:00, Sun 11:00-21:00", "sat", [("10:00", "22:00")]), ("Mon-Sat 10:00-22:00, Sun 11:00-21:00", "sun", [("11:00", "21:00")]), ("Fri-Mon 9:00-14:00", "mon", [("09:00", "14:00")]), ("Fri-Mon 9:00-14:00", "tue", []), ("daily 08:00-20:00", "wed", [("08:00", "20:00")])])
def test_hours_in_words(spark, text, day, expected):
    assert [tuple(x) for x in one(spark, H.parse_text(F.lit(text)))[0][day]] == expected


def test_hours_not_understood(spark):
    assert one(spark, H.parse_text(F.lit("ask at the door")), H.parse_text(F.lit(None).cast("string")))[0:2] == (None, None)


def test_score_terms(spark):
    r = one(spark, score.recency_weight(F.lit(540.0)), score.recency_weight(F.lit(40_000.0)), score.recency_weight(F.lit(None).cast("double")), score.shrunk_rating(F.lit(4.9), F.lit(3), F.lit(4.48)), score.volume_weight(F.lit(None).cast("int")), score.sigmoid(F.lit(-100.0)))
    assert r[0] == pytest.approx(0.5) and r[1] == 0.15 and r[2] == 0.7 and 4.48 < r[3] < 4.6 and r[4] == 0.35 and r[5] == 0.0
