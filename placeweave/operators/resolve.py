"""Entity resolution: blocking, pair decisions, leaders, name-only mentions, folds of signals, and enrichment."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.functions import text as T
from placeweave.functions.geo import haversine_m, merge_confidence, merge_rule
from placeweave.operators.graph import connected_components, cut

#: Trigram similarity above which a place is a candidate for a mention without coordinates.
NAME_CANDIDATES = 0.4


def _grid(places: DataFrame, radius_m: float, id_column: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """(left, right) of places with their cell(city, y, x): the left side keeps its cell, the right one is copied to the cells around, so a pair meets once.

    Cells are of at least the radius; rows of cells go around the globe, with fewer and wider cells near the poles. Columns
    `more` come along as left_* and right_*.
    """
    angle = radius_m / C.EARTH_RADIUS_M
    size = math.degrees(radius_m / C.EARTH_RADIUS_M)

    def cells(y: Column) -> Column:
        """Cells in a row: each as wide as a radius can be in it and in the rows beside it."""
        top = F.least(F.lit(90.0), (F.abs(y) + 2) * size)
        return F.greatest(F.lit(1), F.floor(math.pi / F.asin(F.least(F.lit(1.0), math.sin(min(angle, math.pi) / 2) * 1.000001 / F.greatest(F.lit(1e-12), F.cos(F.radians(top)))))))

    at = lambda y: F.floor((F.col("lng") + 180.0) / 360.0 * cells(y))
    p = places.where(F.abs("lat") <= 90).select(F.col(id_column).alias("id"), "city", "lat", "lng", F.floor(F.col("lat") / size).alias("y"), *more)
    around = F.array_distinct(F.array(*(F.struct((F.col("y") + i).alias("y"), F.pmod(at(F.col("y") + i) + j, cells(F.col("y") + i)).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = p.select(F.col("id").alias("left_id"), "city", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), "y", F.pmod(at(F.col("y")), cells(F.col("y"))).alias("x"), *(F.col(c).alias(f"left_{c}") for c in more))
    right = p.withColumn("around", around).withColumn("c", F.explode("around")).select(F.col("id").alias("right_id"), "city", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), "c.y", "c.x", *(F.col(c).alias(f"right_{c}") for c in more))
    return left, right


def _near(joined: DataFrame, radius_m: float) -> DataFrame:
    """joined rows of both sides of a grid with distance_m, within the radius; latitudes are compared first, which is cheaper."""
    band = F.abs(F.col("lat1") - F.col("lat2")) <= math.degrees(radius_m / C.EARTH_RADIUS_M) * 1.000001
    return joined.where((F.col("left_id") < F.col("right_id")) & band).withColumn("distance_m", haversine_m(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))).where(F.col("distance_m") <= radius_m)


def near_pairs(places: DataFrame, radius_m: float, id_column: str = "place_id") -> DataFrame:
    """(left_id, right_id, distance_m) of places of a city within a radius, left_id < right_id.

    An equi-join on grid cells. The join is sorted by a hint: the columns of a place take far more memory than their
    Parquet file, by whose size Spark would broadcast all places. places must have id, city, lat and lng; rows without
    coordinates drop out.
    """
    left, right = _grid(places, radius_m, id_column)
    return _near(left.hint("merge").join(right, ["city", "y", "x"]), radius_m).select("left_id", "right_id", "distance_m")


def similar_names(keys: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, similarity) of keys(id, city, key) of a city whose trigram similarity is above `least`.

    Pairs of distinct keys are expanded to ids.
    """
    x = keys.select("city", F.col("key").alias("a"), F.col("id").alias("i"))
    y = keys.select("city", F.col("key").alias("b"), F.col("id").alias("j"))
    ids = alike_keys(keys, least).join(x.hint("merge"), ["city", "a"]).join(y.hint("merge"), ["city", "b"]).where(F.col("i") != F.col("j"))
    return ids.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"), "similarity").distinct()


def alike_keys(keys: DataFrame, least: float) -> DataFrame:
    """(city, a, b, similarity), a <= b, of distinct keys(city, key) of a city whose trigram similarity is above `least`.

    A key's trigrams are joined on the rarest ones, of which a pair above the threshold shares one.
    """
    one = keys.select("city", "key").distinct().withColumn("grams", T.trigrams(F.col("key")))
    spread = one.select("city", "key", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counts = spread.groupBy("city", "gram").agg(F.count("*").alias("df"))
    w = Window.partitionBy("city", "key").orderBy("df", "gram")
    prefix = spread.join(counts, ["city", "gram"]).withColumn("at", F.row_number().over(w)).where(F.col("at") <= F.col("n") - F.floor(F.col("n") * least))
    a = prefix.select("city", "gram", F.col("key").alias("a"), F.col("n").alias("n1"))
    b = prefix.select("city", "gram", F.col("key").alias("b"), F.col("n").alias("n2"))
    candidates = a.join(b, ["city", "gram"]).where((F.col("a") <= F.col("b")) & (F.col("n2") >= F.col("n1") * least) & (F.col("n1") >= F.col("n2") * least)).select("city", "a", "b").distinct()
    return candidates.withColumn("similarity", T.jaccard(T.trigrams(F.col("a")), T.trigrams(F.col("b")))).where(F.col("similarity") > least)


#: Parts of the rows of a name that are joined apart, so that a common name is no task of its own.
NAME_PARTS = 8


def block_pairs(places: DataFrame, radius_m: float = C.BLOCK_RADIUS_M, least: float = 0.35) -> DataFrame:
    """(left_id, right_id): pairs of a city that are near or alike by name.

    A pair is made once, as a near one or else as one alike by name, so pairs are not shuffled to find repeated ones; only
    ids that places repeat call for that.
    """
    keyed = places.select(F.col("place_id").alias("id"), "city", "lat", "lng", T.name_key(F.col("name")).alias("key"))
    near = near_pairs(places, radius_m).select("left_id", "right_id")
    x = keyed.select("city", F.col("key").alias("a"), F.col("id").alias("i"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), F.pmod(F.xxhash64("id"), F.lit(NAME_PARTS)).alias("part"))
    y = keyed.select("city", F.col("key").alias("b"), F.col("id").alias("j"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NAME_PARTS - 1).cast("long"))).alias("part"))
    context, on = places.sparkSession, ["city", "b", "part"]
    # few rows make many pairs, so their number says nothing of the work
    tasks = max(int(context.conf.get("spark.sql.shuffle.partitions")), 8 * context.sparkContext.defaultParallelism)
    named = alike_keys(keyed, least).join(x.hint("merge"), ["city", "a"]).repartition(tasks, *on).hint("merge").join(y.repartition(tasks, *on), on)
    here = F.coalesce((F.abs("lat1") <= 90) & (F.abs("lat2") <= 90) & (haversine_m(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")) <= radius_m), F.lit(False))
    once = F.when(F.col("a") == F.col("b"), F.col("i") < F.col("j")).otherwise(F.col("i") != F.col("j"))
    pairs = near.union(named.where(once & ~here).select(F.least("i", "j"), F.greatest("i", "j")))
    repeated = not places.groupBy("place_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return pairs.distinct() if repeated else pairs


def near_alike(places: DataFrame, similarity: str, radius_m: float = C.MERGE_RADIUS_M) -> DataFrame:
    """near_pairs with left_key, right_key, settled flags, `fuzzy` and whether they share a distinctive word, of pairs that are alike by MIN_SIMILARITY at least.

    Keys come first: the distinct ones of a cell meet those of the cells around, each distinct pair of keys is compared
    once, and only rows of keys that are alike are joined. places must have `settled`; two settled places are no pair.
    """
    left, right = _grid(places.withColumn("key", T.name_key(F.col("name"))), radius_m, "place_id", "key", "settled")
    cell = ["city", "y", "x"]
    two = cut(left.select(*cell, "left_key").distinct().hint("merge").join(right.select(*cell, "right_key").distinct(), cell).select("left_key", "right_key").distinct())
    measured = fuzzy_similarity(two) if similarity == "fuzzy" else trigram_similarity(two)
    alike = measured.where(F.col("fuzzy") >= C.MIN_SIMILARITY).withColumn("anchored", F.arrays_overlap(T.distinctive_tokens(F.col("left_key")), T.distinctive_tokens(F.col("right_key"))))
    wanted = left.hint("merge").join(alike, "left_key")
    return _near(wanted.hint("merge").join(right, [*cell, "right_key"]).where(~(F.col("left_settled") & F.col("right_settled"))), radius_m)


def decide(pairs: DataFrame, similarity: Column) -> DataFrame:
    """pairs(left_key, right_key, anchored, distance_m, ...) with similarity, rule, confidence and decision; pairs too unlike drop out."""
    s = pairs.withColumn("similarity", similarity).where(F.col("similarity") >= C.MIN_SIMILARITY)
    s = s.withColumns({"rule": merge_rule(F.col("similarity"), F.col("distance_m"), F.col("anchored")), "confidence": merge_confidence(F.col("similarity"), F.col("distance_m"), F.col("anchored"))})
    flagged = (F.col("confidence") >= C.REVIEW_CONFIDENCE) & (F.col("similarity") >= C.REVIEW_SIMILARITY)
    return s.withColumn("decision", F.when(F.col("rule").isNotNull(), "merged").when(flagged, "flagged").otherwise("created"))


def fuzzy_similarity(keys: DataFrame) -> DataFrame:
    """Distinct pairs of keys(left_key, right_key) with `fuzzy`, compared in Arrow batches."""
    return keys.withColumn("fuzzy", T.name_similarity("left_key", "right_key"))


def trigram_similarity(keys: DataFrame) -> DataFrame:
    """Distinct pairs of keys(left_key, right_key) with `fuzzy` as the trigram similarity; trigrams are taken once a key."""
    grams = lambda side: keys.select(side).distinct().withColumn(f"{side}_grams", T.trigrams(F.col(side)))
    return keys.join(grams("left_key"), "left_key").join(grams("right_key"), "right_key").select("left_key", "right_key", T.jaccard(F.col("left_key_grams"), F.col("right_key_grams")).alias("fuzzy"))


#: Open pairs up to which one task settles them.
ONE_TASK = 200_000
#: Rounds after which components of open pairs are settled apart, for long chains.
CHAINS = 20


def absorb(df: pd.DataFrame) -> pd.DataFrame:
    """place_id of the records of pairs(left_id, right_id) that join a record before them: one that doesn't join another itself."""
    gone: set[int] = set()
    for right, mine in df.sort_values("right_id").groupby("right_id", sort=True)["left_id"]:
        if any(x not in gone for x in mine):
            gone.add(right)
    return pd.DataFrame({"place_id": pd.Series(sorted(gone), dtype="int64")})


def absorbed(pairs: DataFrame, one_task: int = ONE_TASK, max_rounds: int = 10_000) -> DataFrame:
    """(place_id) of the records that join one before them, of pairs(left_id, right_id) that a rule allows, left_id first.

    In each round the records join that are paired with one that is sure to survive, as it is no pair's right side any
    more, and all pairs of those go. What is left of up to `one_task` pairs is settled by one task; after CHAINS rounds
    so are components of that size. Pairs are cut each round.
    """
    rest, found = cut(pairs.select("left_id", "right_id")), []
    for n in range(max_rounds):
        size = rest.count()
        if size <= one_task:
            found += [rest.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(absorb, "place_id long")] if size else []
            empty = pairs.sparkSession.createDataFrame([], "place_id long")
            return cut(functools.reduce(DataFrame.union, found, empty))
        if n == CHAINS and one_task:
            parts = cut(connected_components(rest, "left_id", "right_id"))
            grouped = cut(rest.join(parts.withColumnRenamed("node", "left_id"), "left_id"))
            small = grouped.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= one_task).select("component")
            found.append(cut(grouped.join(small, "component", "left_semi").groupBy("component").applyInPandas(absorb, "place_id long")))
            rest = cut(grouped.join(small, "component", "left_anti").select("left_id", "right_id"))
            continue
        free = rest.join(rest.select(F.col("right_id").alias("left_id")).distinct(), "left_id", "left_anti")
        gone = cut(free.select(F.col("right_id").alias("place_id")).distinct())
        found.append(gone)
        for side in ("left_id", "right_id"):
            rest = rest.join(gone.withColumnRenamed("place_id", side), side, "left_anti")
        rest = cut(rest.select("left_id", "right_id"))
    raise RuntimeError(f"decisions not settled after {max_rounds} rounds")


def resolve(records: DataFrame, similarity: str = "fuzzy", one_task: int = ONE_TASK) -> DataFrame:
    """(place_id, survivor, decision, confidence, match, similarity, distance_m) of records in their order of arrival, which is place_id.

    Each record joins the best earlier survivor that a rule allows, else survives itself; flagged records survive next to a
    likely match. match is the survivor that a record came closest to, null without any. Records with a true `settled`, a
    column that may be missing, are places already: they survive and are compared only with new records. Only pairs that a
    rule allows tell who survives, so these are settled first; a record's match is then the best of its survivors.
    """
    known = records if "settled" in records.columns else records.withColumn("settled", F.lit(False))
    pairs = near_alike(known, similarity).where(~F.col("right_settled"))
    scored = cut(decide(pairs, F.col("fuzzy")).select("left_id", "right_id", "similarity", "rule", "confidence", "distance_m"))
    gone = absorbed(scored.where(F.col("rule").isNotNull()), one_task)
    item = F.struct("left_id", "similarity", "rule", "confidence", "distance_m")
    rank = F.struct(F.col("rule").isNotNull().alias("r"), "confidence", (-F.col("left_id")).alias("o"))
    best = scored.join(gone.withColumnRenamed("place_id", "left_id"), "left_id", "left_anti").groupBy("right_id").agg(F.max_by(item, rank).alias("b"))
    merged, flagged = F.col("b.rule").isNotNull(), (F.col("b.confidence") >= C.REVIEW_CONFIDENCE) & (F.col("b.similarity") >= C.REVIEW_SIMILARITY)
    decided = best.select(F.col("right_id").alias("place_id"), F.when(merged, F.col("b.left_id")).otherwise(F.col("right_id")).alias("survivor"), F.when(merged, "merged").when(flagged, "flagged").otherwise("created").alias("decision"), "b.confidence", F.col("b.left_id").alias("match"), "b.similarity", "b.distance_m")
    none = lambda c, value: F.coalesce(c, value).alias(c)
    return known.select("place_id").join(decided, "place_id", "left").select("place_id", none("survivor", F.col("place_id")), none("decision", F.lit("created")), none("confidence", F.lit(0.0)), "match", "similarity", "distance_m")


def reviews(decided_pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, similarity, distance_m, confidence, resolved) of pairs for a human, each once in the order of ids as text."""
    a, b = F.col("left_id").cast("string"), F.col("right_id").cast("string")
    out = decided_pairs.where(F.col("decision") == "flagged").withColumns({"x": F.least(a, b), "y": F.greatest(a, b)})
    return out.select(F.col("x").cast("long").alias("left_id"), F.col("y").cast("long").alias("right_id"), "similarity", "distance_m", "confidence", F.lit(False).alias("resolved")).dropDuplicates(["left_id", "right_id"])


def counters(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("cnt"))


def _alike(mentions: DataFrame, places: DataFrame, least: float) -> DataFrame:
    """(city, mkey, pkey) of mentions(city, mkey) and places(city, pkey) of a trigram similarity above `least`, by their rarest trigrams."""
    grams = lambda df, key: df.withColumn("grams", T.trigrams(F.col(key))).select("city", key, F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    x, y = grams(mentions, "mkey"), grams(places, "pkey")
    counts = y.groupBy("city", "gram").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy("city", key).orderBy(F.coalesce("df", F.lit(0)), "gram")
        return df.join(counts, ["city", "gram"], "left").withColumn("at", F.row_number().over(w)).where(F.col("at") <= F.col("n") - F.floor(F.col("n") * least)).select("city", "gram", key)

    pairs = prefix(x, "mkey").join(prefix(y, "pkey"), ["city", "gram"]).select("city", "mkey", "pkey").distinct()
    return pairs.where(T.jaccard(T.trigrams(F.col("mkey")), T.trigrams(F.col("pkey"))) > least)


def resolve_names(mentions: DataFrame, places: DataFrame, similarity: str = "fuzzy") -> DataFrame:
    """(mention_id, place_id, similarity, decision): mentions(mention_id, city, name) without coordinates joined to places.

    A mention joins the most similar place from NAME_ONLY_SIMILARITY on, else the only place whose distinctive words
    contain its own, else it is dropped (place_id null). Candidates share the key or a word of the mention's key, or have a
    trigram similarity above NAME_CANDIDATES. Distinct keys are compared, not rows.
    """
    m = mentions.select("mention_id", "city", T.name_key(F.col("name")).alias("mkey")).withColumn("anchors", T.distinctive_tokens(F.col("mkey")))
    p = places.select("place_id", "city", T.name_key(F.col("name")).alias("pkey")).groupBy("city", "pkey").agg(F.min("place_id").alias("place_id"), F.count("*").alias("cnt")).withColumn("panchors", T.distinctive_tokens(F.col("pkey")))
    words = lambda k: F.array_distinct(F.filter(F.split(k, " "), lambda w: w != ""))
    one = m.where("mkey <> ''").select("city", "mkey").distinct()
    shared = one.withColumn("word", F.explode(words(F.col("mkey")))).join(p.withColumn("word", F.explode(words(F.col("pkey")))), ["city", "word"]).select("city", "mkey", "pkey")
    candidates = shared.union(_alike(one, p.select("city", "pkey"), NAME_CANDIDATES)).distinct()
    pairs = candidates.withColumn("anchors", T.distinctive_tokens(F.col("mkey"))).join(p, ["city", "pkey"])
    if similarity == "fuzzy":
        known = pairs.select("mkey", "pkey").distinct().withColumn("sim", T.name_similarity("mkey", "pkey"))
        pairs = pairs.join(known, ["mkey", "pkey"])
    else:
        pairs = pairs.withColumn("sim", T.jaccard(T.trigrams(F.col("mkey")), T.trigrams(F.col("pkey"))))
    contained = (F.size("anchors") > 0) & (F.size(F.array_except("anchors", "panchors")) == 0)
    best = pairs.groupBy("city", "mkey").agg(
        F.max_by(F.struct("place_id", "sim"), F.struct("sim", (-F.col("place_id")).alias("o"))).alias("best"),
        F.sum(F.when(contained, F.col("cnt")).otherwise(0)).alias("n"),
        F.max(F.when(contained, F.struct("place_id", "sim"))).alias("only"),
    )
    near = F.col("best.sim") >= C.NAME_ONLY_SIMILARITY
    one = F.col("n") == 1
    out = m.select("mention_id", "city", "mkey").join(best, ["city", "mkey"], "left")
    return out.select(
        "mention_id",
        F.when(near, F.col("best.place_id")).when(one, F.col("only.place_id")).alias("place_id"),
        F.when(near, F.col("best.sim")).when(one, F.greatest(F.col("only.sim"), F.lit(C.NAME_ONLY_CONTAINED))).otherwise(F.coalesce("best.sim", F.lit(0.0))).alias("similarity"),
        F.when(near | one, "merged").otherwise("dropped").alias("decision"),
    )


def fold_signals(mentions: DataFrame) -> DataFrame:
    """One signal a place and source of mentions(place_id, source, seq, ...), folded from the first to the last.

    Counts of mentions, upvotes, threads and reviews add up, the best thread and the newest time count, communities are
    united, and sentiment is averaged by upvotes and one more, rounded at every step, so the order matters. Rating and
    source identity are the first one's, the url is the first there is. rating, source_place_id, thread_count, subreddits
    and merged_mentions (1 if null) may be missing.
    """
    optional = {"source_place_id": "string", "rating": "double", "thread_count": "long", "subreddits": "array<string>", "merged_mentions": "int"}
    held = mentions.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in mentions.columns})
    fields = ("sentiment", "upvotes", "mention_count", "thread_score", "review_count", "thread_count", "merged_mentions", "rating", "source_place_id", "subreddits")
    item = F.struct("seq", *fields, "observed_at", "url")
    sorted_items = held.groupBy("place_id", "source").agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    first = F.element_at("items", 1)
    times = lambda c: F.coalesce(c["merged_mentions"], F.lit(1)).cast("int")
    start = F.struct(zero(first["sentiment"]).alias("sentiment"), whole(first["upvotes"]).alias("upvotes"), times(first).alias("merged"))
    step = lambda acc, x: F.struct(
        F.bround((acc["sentiment"] * (acc["upvotes"] + 1) + zero(x["sentiment"]) * (whole(x["upvotes"]) + 1)) / (acc["upvotes"] + 1 + whole(x["upvotes"]) + 1), 4).alias("sentiment"),
        (acc["upvotes"] + whole(x["upvotes"])).alias("upvotes"),
        (acc["merged"] + times(x)).alias("merged"),
    )
    folded = sorted_items.withColumn("f", F.aggregate(F.slice("items", 2, F.greatest(F.lit(1), F.size("items"))), start, step))
    total = lambda name: F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + whole(x[name]))
    said = F.filter("items.subreddits", lambda x: x.isNotNull())
    return folded.select(
        "place_id", "source", total("mention_count").alias("mention_count"), F.col("f.upvotes").alias("upvotes"), F.array_max(F.transform("items", lambda x: whole(x["thread_score"]))).alias("thread_score"),
        F.when(F.exists("items", lambda x: x["sentiment"].isNotNull()), F.col("f.sentiment")).alias("sentiment"), total("review_count").alias("review_count"), F.array_max("items.observed_at").alias("observed_at"),
        F.try_element_at(F.filter("items.url", lambda u: u.isNotNull()), F.lit(1)).alias("url"), F.col("f.merged").alias("merged_mentions"),
        total("thread_count").alias("thread_count"), F.element_at("items", 1)["rating"].alias("rating"), F.element_at("items", 1)["source_place_id"].alias("source_place_id"),
        F.when(F.size(said) > 0, F.array_sort(F.array_distinct(F.flatten(said)))).alias("subreddits"),
    )


def enrich(records: DataFrame, survivors: DataFrame) -> DataFrame:
    """Survivors with their gaps filled by the records that joined them, the earliest first.

    Only nulls are filled, but any category beats `other`, and a price or hours that are nothing count as none. Name, city
    and coordinates are the survivor's own.
    """
    joined = records.join(survivors.select("place_id", "survivor"), "place_id")
    order = F.struct((F.col("place_id") != F.col("survivor")).alias("other"), "place_id")
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, order)).alias(c)
    present = lambda c: F.col(c).isNotNull()
    filled = [c for c in ("address", "neighborhood", "country_code", "open_min", "close_min") if c in records.columns]
    own = [c for c in ("city", "lat", "lng") if c in records.columns]
    out = joined.groupBy("survivor").agg(
        *(F.min_by(c, order).alias(c) for c in ("name", *own)),
        first("price_tier", present("price_tier") & (F.col("price_tier") != 0)),
        F.coalesce(first("category", F.col("category") != "other"), F.lit("other")).alias("category"),
        *(first(c, present(c)) for c in filled),
        *([first("hours", F.size("hours") > 0)] if "hours" in records.columns else []),
        F.count("*").alias("n_records"),
    )
    return out.withColumnRenamed("survivor", "place_id")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows of `new` in place of those of the same keys."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """(place_id, content_hash, text, weight, cnt): each text of a place once, blank ones left out, cut to 4000 characters."""
    kept = evidence.where(F.trim("text") != "").withColumn("content_hash", T.content_hash(F.col("text")))
    return kept.groupBy("place_id", "content_hash").agg(F.min_by(F.substring("text", 1, 4000), "doc_id").alias("text"), F.min_by("weight", "doc_id").alias("weight"), F.count("*").alias("cnt"))
