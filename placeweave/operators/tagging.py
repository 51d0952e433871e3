"""Tags of places: phrase rules over evidence, structured facts, agreement of sources, and contradictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave.functions import hours as H
from placeweave.functions import text as T


@dataclass(frozen=True)
class Rule:
    tag: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    share: float = 0.18
    sentiment: float | None = None


# The tag vocabulary, the phrases that speak for and against a tag, and the shares and sentiments it takes.
RULES = (
    Rule("family-friendly", ("kids", "kid", "children", "child", "family", "with kids", "my kids", "7 year old"), ("not for kids", "no kids", "adults only", "not a place for kids")),
    Rule("solo-friendly", ("solo", "by myself", "on my own", "alone", "read for an hour", "laptop", "in and out", "at the counter", "standing at the counter")),
    Rule("group-friendly", ("group", "groups", "we were six", "party of", "with friends", "students", "squeezed us in"), ("not for a group", "no groups", "terrible for a date")),
    Rule("date-night", ("romantic", "date", "intimate", "candlelit", "unforgettable"), ("not a romantic", "not romantic", "terrible for a date", "not a date"), sentiment=0.0),
    Rule("quiet", ("quiet", "calm", "peaceful", "relaxed", "no music", "dim", "dark", "intimate", "have a conversation", "actually talk", "shaded", "unchanged", "atmospheric"), ("not quiet", "anything but quiet", "not a place for a quiet")),
    Rule("lively", ("lively", "loud", "buzzing", "packed", "rammed", "crowded", "chaotic", "standing room only", "dance", "deafening", "very young crowd", "queue", "bustling")),
    Rule("touristy", ("tourist trap", "touristy", "tourists", "tourist"), ("not a tourist", "not touristy", "not a tourist one")),
    Rule("local-favorite", ("locals", "local crowd", "full of locals", "neighbourhood", "neighborhood", "where chefs eat", "institution", "not a tourist one", "locals use")),
    Rule("budget", ("cheap", "budget", "great value", "unbeatable value", "absurd value", "costs almost nothing", "free", "inexpensive", "reasonable", "good value", "free entry"), ("not cheap", "far from cheap", "not free")),
    Rule("pricey", ("expensive", "overpriced", "pricey", "not cheap", "splurge", "eye-watering")),
    Rule("laptop-friendly", ("laptop friendly", "laptop", "plugs", "wifi", "work here", "worked here"), ("no laptops", "not laptop", "no wifi", "laptops are not"), 0.12),
    Rule("reservation-recommended", ("book ahead", "book weeks ahead", "reservation", "reserve", "booking", "book the", "will not get in", "won't get in", "sought-after"), (), 0.12),
    Rule("queue-likely", ("queue", "line", "wait", "waiting", "get there before", "before the rush"), (), 0.12),
    Rule("cash-only", ("cash only", "cash when", "no cards", "does not take cards"), (), 0.08),
    Rule("outdoor-seating", ("terrace", "outdoor", "outside seating", "patio", "on the street"), (), 0.12),
    Rule("late-night", ("late night", "until 6am", "until 6", "2am", "3am", "all night", "after a night out"), (), 0.10),
    Rule("hidden-gem", ("hidden gem", "nobody knows", "almost nobody", "underrated", "not on any blog", "hardly anyone", "never crowded"), (), 0.10, 0.0),
    Rule("overrated", ("overrated", "overhyped", "not worth", "disappointing", "underwhelming"), (), 0.10),
)


def phrase_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(tag, phrase, words, first, vetoes, share, sentiment): one row a phrase, as many as the rules have."""
    rows = [(r.tag, p, vetoes, r.share, r.sentiment) for r in rules for vetoes, ps in ((False, r.include), (True, r.exclude)) for p in ps]
    out = spark.createDataFrame(rows, "tag string, phrase string, vetoes boolean, share double, sentiment double")
    return out.withColumn("words", T.tokens(F.col("phrase"))).where(F.size("words") > 0).withColumn("first", F.element_at("words", 1))


#: Rows of a phrase table up to which it is broadcast and its first words are looked up in place.
FEW_PHRASES = 10_000


def phrase_matches(snippets: DataFrame, phrases: DataFrame) -> DataFrame:
    """(place_id, doc_id, tag, phrase, vetoes, hits) of snippets(place_id, doc_id, text): matches of whole words.

    Each place where some phrase's first word stands becomes a row with the few words before and after it, and meets the
    phrases that begin so by an equi-join. Occurrences that a negator precedes do not count, but for vetoes, which state
    the denial themselves. Phrase tables beyond FEW_PHRASES are joined by shuffle.
    """
    size = phrases.agg(F.count("*").alias("n"), F.max(F.size("words")).alias("longest")).first()
    if not size["n"]:
        return snippets.limit(0).select("place_id", "doc_id", F.lit("").alias("tag"), F.lit("").alias("phrase"), F.lit(False).alias("vetoes"), F.lit(0).alias("hits"))
    few = size["n"] <= FEW_PHRASES
    # a generator's output is computed once a row
    held = snippets.select("place_id", "doc_id", F.explode(F.array(T.tokens(F.col("text")))).alias("tokens"))
    at = F.transform("tokens", lambda w, i: F.struct(w.alias("first"), i.alias("at")))
    if few:
        firsts = [r["first"] for r in phrases.select("first").distinct().collect()]
        at = F.filter(at, lambda x: x["first"].isin(*firsts))
    near = lambda x: F.struct(x["first"].alias("first"), F.slice("tokens", x["at"] + 1, F.lit(size["longest"])).alias("after"), F.slice("tokens", F.greatest(F.lit(0), x["at"] - T.REACH) + 1, F.least(x["at"], F.lit(T.REACH))).alias("before"))
    begun = held.select("place_id", "doc_id", F.inline(F.transform(at, near)))
    pairs = begun.join(F.broadcast(phrases) if few else phrases, "first").where(F.slice("after", 1, F.size("words")) == F.col("words"))
    counted = pairs.where(F.col("vetoes") | ~T.negated(F.col("before"), F.size("before")))
    return counted.groupBy("place_id", "doc_id", "tag", "phrase", "vetoes").agg(F.count("*").cast("int").alias("hits"))


def tag_shares(snippets: DataFrame, phrases: DataFrame) -> DataFrame:
    """(place_id, tag, share, mean_sentiment, vetoed, n_phrases): the weighted share of a place's snippets that speak for a tag.

    snippets(place_id, doc_id, text, weight, sentiment); weights below 0.1 count as 0.1, blank texts not at all.
    """
    kept = snippets.where(F.trim("text") != "").withColumn("weight", F.greatest(F.lit(0.1), F.coalesce("weight", F.lit(1.0))))
    total = kept.groupBy("place_id").agg(F.sum("weight").alias("total"))
    found = phrase_matches(kept, phrases)
    by_doc = found.groupBy("place_id", "doc_id", "tag").agg(F.bool_or("vetoes").alias("veto"), F.bool_or(~F.col("vetoes")).alias("speaks"))
    weighed = by_doc.join(kept.select("place_id", "doc_id", "weight", "sentiment"), ["place_id", "doc_id"])
    by_tag = weighed.groupBy("place_id", "tag").agg(F.sum(F.when(F.col("speaks"), F.col("weight")).otherwise(0.0)).alias("w"), F.avg(F.when(F.col("speaks"), F.col("sentiment"))).alias("mean_sentiment"), F.bool_or("veto").alias("vetoed"))
    phrases_hit = found.where(~F.col("vetoes")).groupBy("place_id", "tag").agg(F.countDistinct("phrase").alias("n_phrases"))
    out = by_tag.join(phrases_hit, ["place_id", "tag"], "left").join(total, "place_id")
    return out.select("place_id", "tag", (F.col("w") / F.col("total")).alias("share"), "mean_sentiment", "vetoed", F.coalesce("n_phrases", F.lit(0)).alias("n_phrases"))


def text_tags(snippets: DataFrame, phrases: DataFrame) -> DataFrame:
    """(place_id, tag, share) of the rules that fire: enough share, enough sentiment, and no veto anywhere."""
    rules = phrases.groupBy("tag").agg(F.max("share").alias("least"), F.max("sentiment").alias("floor"))
    s = tag_shares(snippets, phrases).join(rules, "tag")
    ok = ~F.col("vetoed") & (F.col("n_phrases") > 0) & (F.col("share") >= F.col("least")) & (F.col("floor").isNull() | (F.col("mean_sentiment") >= F.col("floor")))
    return s.where(ok).select("place_id", "tag", F.round("share", 4).alias("share"))


#: Snippets that show why a tag was given, and their characters.
SAMPLES, SAMPLE_CHARS = 3, 220


def tag_samples(snippets: DataFrame, phrases: DataFrame) -> DataFrame:
    """(place_id, tag, samples): the first SAMPLES snippets, by doc_id, that speak for each tag, cut to SAMPLE_CHARS. They are cut before they are gathered."""
    kept = snippets.where(F.trim("text") != "")
    speaks = phrase_matches(kept, phrases).where(~F.col("vetoes")).select("place_id", "doc_id", "tag").distinct()
    w = Window.partitionBy("place_id", "tag").orderBy("doc_id")
    first = speaks.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLES)
    text = kept.select("place_id", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    return first.join(text, ["place_id", "doc_id"]).groupBy("place_id", "tag").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("s")).select("place_id", "tag", F.col("s.text").alias("samples"))


def merged_fields(base: Column, over: Column) -> Column:
    """A map of base's entries with over's in place of those of the same key."""
    kept = F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(over, k), F.lit(False)))
    return F.coalesce(F.map_concat(kept, over), base)


def price_tag(tier: Column) -> Column:
    out = None
    for t, name in C.PRICE_TAGS.items():
        out = F.when(tier == t, name) if out is None else out.when(tier == t, name)
    return out


def hours_tags(hours: Column) -> Column:
    """late-night (Friday or Saturday to 01:00 or later) and opens-early (any day by 08:30)."""
    late = lambda day: F.coalesce(F.exists(H.intervals(hours, F.lit(day)), lambda x: x["close"] >= C.LATE_CLOSE), F.lit(False))
    early = lambda day: F.coalesce(F.exists(H.intervals(hours, F.lit(day)), lambda x: x["open"] <= C.EARLY_OPEN), F.lit(False))
    any_early = early(0)
    for day in range(1, 7):
        any_early = any_early | early(day)
    return F.filter(F.array(F.when(late(4) | late(5), "late-night"), F.when(any_early, "opens-early")), lambda x: x.isNotNull())


def structural_tags(places: DataFrame) -> DataFrame:
    """(place_id, tag) from price, category and hours."""
    tags = F.concat(F.array_compact(F.array(price_tag(F.col("price_tier")), F.concat(F.lit("category:"), F.col("category")))), hours_tags(F.col("hours")))
    return places.select("place_id", F.explode(tags).alias("tag"))


def consensus_tags(places: DataFrame, signals: DataFrame) -> DataFrame:
    """(place_id, tag) that only several sources together show: highly-rated, hidden-gem and tourist-trap."""
    s = signals.groupBy("place_id").agg(
        F.max(F.when(F.col("source") == "google_places", F.col("review_count"))).alias("reviews"),
        F.max(F.when(F.col("source") == "reddit", F.col("sentiment"))).alias("sentiment"),
        F.max(F.when(F.col("source") == "reddit", F.col("mention_count"))).alias("mentions"),
        F.max(F.when(F.col("source") == "reddit", F.col("upvotes"))).alias("upvotes"),
        F.count_if(F.col("source") == "reddit").alias("reddit"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    enough = (z("reddit") > 0) & ((z("mentions") >= C.CONSENSUS_MENTIONS) | (z("upvotes") >= C.CONSENSUS_UPVOTES))
    gem = enough & (z("reviews") <= C.GEM_MAX_REVIEWS) & (z("sentiment") >= C.GEM_MIN_SENTIMENT)
    trap = enough & (z("reviews") >= C.TRAP_MIN_REVIEWS) & (z("sentiment") <= C.TRAP_MAX_SENTIMENT)
    tags = F.array_compact(F.array(F.when(F.col("score") >= C.HIGHLY_RATED, "highly-rated"), F.when(gem, "hidden-gem"), F.when(trap, "tourist-trap")))
    return places.select("place_id", "score").join(s, "place_id", "left").select("place_id", F.explode(tags).alias("tag"))


def settle(tags: Column, price_tier: Column, quiet: Column, lively: Column) -> Column:
    """Sorted tags without contradictions: cost by the price tier, mood by the larger share, secrets by crowds."""
    has = lambda t: F.array_contains(tags, t)
    q, v = F.coalesce(quiet, F.lit(0.0)), F.coalesce(lively, F.lit(0.0))
    both = has("quiet") & has("lively")
    drop = F.array_compact(
        F.array(
            F.when(has("budget") & has("pricey"), F.when(F.coalesce(price_tier, F.lit(0)) <= 2, "pricey").otherwise("budget")),
            F.when(both & (q >= v), "lively"),
            F.when(both & (v >= q), "quiet"),
            F.when(has("hidden-gem") & (has("tourist-trap") | has("touristy")), "hidden-gem"),
        )
    )
    return F.array_sort(F.array_distinct(F.array_except(tags, drop)))


def retag(places: DataFrame, signals: DataFrame, snippets: DataFrame, phrases: DataFrame, keywords: DataFrame) -> DataFrame:
    """(place_id, tags) of every place from all producers, contradictions settled."""
    by_text = text_tags(snippets, phrases)
    rows = by_text.select("place_id", "tag", "share").unionByName(structural_tags(places).unionByName(consensus_tags(places, signals)).unionByName(keywords.select("place_id", "tag")).withColumn("share", F.lit(None).cast("double")))
    share = lambda t: F.max(F.when(F.col("tag") == t, F.col("share"))).alias(t)
    sets = rows.groupBy("place_id").agg(F.collect_set("tag").alias("set"), share("quiet"), share("lively"))
    none = F.expr("CAST(array() AS array<string>)")
    return places.select("place_id", "price_tier").join(sets, "place_id", "left").select("place_id", settle(F.coalesce("set", none), F.col("price_tier"), F.col("quiet"), F.col("lively")).alias("tags"))
