"""Queries over names, hours, phrases, evidence and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave import config as C
from placeweave import views as V
from placeweave.functions import hours as H
from placeweave.functions import text as T
from placeweave.operators import keywords as K
from placeweave.operators import resolve, tagging

#: Rules over words that the corpus has, so that the oracle sees hits; the real rules are held by tests.
CORPUS_RULES = (tagging.Rule("thready", ("the", "of the", "and"), ("the queue",), 0.30), tagging.Rule("waiting", ("queue", "in the"), (), 0.10, -0.5), tagging.Rule("denied", ("this", "is"), ("of is",), 0.05))


def name_key(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "customer").select("c_custkey", T.name_key(F.concat(F.lit("The Café "), F.col("c_name"), F.lit(" de La Museo"))).alias("key"))


def name_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return V.places(spark, sf).select("place_id", F.array_join(T.distinctive_tokens(T.name_key(F.col("name"))), " ").alias("anchors"))


def accents(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", F.sha1(T.strip_accents(F.col("text"))).alias("digest"))


def trigram_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keyed = V.places(spark, sf).select("place_id", "name", T.name_key(F.col("name")).alias("key"))
    sim = T.jaccard(T.trigrams(F.col("key")), T.trigrams(F.lit("small ring")))
    kept = keyed.withColumn("sim", sim).where((F.col("key") == "small ring") | F.lower("name").contains("small ring") | (F.col("sim") > 0.3))
    return kept.select("place_id", F.round("sim", 6).alias("sim"))


def evidence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.evidence_rows(V.evidence(spark, sf)).select("place_id", "content_hash", "cnt", "weight")


def synthetic_ids(spark: SparkSession, sf: str) -> DataFrame:
    return V.places(spark, sf).select("place_id", T.synthetic_id("blog", F.col("city"), F.lower("name")).alias("source_place_id"))


def phrase_hits(spark: SparkSession, sf: str) -> DataFrame:
    found = tagging.phrase_matches(V.evidence(spark, sf), tagging.phrase_table(spark, CORPUS_RULES))
    return found.where(~F.col("vetoes")).select("doc_id", "tag", "phrase", "hits")


def _snippets(spark: SparkSession, sf: str) -> DataFrame:
    return V.evidence(spark, sf).withColumn("sentiment", (F.col("doc_id") % 21 - 10) / 10.0)


def tag_share(spark: SparkSession, sf: str) -> DataFrame:
    out = tagging.tag_shares(_snippets(spark, sf), tagging.phrase_table(spark, CORPUS_RULES))
    return out.select("place_id", "tag", F.round("share", 6).alias("share"), F.round("mean_sentiment", 6).alias("mean_sentiment"), "vetoed")


def text_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.text_tags(_snippets(spark, sf), tagging.phrase_table(spark, CORPUS_RULES)).select("place_id", "tag")


def tfidf_keywords(spark: SparkSession, sf: str) -> DataFrame:
    out = K.keywords(V.evidence(spark, sf), V.places(spark, sf), {"the", "and"}, least=0.05)
    return out.select("place_id", "term", F.round("weight", 6).alias("weight"), "rank")


def structural_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.structural_tags(V.hours_of(V.places(spark, sf)))


def consensus_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.consensus_tags(V.scored_places(spark, sf), V.signals(spark, sf))


def retag(spark: SparkSession, sf: str) -> DataFrame:
    """All producers together; its parts have oracles of their own."""
    places = V.hours_of(V.scored_places(spark, sf))
    evidence = _snippets(spark, sf)
    words = K.keywords(evidence, places, {"the", "and"})
    return tagging.retag(places, V.signals(spark, sf), evidence, tagging.phrase_table(spark, (*tagging.RULES, *CORPUS_RULES)), words).select("place_id", F.array_join("tags", ",").alias("tags"))


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return V.hours_of(V.places(spark, sf)).select("place_id", "hours", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))


def open_intervals(spark: SparkSession, sf: str) -> DataFrame:
    days = _days(spark, sf)
    return days.select("place_id", "weekday", F.explode(H.intervals(F.col("hours"), F.col("weekday"))).alias("x")).select("place_id", "weekday", F.col("x.open").alias("open_min"), F.col("x.close").alias("close_min"))


def open_during(spark: SparkSession, sf: str) -> DataFrame:
    days = _days(spark, sf)
    return days.select("place_id", "weekday", H.open_during(F.col("hours"), F.col("weekday"), F.lit(600), F.lit(705)).alias("fits"))


def earliest_open(spark: SparkSession, sf: str) -> DataFrame:
    days = _days(spark, sf)
    return days.select("place_id", "weekday", H.earliest_open(F.col("hours"), F.col("weekday"), F.lit(540)).alias("minute"))


def effective_hours(spark: SparkSession, sf: str) -> DataFrame:
    hours, assumed = H.effective(F.col("hours"), F.col("category"))
    p = V.hours_of(V.places(spark, sf)).select("place_id", hours.alias("h"), assumed.alias("assumed"))
    return p.select("place_id", "assumed", F.array_min(H.intervals(F.col("h"), F.lit(2)))["open"].alias("opens"))


def comment_flatten(spark: SparkSession, sf: str) -> DataFrame:
    from placeweave.sources.comments import thread_depths

    turns = V.table(spark, sf, "conversations")
    return thread_depths(turns.select("conv_id", "turn", (F.col("turn") - 1).alias("parent"))).select("conv_id", "turn", "depth")


def signal_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    mentions = e.select(
        F.col("user_id").alias("place_id"), F.col("event_type").alias("source"), F.col("event_id").alias("seq"), ((F.col("event_id") % 201 - 100) / 100.0).alias("sentiment"), (F.col("event_id") % 50).alias("upvotes"),
        F.lit(1).alias("mention_count"), (F.col("event_id") % 977).alias("thread_score"), F.lit(1).alias("review_count"), F.col("ts").alias("observed_at"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), F.col("event_id"))).alias("url"),
    )
    out = resolve.fold_signals(mentions)
    return out.select("place_id", "source", "mention_count", "upvotes", "thread_score", "review_count", "merged_mentions", F.round("sentiment", 3).alias("sentiment"), F.unix_timestamp("observed_at").alias("observed_s"), "url")


def tag_samples(spark: SparkSession, sf: str) -> DataFrame:
    out = tagging.tag_samples(V.evidence(spark, sf), tagging.phrase_table(spark, CORPUS_RULES))
    return out.select("place_id", "tag", F.size("samples").cast("long").alias("n"), F.sha1(F.array_join("samples", "|")).alias("digest"))


def map_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = V.signals(spark, sf)
    base = F.create_map(F.lit("review_count"), F.col("review_count").cast("string"), F.lit("kind"), F.lit("base"))
    over = F.when(F.col("source") == "reddit", F.create_map(F.lit("upvotes"), F.col("upvotes").cast("string"), F.lit("kind"), F.lit("extra")))
    merged = tagging.merged_fields(base, over)
    return s.select("place_id", "source", merged["review_count"].alias("review_count"), merged["kind"].alias("kind"), F.try_element_at(merged, F.lit("upvotes")).alias("upvotes"))


QUERIES = {
    f.__name__: f
    for f in (name_key, name_anchors, accents, trigram_lookup, evidence_dedup, synthetic_ids, phrase_hits, tag_share, text_tags, tfidf_keywords, structural_tags, consensus_tags, retag, open_intervals, open_during, earliest_open, effective_hours, comment_flatten, signal_fold, tag_samples, map_merge)
}


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def key_sql(name: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents({name})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    return f"array_to_string(CASE WHEN len(list_filter({words}, lambda w: NOT list_contains({_list(C.NOISE_TOKENS)}, w))) > 0 THEN list_filter({words}, lambda w: NOT list_contains({_list(C.NOISE_TOKENS)}, w)) ELSE {words} END, ' ')"


def anchors_sql(key: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({key}, ' '), lambda w: length(w) >= 4 AND NOT list_contains({_list(C.GENERIC_TOKENS)}, w))))"


def grams_sql(key: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array({key}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both}::DOUBLE / nullif(len({a}) + len({b}) - {both}, 0), 0.0)"


_TOKENS = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}_'']+|[.!?;:])', 1)"
_PHRASES = ", ".join("('{}', '{}', {}, {}, {}, {})".format(r.tag, p, _list(tuple(p.split())), v, r.share, "NULL" if r.sentiment is None else r.sentiment) for r in CORPUS_RULES for v, ps in (("false", r.include), ("true", r.exclude)) for p in ps)
_ENDS = _list((*T.NEGATORS, *T.CLAUSE_ENDS))
_HITS = f"""
v_tokens AS (SELECT place_id, doc_id, weight, (doc_id % 21 - 10) / 10.0::DOUBLE AS sentiment, {_TOKENS} AS t FROM v_evidence),
v_phrase(tag, phrase, words, vetoes, least, floor) AS (VALUES {_PHRASES}),
v_at AS (SELECT place_id, doc_id, weight, sentiment, tag, phrase, vetoes, t, unnest(list_filter(range(0, len(t) - len(words) + 1), lambda i: t[i + 1 : i + len(words)] = words)) AS i FROM v_tokens, v_phrase),
v_near AS (SELECT *, list_filter(list_reverse(t[greatest(0, i - 6) + 1 : i]), lambda w: list_contains({_ENDS}, w))[1] AS w FROM v_at),
v_hit AS (SELECT place_id, doc_id, any_value(weight) AS weight, any_value(sentiment) AS sentiment, tag, phrase, any_value(vetoes) AS vetoes, count(*) AS hits FROM v_near WHERE vetoes OR NOT coalesce(list_contains({_list(T.NEGATORS)}, w), false) GROUP BY place_id, doc_id, tag, phrase),
v_doc AS (SELECT place_id, doc_id, tag, any_value(weight) AS weight, any_value(sentiment) AS sentiment, bool_or(vetoes) AS veto, bool_or(NOT vetoes) AS speaks FROM v_hit GROUP BY place_id, doc_id, tag),
v_share AS (SELECT place_id, tag, sum(CASE WHEN speaks THEN d.weight ELSE 0 END) / any_value(total) AS share, avg(CASE WHEN speaks THEN sentiment END) AS mean_sentiment, bool_or(veto) AS vetoed, bool_or(speaks) AS any_hit
  FROM v_doc d JOIN (SELECT place_id, sum(weight) AS total FROM v_evidence WHERE trim(text) <> '' GROUP BY place_id) USING (place_id) GROUP BY place_id, tag)"""
_DAYS = "(SELECT p.*, CAST(d AS INTEGER) AS weekday FROM v_place p, range(7) r(d))"
_STRUCT = """
SELECT place_id, tag FROM (
  SELECT place_id, unnest(list_filter([['budget', 'mid-range', 'upscale', 'splurge'][price_tier], 'category:' || category,
    CASE WHEN close_min >= 1500 AND open_min IS NOT NULL THEN 'late-night' END, CASE WHEN open_min <= 510 THEN 'opens-early' END], lambda x: x IS NOT NULL)) AS tag FROM v_place)"""

ORACLE_SQL = {
    "name_key": f"SELECT c_custkey, {key_sql(chr(39) + 'The Café ' + chr(39) + ' || c_name || ' + chr(39) + ' de La Museo' + chr(39))} AS key FROM customer",
    "name_anchors": V.with_views(f"SELECT place_id, array_to_string({anchors_sql('key')}, ' ') AS anchors FROM (SELECT place_id, {key_sql('name')} AS key FROM v_place)", V.PLACES),
    "accents": "SELECT doc_id, sha1(strip_accents(text)) AS digest FROM documents",
    "trigram_lookup": V.with_views(f"SELECT place_id, round(sim, 6) AS sim FROM (SELECT place_id, name, key, {jaccard_sql(grams_sql('key'), grams_sql(chr(39) + 'small ring' + chr(39)))} AS sim FROM (SELECT place_id, name, {key_sql('name')} AS key FROM v_place)) WHERE key = 'small ring' OR lower(name) LIKE '%small ring%' OR sim > 0.3", V.PLACES),
    "evidence_dedup": V.with_views("SELECT place_id, sha256(lower(trim(text))) AS content_hash, count(*) AS cnt, arg_min(weight, doc_id) AS weight FROM v_evidence WHERE trim(text) <> '' GROUP BY 1, 2", V.EVIDENCE),
    "synthetic_ids": V.with_views("SELECT place_id, 'blog:' || substring(sha1(city || '|' || lower(name)), 1, 20) AS source_place_id FROM v_place", V.PLACES),
    "phrase_hits": V.with_views("SELECT doc_id, tag, phrase, CAST(hits AS INTEGER) AS hits FROM v_hit WHERE NOT vetoes", V.EVIDENCE, _HITS),
    "tag_share": V.with_views("SELECT place_id, tag, round(share, 6) AS share, round(mean_sentiment, 6) AS mean_sentiment, vetoed FROM v_share", V.EVIDENCE, _HITS),
    "text_tags": V.with_views("SELECT place_id, tag FROM v_share JOIN (SELECT tag, max(least) AS least, max(floor) AS floor FROM v_phrase GROUP BY tag) USING (tag) WHERE NOT vetoed AND any_hit AND share >= least AND (floor IS NULL OR mean_sentiment >= floor)", V.EVIDENCE, _HITS),
    "tfidf_keywords": V.with_views(
        """SELECT place_id, term, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY weight DESC, term) AS rank FROM (
  SELECT place_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY place_id)) AS weight FROM (
    SELECT place_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w
    FROM (SELECT place_id, term, count(*) AS tf FROM v_term GROUP BY 1, 2) JOIN (SELECT term, count(DISTINCT place_id) AS df FROM v_term GROUP BY 1) USING (term), (SELECT count(DISTINCT place_id) AS n FROM v_evidence WHERE trim(text) <> '')
    WHERE df >= 2 AND df <= 0.5 * n)) k
  WHERE weight >= 0.05 AND regexp_full_match(term, '[a-zA-Záéíóúñü]{4,}') AND NOT EXISTS (SELECT 1 FROM v_place p WHERE p.place_id = k.place_id AND list_contains(regexp_split_to_array(lower(p.name), '[\\s\\-]+'), k.term))
) WHERE rank <= 4""",
        V.PLACES, V.EVIDENCE, "v_term AS (SELECT place_id, term FROM (SELECT place_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_][\\p{L}\\p{N}_''\\-]*[\\p{L}\\p{N}_])', 1)) AS term FROM v_evidence) WHERE term NOT IN ('the', 'and'))",
    ),
    "structural_tags": V.with_views(_STRUCT, V.PLACES),
    "consensus_tags": V.with_views(
        """SELECT place_id, unnest(list_filter([CASE WHEN score >= 68 THEN 'highly-rated' END,
  CASE WHEN r > 0 AND (m >= 2 OR u >= 100) AND coalesce(g, 0) <= 2500 AND coalesce(s, 0) >= 0.35 THEN 'hidden-gem' END,
  CASE WHEN r > 0 AND (m >= 2 OR u >= 100) AND coalesce(g, 0) >= 40000 AND coalesce(s, 0) <= -0.15 THEN 'tourist-trap' END], lambda x: x IS NOT NULL)) AS tag
FROM v_full LEFT JOIN (SELECT place_id, max(review_count) FILTER (WHERE source = 'google_places') AS g, max(sentiment) AS s, max(mention_count) AS m, max(upvotes) AS u, count(*) FILTER (WHERE source = 'reddit') AS r FROM v_signal GROUP BY 1) USING (place_id)""",
        V.PLACES, V.SIGNALS, V.SCORES,
    ),
    "open_intervals": V.with_views(f"SELECT place_id, weekday, open_min, CASE WHEN close_min % 1440 <= open_min THEN close_min % 1440 + 1440 ELSE close_min END AS close_min FROM {_DAYS} WHERE open_min IS NOT NULL AND weekday <> closed_day", V.PLACES),
    "open_during": V.with_views(f"SELECT place_id, weekday, CASE WHEN open_min IS NULL THEN true WHEN weekday = closed_day THEN false ELSE open_min <= 600 AND 705 <= close_min END AS fits FROM {_DAYS}", V.PLACES),
    "earliest_open": V.with_views(f"SELECT place_id, weekday, CASE WHEN open_min IS NULL THEN 540 WHEN weekday <> closed_day AND close_min > 540 THEN greatest(open_min, 540) END AS minute FROM {_DAYS}", V.PLACES),
    "effective_hours": V.with_views("SELECT place_id, open_min IS NULL AND category NOT IN ('hotel', 'other') AS assumed, CASE WHEN open_min IS NOT NULL THEN CASE WHEN closed_day <> 2 THEN open_min END ELSE CASE category WHEN 'restaurant' THEN 780 WHEN 'cafe' THEN 510 WHEN 'bar' THEN 1080 WHEN 'nightlife' THEN 1380 WHEN 'museum' THEN 600 WHEN 'shopping' THEN 600 WHEN 'attraction' THEN 540 WHEN 'park' THEN 420 END END AS opens FROM v_place", V.PLACES),
    "comment_flatten": "WITH RECURSIVE t AS (SELECT conv_id, turn, 0 AS depth FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1) UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, turn, CAST(depth AS INTEGER) AS depth FROM t",
    "signal_fold": """SELECT place_id, source, mention_count, upvotes, thread_score, review_count, merged_mentions, observed_s, url,
  round(CASE WHEN len(items) = 1 THEN items[1].s ELSE list_reduce(items, lambda a, x: struct_pack(s := round_even((a.s * (a.u + 1) + x.s * (x.u + 1)) / (a.u + x.u + 2), 4)::DOUBLE, u := a.u + x.u)).s END, 3) AS sentiment
FROM (SELECT user_id AS place_id, event_type AS source, count(*) AS mention_count, CAST(sum(event_id % 50) AS BIGINT) AS upvotes, max(event_id % 977) AS thread_score, count(*) AS review_count, CAST(count(*) AS INTEGER) AS merged_mentions,
  CAST(floor(epoch(max(ts))) AS BIGINT) AS observed_s, first('u' || event_id ORDER BY event_id) FILTER (WHERE event_id % 3 = 0) AS url, list(struct_pack(s := (event_id % 201 - 100) / 100.0::DOUBLE, u := event_id % 50) ORDER BY event_id) AS items FROM events GROUP BY 1, 2)""",
    "tag_samples": V.with_views("SELECT place_id, tag, count(*) AS n, sha1(string_agg(substring(text, 1, 220), '|' ORDER BY doc_id)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY place_id, tag ORDER BY doc_id) AS r FROM v_doc WHERE speaks) JOIN v_evidence USING (place_id, doc_id) WHERE r <= 3 GROUP BY 1, 2", V.EVIDENCE, _HITS),
    "map_merge": V.with_views("SELECT place_id, source, CAST(review_count AS VARCHAR) AS review_count, CASE WHEN source = 'reddit' THEN 'extra' ELSE 'base' END AS kind, CAST(upvotes AS VARCHAR) AS upvotes FROM v_signal", V.SIGNALS),
}
