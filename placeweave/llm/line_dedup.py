"""Line dedup by overlapping three-line windows, in DataFrame functions only (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, h, g): two independent 64-bit hashes of every window of consecutive lines that isn't blank throughout."""
    blank = lambda x: F.trim(x) == ""
    one = docs.select("doc_id", F.xxhash64("text").alias("version"), _lines(F.col("text")).alias("x")).where(F.size("x") >= WINDOW)
    keyed = one.select("doc_id", "version", F.transform("x", lambda x: F.when(blank(x), F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("a"), F.transform("x", lambda x: F.when(blank(x), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit("second"), x))).alias("b"))
    at = lambda c, i: F.element_at(c, i + 1)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("a") - WINDOW),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*(at(F.col("a"), i + k) for k in range(WINDOW))).alias("h"), F.xxhash64(*(at(F.col("b"), i + k) for k in range(WINDOW))).alias("g"), F.greatest(*(F.abs(at(F.col("a"), i + k) % 2**62) for k in range(WINDOW))).alias("any")),
    )
    return keyed.select("doc_id", "version", F.inline(windows)).where(F.col("any") > 0).drop("any")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, version, starts): where a document has windows that occur before, by (doc_id, version, position).

    A window's occurrences meet as their minimum, pre-aggregated before the shuffle; the join back is on exchanges of its
    own, so that the rows of a very common window are split over tasks.
    """
    windows = _windows(docs)
    first = windows.groupBy("h", "g").agg(F.min(F.struct("doc_id", "version", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    third = lambda df: df.withColumn("k", F.xxhash64("h"))  # noqa: E731  keeps the aggregate's own partitioning from serving the join
    later = third(windows).join(third(first), ["h", "g", "k"]).where(F.struct("doc_id", "version", "pos") > F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("starts"))


def _marked(docs: DataFrame) -> DataFrame:
    """(row, lines, kept): each row of docs whole, its lines, and the positions that stay; kept is null where all do."""
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    starts = repeated_starts(texts).select(F.col("doc_id").alias("id"), F.col("version").alias("of"), "starts")
    row = docs.select(F.struct("*").alias("row"))
    # a document has one row of starts at most: they are hashed, and whole texts aren't sorted
    joined = row.join(starts.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("of")), "left")
    lines = F.coalesce(_lines(F.col("row.text")), F.array().cast("array<string>"))
    covered = F.flatten(F.transform("starts", lambda s: F.array(*(s + k for k in range(WINDOW)))))
    kept = F.when(F.col("starts").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered))
    return joined.select("row", lines.alias("lines"), F.array_sort(kept).alias("kept"))


def _clean(row: str = "row") -> Column:
    return F.when(F.col("kept").isNull(), F.col(f"{row}.text")).otherwise(F.array_join(F.transform("kept", lambda i: F.element_at("lines", i + 1)), "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the later occurrences of repeated three-line windows cut out of `text`; columns, order of lines and rows stay.

    Occurrences are ordered by doc_id (null first), then by a hash of the text, then by position; the first stays and the
    lines that any later one covers go. Every line that goes is thus still there in an earlier place. Lines are compared
    exactly, those of blanks only as equal; windows of blank lines are no windows; texts of fewer than three lines have
    none. A null text stays null, a text of which all lines go becomes empty. Rows equal in doc_id and text count as one
    document and are all kept. Any other columns, whatever their names, pass through; an empty table stays empty.
    """
    out = _marked(docs)
    return out.select(*(_clean().alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of dedup_lines; n_lines counts the lines before, 0 for a null text."""
    n = F.size("lines").cast("long")
    removed = F.when(F.col("kept").isNull(), F.lit(0).cast("long")).otherwise(n - F.size("kept"))
    return _marked(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), _clean().alias("text"), n.alias("n_lines"), removed.alias("n_removed"))


LINE_REPORT_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p
  FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT doc_id, p, line, CASE WHEN trim(line) = '' THEN '' ELSE line END AS x FROM l
), w AS (
  SELECT doc_id, p, x AS a, lead(x, 1) OVER d AS b, lead(x, 2) OVER d AS c FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS occurrence
  FROM w WHERE c IS NOT NULL AND NOT (a = '' AND b = '' AND c = '')
), gone AS (
  SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r WHERE occurrence > 1
), t AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (WHERE g.p IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id
)
SELECT d.doc_id, t.text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
