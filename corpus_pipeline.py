"""A training-corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm.common import table
from placeweave.llm.decontaminate import drop_leaks
from placeweave.llm.jaccard_join import jaccard_classes
from placeweave.llm.language import keep_identified, train_on_documents
from placeweave.llm.line_dedup import dedup_lines
from placeweave.llm.pieces import encode_pieces
from placeweave.llm.queries import vocabulary
from placeweave.operators.graph import cut, few, fresh_path, release, remove


#: Share of a document's words that its language must have. Mixed documents below it are rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = LEAST_SHARE) -> DataFrame:
    """Rejects documents without letters and those of which no language has `least` of the words; sets lang to the prediction.

    Null and empty texts have no letters and go. The model is learned from the labelled rows of docs that are not held
    out; without any, no language is known and all rows go. Repeated rows are judged each; ties go to the first language.
    """
    return keep_identified(docs, train_on_documents(docs), least)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat in windows of three; a document that loses all its text goes, a null text stays.

    n_chars, where there is such a column, is counted anew. Rows equal in doc_id and text stay as one; the earlier doc_id
    keeps the lines. An empty table stays empty.
    """
    cleaned = dedup_lines(docs).where(F.col("text").isNull() | (F.trim("text") != ""))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of texts linked by five-word shingles at 0.8.

    Null and empty texts and rows without an id are linked with nothing and stay; rows that share the smallest id all stay.
    """
    others = jaccard_classes(docs, k=5, num=4, den=5).where("component_id <> doc_id").select("doc_id").distinct()
    others = few(cut(others))
    release(docs.sparkSession)
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or edited; null and empty texts stay, as all rows do without items."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left: (doc_id, n_tokens, ids); a null or empty text has none, repeated rows are encoded each."""
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language models, alignment and pieces are beyond SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, least: float = LEAST_SHARE) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote goes when the next one is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        found = stage(spark, docs, sf_dir, least) if stage is language_id else stage(spark, docs, sf_dir)
        found.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
