"""Registered queries of the training-data operators, by name, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm.common import table
from placeweave.llm.decontaminate import leaks
from placeweave.llm.html_text import main_text
from placeweave.llm.jaccard_join import jaccard_classes
from placeweave.llm.language import held_out, identify, train_on_documents
from placeweave.llm.licenses import licence_report, report_sql
from placeweave.llm.line_dedup import LINE_REPORT_SQL, line_report
from placeweave.llm.pieces import piece_report
from placeweave.llm.token_counts import token_counts
from placeweave.llm.token_ids import read_digests, write_ids
from placeweave.llm.topk import exact_top_k, integer_vectors
from placeweave.operators.graph import fresh_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "end_word")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path, end_id=2)
    return read_digests(spark, path)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, k=20)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_report(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train_on_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", F.size("spans").alias("n_spans"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_counts": op3_token_counts,
    "op4_token_ids": op4_token_ids,
    "op5_html_text": op5_html_text,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": LINE_REPORT_SQL,
    "op7_license_scan": report_sql(),
    "op8_exact_top_k": OP8_SQL,
}
