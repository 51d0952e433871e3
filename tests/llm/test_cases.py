"""Cases that every operator must bear: empty tables, columns with clashing names, very long texts, ties, nulls in any column."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from placeweave.llm import decontaminate, html_text, jaccard_join, language, licenses, line_dedup, pieces, token_counts, token_ids, topk  # noqa: E402

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": "the and with house green water", "bb": "der und mit haus grün wasser"}


def say(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(31)
    return spark.createDataFrame([(i, say(rng, lang, 40), lang, "s", 1) for i, lang in enumerate(["aa", "bb"] * 25)], DOCUMENTS)


def test_empty_tables(spark, corpus):
    docs, pages = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    model = language.train_on_documents(corpus)
    assert token_counts.token_counts(docs, BYTE).count() == 0
    assert html_text.main_text(pages).count() == 0
    assert pieces.encode_pieces(docs, PIECE).count() == 0 and pieces.piece_report(docs, PIECE).count() == 0
    assert language.identify(docs, model).count() == 0 and language.keep_identified(docs, model).count() == 0
    assert language.identify(docs, language.train_on_documents(docs)).count() == 0
    assert line_dedup.line_report(docs).count() == 0 and licenses.licence_report(docs).count() == 0
    assert decontaminate.drop_leaks(docs, items).count() == 0 and decontaminate.drop_leaks(corpus, items).count() == 50


def test_language_with_clashing_columns_and_long_texts(spark, corpus):
    rng = random.Random(32)
    model = language.train_on_documents(corpus)
    half = [(1, say(rng, "bb", 150_000) + " " + say(rng, "aa", 50_000)), (2, say(rng, "aa", 30)), (2, say(rng, "bb", 30)), (3, "x" * 400_000), (4, " \n" * 200_000)]
    docs = spark.createDataFrame([(*r, "p", 0.1, "q", 1, True) for r in half], "doc_id long, text string, lang_pred string, score double, spans string, n_words long, held_out boolean")
    got = sorted((r["doc_id"], r["lang_pred"], r["n_words"]) for r in language.identify(docs, model).collect())
    assert [g for g in got if g[0] != 3] == [(1, "bb", 200_000), (2, "aa", 30), (2, "bb", 30), (4, "und", 0)]
    long = language.identify(docs, model).where("doc_id = 1").first()
    assert 0.74 < long["score"] < 0.76 and [s["lang"] for s in long["spans"]] == ["bb", "aa"]


def test_language_ties_go_to_the_first(spark):
    """Two languages of the same words: every word scores alike, so the first in alphabetical order wins, at every size."""
    rows = [(i, "same words here", lang, None, None) for i, lang in enumerate(["zz", "mm"] * 20)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    held = docs.select("doc_id", "lang", language.held_out(F.col("doc_id")).alias("h")).where("NOT h").groupBy("lang").count().collect()
    least = min(r["count"] for r in held)
    trained = [r for lang in ("zz", "mm") for r in [x for x in docs.where(~language.held_out(F.col("doc_id"))).collect() if x["lang"] == lang][:least]]
    model = language.train_on_documents(spark.createDataFrame(trained, DOCUMENTS))
    assert {r["lang_pred"] for r in language.identify(docs, model).collect()} == {"mm"}


def test_top_k_with_clashing_columns_and_repeated_rows(spark):
    x = np.array([[1, 0], [1, 0], [0, 1], [2, 2], [1, 0]])
    ids = [0, 20, 3, 4, 4]
    rows = [(i, (v / 64).tolist(), 7, 7, 7, "s") for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score long, query_id long, v string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(topk.integer_vectors(df), F.col("vec_id") % 20 == 0, 3).collect())
    assert got == [(0, 1, 4, 2), (0, 2, 4, 1), (0, 3, 20, 1), (20, 1, 4, 2), (20, 2, 0, 1), (20, 3, 4, 1)]


def test_decontamination_with_clashing_columns_and_long_texts(spark):
    rng = random.Random(33)
    item = " ".join(f"w{i}" for i in range(25))
    body = " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(200_000))
    docs = spark.createDataFrame([(1, body + " " + item, 5, "a", "b"), (2, body, 5, None, None), (None, item, None, None, None), (3, None, None, None, None)], "doc_id long, text string, item_id long, gram string, version string")
    bench = spark.createDataFrame([(9, item, 1, "x", 3, "y"), (9, item, 1, "x", 3, "y"), (None, item, 1, "x", 3, "y")], "item_id long, text string, doc_id long, version string, pos int, item string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["end_word"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 9): (1.0, 200_025), (None, 9): (1.0, 25)}
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_licences_that_tie_are_all_hits(spark):
    """A line equal to templates of two licences, or repeated lines and rows: one hit for each line, row and licence."""
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(1, f"{line}\n{line}", "l", 1), (1, f"{line}\n{line}", "l", 1), (2, line, None, None)], "doc_id long, text string, license string, line int")
    got = sorted((r["doc_id"], r["license"], r["line"]) for r in licenses.licence_hits(docs).where("line >= 0").collect())
    assert got == [(1, "MIT", 0), (1, "MIT", 0), (1, "MIT", 1), (1, "MIT", 1), (2, "MIT", 0)]


def test_jaccard_with_clashing_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d e", "x", 1, None), (1, "A  b c d\te", "x", 1, None), (3, "z " * 100_000, "x", 1, None)], "doc_id long, text string, chain string, component_id long, n_shingles long")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, 4, 85, 100).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]


def test_tokens_with_clashing_columns_and_long_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    text = " ".join(str(i) for i in range(60_000)) + "y" * 20_000
    docs = spark.createDataFrame([(1, text, 3, None), (2, None, 3, None)], "doc_id long, text string, n_bytes long, start string")
    n = lambda path: len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, BYTE).collect()) == [(1, len(text), n(BYTE)), (2, 0, 0)]
    token_ids.write_ids(docs, WORD, str(tmp_path / "long"), end_id=2)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_ids.read_digests(spark, str(tmp_path / "long")).collect())
    assert got == [(1, 0, n(WORD) + 1), (2, n(WORD) + 1, 1)]


def test_pipeline_of_nothing_and_of_nulls(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None), (1, None, None, None, None), (2, "", "aa", None, 0), (2, "12 %", None, None, None)])):
        spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert pipeline.run(spark, str(tmp_path / name)).count() == 0


def test_pipeline_stages_keep_columns_and_null_rows(spark, tmp_path):
    """Each filtering stage by itself: columns as they came, also without n_chars and with others; nulls and repeated rows stay."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "x", "k l m n o p q"), (1, None, None), (2, "x", ""), (3, "x", "k l m n o p r s t"), (3, "x", "k l m n o p r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, component_id string, text string")
    for stage in (pipeline.near_duplicates, pipeline.decontamination):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    out = pipeline.line_dedup(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(repr(r["doc_id"]) for r in out.collect()) == ["1", "3", "3", "None"]
