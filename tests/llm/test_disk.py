"""Texts are large, ids are small: what is shuffled, and so lies on disk, must not hold the texts."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from placeweave.llm.jaccard_join import jaccard_classes  # noqa: E402


@pytest.fixture
def docs(spark):
    """Long words, so that texts weigh more than their shingles; every fourth text is a near copy."""
    rng = random.Random(8)
    texts = [[f"{rng.getrandbits(400):x}" for _ in range(150)] for _ in range(120)]
    for i in range(0, 120, 4):
        texts[i] = texts[i + 1][:-1] + [f"{rng.getrandbits(400):x}"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # tables of ids are too large for it, as they are over gigabytes
    yield spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_bytes(spark, run):
    def total():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.length()))

    before = total()
    return run(), total() - before


def test_jaccard_classes_do_not_shuffle_texts(spark, docs):
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    rows, moved = shuffled_bytes(spark, lambda: jaccard_classes(docs, 4, 85, 100).collect())
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i - i % 4 if i % 4 < 2 else i for i in range(120)}
    assert moved < 0.6 * size


def test_near_duplicates_do_not_shuffle_texts(spark, docs):
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    rows, moved = shuffled_bytes(spark, lambda: corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert sorted(r["doc_id"] for r in rows) == [i for i in range(120) if i % 4 != 1]
    assert moved < 0.6 * size


@pytest.mark.parametrize("stage", [True, False])
def test_large_unlike_sets_are_not_verified(spark, docs, stage):
    """Each two of the texts share one passage of eleven, so no shingle is rare and all pairs are candidates."""
    rng = random.Random(9)
    passage = {(i, j): " ".join(f"{rng.getrandbits(120):x}" for _ in range(500)) for i in range(12) for j in range(i + 1, 12)}
    texts = [" ".join(passage[min(i, j), max(i, j)] for j in range(12) if j != i) for i in range(12)]
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4).cache()
    table.count()
    run = (lambda: corpus_pipeline.near_duplicates(spark, table, "").collect()) if stage else (lambda: jaccard_classes(table, 4, 85, 100).collect())
    rows, moved = shuffled_bytes(spark, run)
    assert sorted(r["doc_id"] for r in rows) == [*range(12)]
    assert moved < sum(map(len, texts))
