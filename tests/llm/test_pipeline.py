"""The pipeline's stages against brute force on a small corpus."""

import random

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_documents import brute_classes, brute_lines  # noqa: E402


def test_pipeline(spark, tmp_path):
    import sentencepiece

    rng = random.Random(12)
    words = {"en": "the and with house green water stone over under thing", "de": "der und mit haus grün wasser stein über unter ding"}
    line = lambda x, n=25: " ".join(rng.choice(words[x].split()) for _ in range(n))
    docs = [(i, "\n".join(line("en" if i % 2 else "de") for _ in range(4)), "en" if i % 2 else "de") for i in range(40)]
    item = " ".join(f"secret{i}" for i in range(24))
    docs += [(100, docs[3][1], "en"), (101, docs[4][1].split("\n")[0] + "\n" + docs[4][1].split("\n")[1], "de"), (102, line("en", 60), "en"), (104, line("en") + " " + item, "en"), (105, "%%% 12", "en"), (106, None, "en")]
    docs += [(103, dict((d[0], d[1]) for d in docs)[102] + " stone", "en")]
    rows = [(i, t, x, "s", len(t or "")) for i, t, x in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(i, t) for i, t, _ in docs if i not in (105, 106)]
    left = [(i, t) for i, t in brute_lines(left).items() if t.strip()]
    classes = brute_classes(left, 5, 4, 5)
    left = [(i, t) for i, t in left if classes[i][1] == i and item not in t]
    assert 100 not in dict(left) and 103 not in dict(left) and 102 in dict(left)
    lib = sentencepiece.SentencePieceProcessor(model_file=pipeline.vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["ids"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: lib.encode(t) for i, t in left}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
