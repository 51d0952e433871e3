import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from placeweave.llm import pieces, token_counts, token_ids  # noqa: E402

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = ["", "Hello  world", "it's we'll they've <|endoftext|> x", "x'<|endoftext|>y", "  \n\n a\tb \x1c c", "日本語 テキスト　 é😀 ñandú", "x" * 700 + " " + "ab" * 300, "The queue. The queue.", "lead ", " trail", "<|startoftext|>Q"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, "another text of an id"), (None, "no id"), (99, None)]
SCHEMA = "doc_id long, text string, n_tokens string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", None) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def test_counts_are_the_library_s(docs, byte_bpe):
    got = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, BYTE, 8).collect())
    n = lambda t: len(byte_bpe.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((repr(i), len((t or "").encode()), n(t), n(t) > 8) for i, t in ROWS)


def test_every_prefix(byte_bpe):
    c = token_counts.counter(BYTE)
    for t in TEXTS:
        t = t[:120]
        assert c.prefix_counts(t) == [len(byte_bpe.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abteh's ll\n\té日1.,<|>")), max_size=40))
def test_any_text(text):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    c = token_counts.counter(BYTE)
    assert c.count(text) == len(lib.encode(text, add_special_tokens=False).ids)
    stored = c.prefix_counts(text)
    assert stored[-1] == c.count(text)
    cut = c.cut(text, 3)
    assert 0 <= cut <= len(text) and (c.count(text) > 3 or cut == len(text))


def test_budgets_from_stored_counts():
    counts = token_counts.counter(BYTE).prefix_counts("The queue is long")
    assert token_counts.answer(counts, 0) == 0 and token_counts.answer(counts, 99) == len("The queue is long")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=70))
def test_pack(values):
    control, data = token_ids.pack(np.array(values, np.uint32))
    assert token_ids.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_id_files(spark, docs, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_ids, "BLOCK_IDS", 40)
    lib, path = Tokenizer.from_file(WORD), str(tmp_path / "ids")
    token_ids.write_ids(docs, WORD, path, end_id=2)
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids + [2]
    got = token_ids.read_digests(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((repr(i), len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in ROWS)
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])])[:-1].tolist()
    whole = {r["doc_id"]: r["ids"] for r in token_ids.read_ids(spark, path).collect()}
    assert whole[1] == ids(TEXTS[1]) and whole[None] == ids("no id")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abteh's ll\n\trdvmLRE\u00e9\u65e51.,<|>\u2019\u0301\u00df\u00b2\u0130\u03a3\u00a0\u0085\x1c")), max_size=30), max_size=6))
def test_word_bpe_is_the_library(texts):
    import pyarrow as pa

    e = token_ids.encoder(WORD, 2)
    texts = [*texts, *TEXTS, None]
    found = list(e.encode(pa.array(texts, pa.string())))
    assert [f[0] for f in found] == [0]
    got = np.split(found[0][1], np.cumsum(found[0][2])[:-1])
    assert [x.tolist() for x in got] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_word_bpe_in_runs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_ids, "TOGETHER", 100)
    e = token_ids.encoder(WORD, 2)
    texts = [t for t in TEXTS for _ in range(3)]
    got = []
    for first, ids, n in e.encode(pa.array(texts, pa.string())):
        assert first == len(got)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_id_files_of_nothing(spark, tmp_path):
    token_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), WORD, str(tmp_path / "none"))
    assert token_ids.read_digests(spark, str(tmp_path / "none")).count() == 0


def test_pieces_are_the_library_s(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    encoded = pieces.encode_pieces(docs, PIECE)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in encoded.collect()) == sorted((repr(i), lib.encode(t or "")) for i, t in ROWS)
    assert sorted((repr(r["doc_id"]), r["text"]) for r in pieces.decode_pieces(encoded, PIECE).collect()) == sorted((repr(i), t or "") for i, t in ROWS)
    assert all(r["round_trip"] for r in pieces.piece_report(docs, PIECE).collect())


def test_words_folded_together_or_alone():
    e, rng = pieces.encoder(PIECE), random.Random(4)
    words = sorted({pieces.SPACE * rng.randint(0, 3) + "".join(rng.choice("abehinst") for _ in range(rng.randint(0, 30))) for _ in range(300)} - {""})
    for w, ids in zip(words, e.fold(words), strict=True):
        assert ids.tolist() == e.merged(w).tolist()


def test_lattice_in_rows(spark):
    e, rng = pieces.encoder(PIECE), random.Random(8)
    words = sorted({pieces.SPACE + "".join(rng.choice("aehinrstdlñ") for _ in range(rng.randint(0, 12))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in [*words, "", words[0]]] + [(None,)], "word string")
    got = {r["word"]: r["pieces"] for r in pieces.fold_words(df, pieces.piece_table(spark, PIECE)).collect()}
    assert set(got) == set(words)
    for w, ids in zip(words, e.fold(words), strict=True):
        assert [e.ids[p] for p in got[w]] == ids.tolist()
