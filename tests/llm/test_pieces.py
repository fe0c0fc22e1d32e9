"""SentencePiece by suffix array against the library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from graphloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return pieces.load(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def check(texts, vocab, library):
    ids, at = pieces.encode(texts, vocab)
    want = library.encode(texts, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert pieces.decode(ids, at, vocab).to_pylist() == [library.decode(w) for w in want]


HARD = ["", "a", " ", "  ", "   x  y", "▁▁ ▁a", "\n\n", "héllo 世界 🤗🤗 ok", "<0x0A> <s> </s> <unk>", "▁", "日本語のテキスト", "\0\x7f", "the" * 500, "ab" * 700 + " x", " " * 900 + "z", "a" * 3000]


def test_hard_texts(vocab, library):
    check(HARD, vocab, library)
    check([" " * k + "the" + " " * (40 - k) + "▁" for k in range(40)], vocab, library)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_texts(vocab, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    check(texts, vocab, library)


def test_random_words(vocab, library):
    rng = random.Random(4)
    letters = list("abcdefgh thein ▁  ñ世\n")
    check(["".join(rng.choices(letters, k=rng.randrange(1, 400))) for _ in range(600)], vocab, library)


def test_texts_without_blanks(vocab, library):
    rng = random.Random(9)
    check(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(200, 900))) for _ in range(1500)], vocab, library)
    check(["".join(rng.choices(["the", "an", "tion", "ing", "er", "on", "re", "世界", "0", "="], k=40_000)), "".join(rng.choices("ABab01+/", k=50_000)), "ab" * 40_000, "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(30_000))], vocab, library)


def test_stretches_of_long_texts(vocab, library, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 50)
    rng = random.Random(2)
    check(["", " ", "".join(rng.choices(["the", " ", "  ", "▁", "and so", "\n", "é", "x" * 70], k=900)), "a", " " * 300, "no", "word " * 2000], vocab, library)


def test_a_text_of_50_megabytes(vocab, library):
    text = " ".join(str(k * 7919 % 1_000_003) + "the" for k in range(200_000)) * 26
    assert len(text) > 50_000_000
    ids, at = pieces.encode([text], vocab)
    head = library.encode(text[: text.index(" ", 3_000_000)])
    assert ids[: len(head) - 9].tolist() == head[:-9] and pieces.decode(ids, at, vocab).to_pylist() == [text]


def test_malformed_bytes(vocab, library):
    ids = [3 + 0xE4, 3 + 0xB8, 3 + 0x41]
    import numpy as np

    text = pieces.decode(np.array(ids), np.array([0, 3]), vocab)
    assert text.to_pylist()[0].endswith("A") and "�" in text.to_pylist()[0] and isinstance(text, pa.Array)


def test_columns(spark, library):
    rows = [(1, "one two"), (2, None), (2, ""), (None, "x"), (1, "one two"), (3, "long " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    found = pieces.encode_column(docs, ["doc_id"], PATH)
    assert sorted(((r["doc_id"], r["ids"], r["n_tokens"], r["lossless"]) for r in found.collect()), key=str) == sorted(((i, w := library.encode(t or ""), len(w), True) for i, t in rows), key=str)
    back = pieces.decode_column(found, ["doc_id"], PATH)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert pieces.encode_column(docs.limit(0), ["doc_id"], PATH).collect() == []
