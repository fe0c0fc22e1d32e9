"""Token-id files: exact round trips, checksums, and the query's digests against plain encoding."""

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import tokenfile as tf
from graphloom.llm.common import staged_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.01"


def round_trip(ids, block):
    alphabet, words, counts = tf.compress(ids, block)
    again = tf.Alphabet.unpack(alphabet.pack()) if alphabet else None
    assert np.array_equal(tf.expand(again, words, counts, len(ids), block), ids)
    return len(words) * 16 / max(len(ids), 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 2**32 - 1), max_size=80), st.integers(1, 30))
def test_any_ids(ids, block):
    round_trip(np.array(ids, np.int64), block)


def test_long_runs():
    rng = np.random.default_rng(1)
    assert round_trip(np.zeros(20_000, np.int64), 4096) < 0.5
    assert round_trip(np.tile(np.arange(50) * 1001, 400), 4096) < 2
    assert round_trip(np.minimum(rng.zipf(1.2, 30_000), 65535), 4096) < 16
    round_trip(rng.integers(0, 65536, 30_000), 4096)


@pytest.mark.parametrize("wrong", [-1, 1 << 32])
def test_ids_out_of_range(wrong):
    with pytest.raises(ValueError):
        tf.compress(np.array([5, wrong]))


def test_large_vocabulary(monkeypatch):
    ids = np.random.default_rng(3).permutation(200_000).astype(np.int64) * 20_011
    round_trip(ids, 8192)
    monkeypatch.setattr(tf, "MOST_IN_CLASS", 3)  # classes overflow, and ids move to others
    round_trip(np.arange(190) % 150 * 7, 64)
    with pytest.raises(ValueError):
        tf.compress(np.arange(200))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")
def test_smaller_than_zlib():
    texts = pq.read_table(f"{FOLDER}/documents.parquet").sort_by("doc_id")["text"].to_pylist()
    ids = tf.Encoder(PATH).encode([t or "" for t in texts])[0].astype(np.int64)
    frame = tf.write_frame([0], np.array([len(ids)]), ids)
    assert len(frame) < 0.85 * len(zlib.compress(ids.astype("<u2").tobytes()))
    assert np.array_equal(next(tf.read_frames(frame))[2], ids)


def test_many_files(spark, monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 1)
    monkeypatch.setattr(tf, "FRAMES", 1)
    path = staged_path(spark)
    tf.write(spark.range(1100).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), path, PATH, partitions=1)
    assert [r["start"] for r in tf.digests(spark, path).orderBy("doc_id").collect()] == [2 * k for k in range(1100)]


def test_frames_of_longer_blocks_are_still_read():
    ids = np.random.default_rng(8).zipf(1.3, 9000) % 5000
    assert tf.BLOCK == 1024
    for block in (2048, tf.BLOCK):
        assert np.array_equal(next(tf.read_frames(tf.write_frame([1], np.array([9000]), ids, block)))[2], ids)


def test_blocks_learn_from_each_other():
    ids = np.tile(np.random.default_rng(9).permutation(1000) * 31, 64)
    assert round_trip(ids, 1024) < 2  # no block sees an id twice, so blocks alone would take ten bits an id


def test_pieces_go_through_the_library_once(monkeypatch):
    encoder, given = tf.Encoder(PATH), []
    plain = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda texts: given.extend(texts) or plain(texts))
    text = "alphabet, alphabet. alphabet! alphabet\nalphabet (alphabet) alphabet's"
    assert encoder.encode([text])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    assert "".join(given).count("alphabet") <= 3  # after a blank, after another sign, and before an apostrophe
    encoder.MOST = 30
    for other in (text, " ".join(f"once{k}x" for k in range(40))):
        encoder.encode([other])
    given.clear()
    encoder.encode([text, "something else once7x"])
    assert "alphabet" not in "".join(given) and "once" in "".join(given)  # what is used again is kept, and nothing else


def test_checksums():
    ids = np.arange(5000) % 777
    data = tf.write_frame([4, None, 9], np.array([1000, 0, 4000]), ids, 512) + b"\n"
    (names, sizes, back), *rest = tf.read_frames(data)
    assert names == [4, None, 9] and sizes.tolist() == [1000, 0, 4000] and np.array_equal(back, ids) and not rest
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        list(tf.read_frames(bytes(broken)))


def test_files(spark, monkeypatch):
    rows = [(5, "fünf words <|endoftext|> here"), (1, "one"), (None, "no id"), (3, None), (3, ""), (1, "one"), (2, "very long " * 20000), (-4, "\n\t  x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    path = staged_path(spark)
    tf.write(docs, path, PATH, end_id=2, partitions=3)
    tokenizer = Tokenizer.from_file(PATH)
    stored = tf.read(spark, path)
    plain = {(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows}
    assert {(r["doc_id"], tuple(r["ids"])) for r in stored.collect()} == plain
    found = sorted(tf.digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, -4, 1, 1, 2, 3, 3, 5]
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
        assert any(r["doc_id"] == i and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) for i, ids in plain)


def test_empty_table(spark):
    path = staged_path(spark)
    tf.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tf.digests(spark, path).collect() == []


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aab '.sS1\n\t  é世🤗\u00a0\u2003!<|", " ", "'s", " it's", "<|endoftext|>"]), max_size=40).map("".join) | st.text(max_size=40), max_size=6))
def test_stretches_like_whole_texts(encoder_and_library, texts):
    encoder, library = encoder_and_library
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def encoder_and_library():
    encoder = tf.Encoder(PATH)
    encoder.MOST, encoder.CALL = 60, 50
    return encoder, Tokenizer.from_file(PATH)
