"""The n-gram join against all pairs, and the parts of its index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import staging
from graphloom.llm import ngram_join as nj


def shingles(text, n):
    if text is None:
        return frozenset()
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    best = {k: k for k in range(len(sets))}

    def root(k):
        while best[k] != k:
            k = best[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same_id = sets[a][0] is not None and sets[a][0] == sets[b][0]
            if sets[a][0] is not None and sets[b][0] is not None and x and y and (same_id or den * len(x & y) >= num * len(x | y)):
                best[root(a)] = root(b)
    groups = {}
    for k, (i, s) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    return sorted(((i, len(s), min((g for g in groups[root(k)] if g is not None), default=None)) for k, (i, s) in enumerate(sets)), key=str)


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for size in (3, 5, 8, 12, 20, 40, 90, 200, 500):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        out += [family(rng, base, rng.choice((0, 0, 1, 1, 2, 3, size // 40, size // 20))) for _ in range(12)]
        out += [" ".join(base[: max(1, int(size * cut))]) for cut in (0.8, 0.86, 0.93)]
    # drifting copies of copies: heads that have heads
    for _ in range(3):
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        for _ in range(25):
            out.append(" ".join(words))
            words = family(rng, words, rng.choice((1, 1, 2, 4))).split()
    out += ["", None, "  \n ", "one", "ONE", "one two", "a b c d", "A  b\tc\nd", "é É", "x " * 400, "y" * 5000]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return [*rows, (rows[0][0], rows[0][1]), (None, "a b c d"), (None, None)]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_like_all_pairs(spark, rows, n, num, den):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("id", F.lit("x"))
    found = sorted((tuple(r) for r in nj.near_duplicates(docs, n, num, den).collect()), key=str)
    assert found == brute(rows, n, num, den)


def test_blocks_and_visits(spark, rows, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ITEMS", 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in nj.near_duplicates(docs, 4, 85, 100).collect()), key=str) == brute(rows, 4, 85, 100)


def test_large_clusters_in_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(nj, "THINNED", 8)
    monkeypatch.setattr(nj, "BLOCK_ITEMS", 300)
    t = nj.Threshold(85, 100)
    rng = np.random.default_rng(8)
    base = rng.poisson(3, (40, nj.GROUPS)).astype(np.uint8) + 1
    near = base[:6].copy()
    near[:, 0] += 1
    counts = np.concatenate([base, near])
    points = spark.createDataFrame([(0, k, int(c.sum()), bytearray(c.tobytes())) for k, c in enumerate(counts)], "head long, id long, size long, point binary")
    found = {r["id"] for r in nj._thinned_in_pieces(points, t).collect()}
    assert found == set(np.flatnonzero(nj._possible(counts, counts.sum(1).astype(np.int64), t)).tolist())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in nj.near_duplicates(docs, 4, 85, 100).collect()), key=str) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("hot", [2, 20])
def test_frequent_signatures(spark, rows, monkeypatch, hot):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    t = nj.Threshold(85, 100)
    signed = docs.selectExpr("doc_id as id", "text").mapInArrow(lambda b: nj._signed(b, 4, t), "id long, size long, f1 long, f2 long, point binary, signatures array<long>").cache()
    plain = {tuple(r) for r in nj._heads(signed).collect()}
    monkeypatch.setattr(nj, "ONE_IN", 1)
    monkeypatch.setattr(nj, "HOT", hot)
    assert {tuple(r) for r in nj._heads(signed).collect()} == plain


def test_one_id_with_several_texts(spark):
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "v w x y z"), (9, "v w x y z"), (7, "alone in the world here")]
    found = sorted(tuple(r) for r in nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect())
    assert found == [(1, 2, 1), (5, 2, 1), (5, 2, 1), (7, 2, 7), (9, 2, 1)]


def test_copy_without_id_first(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (5, text), (9, text + " w60"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in nj.near_duplicates(docs, 4, 85, 100).collect()), key=str) == brute(rows, 4, 85, 100)
    assert sorted((r["doc_id"] for r in nj.one_of_each(docs, 4, 85, 100).collect()), key=str) == [5, None, None]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_duplicates(docs).collect() == [] and nj.one_of_each(docs).collect() == []


def test_one_of_each(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = nj.one_of_each(docs, 4, 85, 100)
    assert kept.columns == docs.columns
    want = {r[2] for r in brute(rows, 4, 85, 100) if r[0] is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (8, 10), (1, 2)):
        t = nj.Threshold(num, den)
        for size in (1, 2, 5, 6, 7, 9, 15, 30, 77, 200, 999):
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                drop = rng.integers(0, size)
                b = np.union1d(a[drop:], rng.integers(0, 1 << 63, rng.integers(0, size)).astype(np.uint64))
                same = len(np.intersect1d(a, b))
                if not len(b) or den * same < num * (len(a) + len(b) - same) or np.array_equal(a, b):
                    continue
                signs, at = t.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(signs[at[0] : at[1]].tolist()) & set(signs[at[1] :].tolist())


def test_unrelated_sets_share_no_signature():
    rng = np.random.default_rng(7)
    t = nj.Threshold(80, 100)
    for size in (150, 250, 400):
        gram = np.concatenate([np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2)) for _ in range(300)])
        signs, _ = t.signatures(gram, np.arange(301) * size)
        assert len(np.unique(signs)) == len(signs)


def test_tree_leaves_nothing_out():
    rng = np.random.default_rng(3)
    t = nj.Threshold(85, 100)
    counts = rng.poisson(3, (400, nj.GROUPS)) + rng.integers(0, 2, (400, 1)) * 2
    size = counts.sum(1)
    tree = nj.CountTree(counts, size, t)
    for q in range(0, 400, 7):
        bound = np.minimum(counts, counts[q]).sum(1)
        want = (bound >= t.overlap(size, size[q])) & (size * 100 >= size[q] * 85) & (size * 85 <= size[q] * 100)
        assert set(np.flatnonzero(want)) == set(tree.search(counts[q], int(size[q]), np.ones(400, bool)).tolist())


def test_tree_joined_with_itself(monkeypatch):
    rng = np.random.default_rng(4)
    t = nj.Threshold(8, 10)
    monkeypatch.setattr(nj, "LEAF", 32)
    for scale in (0.2, 3, 40):
        base = rng.poisson(scale, (60, nj.GROUPS))
        counts = np.concatenate([base, np.maximum(base[:20] + rng.integers(-1, 2, (20, nj.GROUPS)) * (rng.random((20, nj.GROUPS)) < 0.1), 0)]) + 1
        size = counts.sum(1)
        low = np.minimum(counts[:, None], counts[None]).sum(2)
        must = (low >= t.overlap(size[:, None], size[None])) & (size[:, None] * 10 >= size[None] * 8) & (size[None] * 10 >= size[:, None] * 8)
        np.fill_diagonal(must, False)
        found = nj.CountTree(counts.astype(np.int32), size, t).paired()
        assert np.array_equal(found, must.any(1))


def test_similar_sets_keep_a_common_signature():
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (8, 10), (1, 2)):
        t = nj.Threshold(num, den)
        for size in (6, 9, 15, 30, 77, 200, 999):
            for _ in range(12):
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                drop = rng.integers(0, max(1, size * (den - num) // den))
                b = np.union1d(a[drop:], rng.integers(0, 1 << 63, rng.integers(0, max(1, size * (den - num) // den))).astype(np.uint64))
                same = len(np.intersect1d(a, b))
                if den * same < num * (len(a) + len(b) - same) or np.array_equal(a, b):
                    continue
                signs, at, leave = t.signed(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                both = np.intersect1d(signs[at[0] : at[1]], signs[at[1] :])
                of = np.bincount((both & np.uint64(1)).astype(np.int64), minlength=2)
                assert (of > leave.sum(0)).any()


def test_documents_that_share_a_line_do_not_meet(spark, monkeypatch):
    rng, met = random.Random(6), []
    line = " ".join(f"common{k}" for k in range(40))
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(6000)) + "\n" + line) for k in range(30)]
    rows.append((30, rows[7][1] + " and a few more words"))
    monkeypatch.setattr(nj, "few", lambda df, bound, f=nj.few: met.append({r["id"] for r in df.collect() if "block" in df.columns}) or f(df, bound))
    before = len(staging._staged)
    found = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80, 100)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {k: 7 if k == 30 else k for k in range(31)}
    assert met == [{7, 30}]
    assert len(staging._staged) == before + 1  # its result; what it took is freed
