"""The Merkle manifest against trees built in Python, and what proofs show."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle
from graphloom.llm.common import stage

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int, tree int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(hashes):
    """The root, and for each leaf its runs (hashes, own place) upwards."""
    runs, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, a in enumerate(at):
            runs[i].append((hashes[a // 8 * 8 : a // 8 * 8 + 8], a % 8))
        at = [a // 8 for a in at]
        hashes = [digest("".join(hashes[i : i + 8])) for i in range(0, len(hashes), 8)]
    return hashes[0], runs


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(((row["doc_id"] is not None, row["doc_id"] or 0), leaf_of(row), row["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, leaf, _ in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    root, above = tree([trees[g][0] for g in order])
    return sorted(
        (str(doc), leaf, trees[g][0], root, digest("".join("".join(run[:i] + run[i + 1 :]) for run, i in runs + above[k])))
        for k, g in enumerate(order) for (_, leaf, doc), runs in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1], strict=True)
    )


def found(df):
    rows = merkle.manifest(df, COLUMNS, "lang", "doc_id")
    return sorted((str(r[0]), *r[1:]) for r in rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps"))).collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3, 4) for r in rows], SCHEMA)


def plain(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]


ODD = [
    (3, "A", "en", "s", 1), (3, "A", "en", "s", 1), (3, "B", "en", "s", 1), (None, None, None, None, None), (None, "x", "en", None, 1), (5, "", "", "s", 0), (-2, "é" * 70_000, "zz", "s", 9),
    (7, "one", None, "s", 3), (8, "two", "é", "s", 3), (8, "two", "é", "s", 3),
]


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 600])
def test_sizes(spark, n):
    rows = [(i * 7 % 1000, f"Text {i}", "en" if i % 3 else ("de", None, "fr")[i % 9 // 3], f"s{i % 4}", i) for i in range(n)]
    assert found(table(spark, rows)) == (expected(plain(rows)) if rows else [])


def test_odd_rows(spark):
    assert found(table(spark, ODD)) == expected(plain(ODD))


def test_many_groups(spark):
    rows = [(i, f"t{i}", f"lang{i % 90}" if i % 2 else "hot", "s", i) for i in range(300)]
    assert found(table(spark, rows)) == expected(plain(rows))


def test_hot_group_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FEWEST", 20)
    monkeypatch.setattr(merkle, "MOST", 50)
    rows = [(i * 37 % 1009, "t", "en", "s", 1) for i in range(700)] + [(i, "u", "fr", "s", 1) for i in range(30)]
    assert found(table(spark, rows)) == expected(plain(rows))


def test_only_changed_rows_fail(spark):
    rows = [(i, "Text" if i % 2 else "text", "en", "s", i) for i in range(100)]
    docs = table(spark, rows)
    lower = F.struct("doc_id", "source", "lang", "n_chars", F.lower("text").alias("text"))
    proofs = merkle.manifest(docs, COLUMNS, "lang", "doc_id", altered=lower)
    wrong = {r[0] for r in proofs.where(merkle.fold(F.col("other_leaf"), F.col("steps")) != F.col("root")).select("doc_id").collect()}
    assert wrong == {i for i in range(100) if i % 2}
    assert proofs.where(merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0


def test_values_cannot_be_shifted(spark):
    a, b = (spark.createDataFrame([r], "x string, y string") for r in (("1:a", "b"), ("1", ":ab")))
    assert a.select(merkle.leaf_of([F.col("x"), F.col("y")])).first() != b.select(merkle.leaf_of([F.col("x"), F.col("y")])).first()


def test_a_level_is_one_shuffle_of_its_nodes(spark):
    leaves = stage(spark.range(500).select(F.lit("").alias("tree"), F.col("id").alias("place"), F.lit(500).cast("long").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("hash")))
    levels = merkle.build(leaves)
    assert [x.count() for x in levels] == [500, 63, 8, 1]
    assert max(r["n"] for r in levels[1].select(F.size("children").alias("n")).collect()) == 8
