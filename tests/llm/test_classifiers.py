"""The two classifiers: held-out accuracy, odd inputs, and the pieces they are made of."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import docstats, quality, queries, toxicity, trees

FOLDER = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@needs_tables
@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.97), ("op7_toxicity", "toxic", 0.96)])
def test_held_out(spark, name, label, least):
    found = queries.queries()[name](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least
    hits = found.where(F.col(label) == 1).agg(F.avg("predicted")).first()[0], found.where("predicted = 1").agg(F.avg(label)).first()[0]
    print(f"{name}: accuracy {right:.3f}, recall {hits[0]:.3f}, precision {hits[1]:.3f}")
    assert hits[0] >= 0.9 and hits[1] >= 0.95
    assert found.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0


ODD = [(1, "You are an idiot and a moron, worthless scum!"), (2, None), (3, ""), (None, "calm words about the sea"), (1, "You are an idiot and a moron, worthless scum!"), (4, "word " * 60000), (5, "x"), (6, "\n\n\n"), (7, "é世🤗 1d1ot m*ron"), (8, "A" * 100000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("score", F.lit("y"))


@pytest.mark.parametrize("module", [quality, toxicity])
@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (3, 0, 0), (None, 1, 1), (2, None, None), (5, 1, 0), (5, 0, 0), (7, 1, 1), (99, 1, 1)]])
def test_odd_rows(spark, odd, module, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = module.train(odd, table)
    found = module.score(odd, model, ["doc_id"]).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((i for i, _ in ODD), key=str)
    assert all(0 <= r["score"] <= 1 for r in found) and len({r["score"] for r in found if r["doc_id"] == 1}) == 1
    kept = module.accept(odd, model)
    assert kept.columns == odd.columns
    assert kept.count() == sum((r["score"] >= 0.3) == (module is quality) for r in found)
    assert module.accept(odd.limit(0), model).collect() == []
    assert module.train(odd.limit(0), table) is not None


def test_the_query_without_labels(spark, odd, tmp_path):
    odd.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = queries.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(ODD) and all((r["score"], r["predicted"]) == (0.0, 0) for r in found)


def test_statistics_by_hand():
    raw = "Ab ab c.\nab ab".encode()
    x = docstats.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw), len(raw)]))
    words = 5
    assert np.isclose(x[0, 1], np.log1p(words)) and np.isclose(x[0, 2], np.log1p(2)) and x[1, 0] == 0
    assert np.isfinite(x).all()


def test_trees_learn_and_are_flat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = trees.fit(x[:2000], y[:2000])
    assert ((forest.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    # the same walk, a node at a time
    row, total = x[2001], forest.start
    for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += leaf[node - len(feature)]
    assert np.isclose(total, forest.margin(x[2001:2002])[0])


def test_isotonic():
    knots, values = trees.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and np.interp(0.05, knots, values) < 0.2 < 0.8 < np.interp(0.9, knots, values)
