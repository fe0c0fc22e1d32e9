"""Queries with SQL against it on the smallest tables, and that every query runs there."""

import os

import pytest
from oracle import connect, rows, sql_rows

from graphloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert rows(queries.queries()[name](spark, FOLDER)) == sql_rows(connect(FOLDER), queries.oracle_sql()[name])


def test_one_query_for_each_operator():
    names = set(queries.queries())
    assert {int(n[2:].split("_")[0]) for n in names - {"pipeline"}} == set(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize(("name", "table", "columns"), [
    ("op1_quality", "documents", {"doc_id", "held_out", "score", "predicted"}), ("op4_sentencepiece", "documents", {"doc_id", "ids", "n_tokens", "lossless"}),
    ("op11_lm_scores", "documents", {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}), ("op5_token_files", "documents", {"doc_id", "start", "n_tokens", "ids_crc32"}), ("op6_url_filters", "pages", {"page_id", "host", "path", "rule", "verdict", "mined"}), ("op7_toxicity", "documents", {"doc_id", "held_out", "score", "predicted"}),
])
def test_a_row_for_each_row(spark, name, table, columns):
    found = queries.queries()[name](spark, FOLDER)
    assert set(found.columns) == columns
    assert found.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
