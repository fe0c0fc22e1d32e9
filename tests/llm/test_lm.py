"""Language-model scores: counts against plain ones, the network against a step-by-step one, and held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import gru, lm
from graphloom.llm.common import fold

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, term string, score string"
def learn():
    return fold(F.col("doc_id"), 7) != 2



def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def expected(rows):
    """(n_tokens, n_known, base score) of each row; None stands for the end."""
    texts = [(doc, [*words(text), None]) for doc, text in rows]
    c = Counter(w for doc, ws in texts if not held(doc) for w in ws)
    slots = math.log10(sum(c.values()) + len(c) + 1)
    return c, sorted((str(doc), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10(c[w] + 1) - slots for w in ws), 6)) for doc, ws in texts)


def found(spark, rows):
    table = spark.createDataFrame([(*r, 3, "clash", "x") for r in rows], SCHEMA)
    model = lm.train(table, learn())
    return model, lm.score(table, model, ["doc_id"]).collect()


def plain(rows):
    return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows)


def corpus(n, seed=3):
    """Texts in which a word says what comes next."""
    draw, rows = np.random.default_rng(seed), []
    for i in range(n):
        state, text = int(draw.integers(40)), []
        for _ in range(int(draw.integers(3, 120))):
            state = (state * 3 + 1) % 40 if draw.random() < 0.8 else int(draw.integers(40))
            text.append(f"Word{state}" if draw.random() < 0.97 else f"odd{draw.integers(10_000)}")
        rows.append((i, " ".join(text)))
    return rows


def test_counts_and_base(spark):
    rows = corpus(300)
    c, want = expected(rows)
    model, rows_found = found(spark, rows)
    assert plain(rows_found) == want and model.total == sum(c.values()) and model.kinds == len(c)


def test_words_outside_the_head_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)
    rows = corpus(200)
    model, rows_found = found(spark, rows)
    assert len(model.head) <= 20 and plain(rows_found) == expected(rows)[1]


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "A b"), (None, "A b"), (3, " \t\n"), (4, "x" * 300_000 + " end"), (5, "é\x85É a A"), (6, "one two " * 40_000), (13, "x" * 300_000)]
    assert plain(found(spark, rows)[1]) == expected(rows)[1]


def test_without_training_texts(spark):
    ids = [i for i in range(40) if held(i)]
    rows = [(i, "some words") for i in ids]
    model, rows_found = found(spark, rows)
    assert model.total == 0 and plain(rows_found) == expected(rows)[1] and all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in rows_found)
    assert found(spark, [])[1] == []


def test_better_than_counts_on_held_out_texts(spark):
    rows = [r for r in found(spark, corpus(800))[1] if held(r["doc_id"])]
    assert len(rows) > 60 and sum(r["score"] for r in rows) > 0.75 * sum(r["base_score"] for r in rows)  # both are negative


def network(seed=5, tokens=50, classes=6):
    draw = np.random.default_rng(seed)
    weights = np.sort(draw.integers(1, 100, tokens))[::-1].astype(float)
    bounds = gru.class_bounds(weights, 2, classes)
    net = gru.fresh(weights, bounds)
    return {k: (v + draw.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in net.items()}, bounds


def step_by_step(net, bounds, text):
    """Log-probability of a text and its end, a token at a time."""
    h, last, total = np.zeros(net["recurrent"].shape[1]), 0, 0.0
    sigma = lambda x: 1 / (1 + np.exp(-2 * x))
    for token in [*text, 0]:
        x, a = net["inputs"][:, last].astype(float), h @ net["recurrent"].astype(float)
        z, r = sigma(x[0] + a[0]), sigma(x[1] + a[1])
        c = np.tanh(x[2] + r * a[2])
        h, last = (1 - z) * c + z * h, token
        classes = np.exp(h @ net["classes"] + net["class_bias"])
        own = int(np.searchsorted(bounds, token, "right")) - 1
        inner = np.exp(net["words"][bounds[own] : bounds[own + 1]] @ h + net["word_bias"][bounds[own] : bounds[own + 1]])
        total += math.log(classes[own] / classes.sum()) + math.log(inner[token - bounds[own]] / inner.sum())
    return total


@pytest.mark.parametrize("lengths", [[5], [0, 3, 0], [100, 31, 32, 33, 1, 64], [700, 2]])
def test_state_is_carried_through_whole_texts(lengths):
    net, bounds = network()
    ids = np.random.default_rng(1).integers(0, 50, sum(lengths)).astype(np.int32)
    texts = np.split(ids, np.cumsum(lengths)[:-1])
    assert np.allclose(gru.log_likelihood(net, bounds, ids, np.array(lengths)), [step_by_step(net, bounds, t) for t in texts], rtol=1e-4, atol=1e-3)


def test_probabilities_sum_to_one():
    net, bounds = network()
    # of all tokens after a beginning: each continued text's probability without its end
    begin = [7, 3, 30]
    whole = lambda text: step_by_step({**net}, bounds, text)
    states = np.random.default_rng(0).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    every = gru._predict(net, bounds, gru.class_of(bounds), np.repeat(states, 50, axis=0), np.arange(50))
    assert abs(np.exp(every).sum() - 1) < 1e-4 and whole(begin) < 0


def test_gradient():
    net, bounds = network()
    draw = np.random.default_rng(2)
    lengths = np.array([20, 9, 1, 40])
    trainer = gru.Trainer(net, bounds, 0.01)
    window = next(gru.Sequences(draw.integers(0, 50, lengths.sum()).astype(np.int32), lengths).windows())
    trainer.net = {k: v.astype(float) for k, v in net.items()}
    state = lambda: np.zeros((4, gru.HIDDEN), np.float32)
    gradient, _ = trainer.gradient(state(), *window)
    for k, v in trainer.net.items():
        at = np.unravel_index(np.argmax(np.abs(gradient[k])), v.shape)
        own, sums = v[at], []
        for change in (0.01, -0.01):
            v[at] = own + change
            sums.append(trainer.gradient(state(), *window)[1])
        v[at] = own
        assert abs((sums[0] - sums[1]) / 0.02 / window[3].sum() - gradient[k][at]) < 2e-3


def test_networks_of_all_tasks_are_averaged(spark):
    rows = corpus(400)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    model = lm.train(table, F.lit(True))
    out = lm.score(table, model, ["doc_id"]).agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.75 * out[1]
