"""The audit of sources against a plain computation over all terms and pairs of groups."""

import random
import re
from collections import Counter, defaultdict

import pytest

from graphloom.llm import divergence

SCHEMA = "lang string, source string, text string, value long, term string, g int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least=3, most=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            for part, values in (
                ("pair", [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]),
                ("term", [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]][:]),
            ):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= most]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)
    return sorted(map(tuple, divergence.audit(table, **options).collect()))


def corpus(n, sources, langs=("en", "de"), kinds=120, seed=1):
    draw = random.Random(seed)
    # frequent words that all sources have and rare ones that belong to a few
    word = lambda s: f"w{chr(97 + (x := int(kinds * draw.random() ** 2)) // 26 % 26)}{chr(97 + x % 26)}" if draw.random() < 0.7 else f"r{chr(97 + s % 26)}{'xyz'[draw.randrange(3)]}{'é' * (s % 3)}"
    return [(draw.choice(langs), f"s{(s := draw.randrange(sources))}", " ".join(word(s) for _ in range(draw.randrange(30)))) for _ in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(0, 1), (1, 1), (60, 1), (200, 12), (700, 75)])
def test_against_all_pairs(spark, n, sources):
    rows = corpus(n, sources, ("en",) if sources > 20 else ("en", "de"))
    assert found(spark, rows) == expected(rows)


def test_terms_in_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_TERMS", 7)
    rows = corpus(250, 9)
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("every", [1, 10**6])
def test_all_heavy_or_all_light(spark, monkeypatch, every):
    monkeypatch.setattr(divergence, "HEAVY_IN", every if every > 1 else 0)
    rows = corpus(200, 10)
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    long = " ".join(f"Term{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(60_000))
    rows = [(None, None, None), (None, "s", "One one two"), ("", "s", "ONE, one"), ("", "t", "one é1É two"), ("en", "a", ""), ("en", "b", "123 --"), ("en", "c", "x"), ("fr", "a", long), ("fr", "b", long), ("fr", "c", long), ("fr", "c", long), ("x", "one", "a b a"), ("x", "one", "a b a"), ("x", "one", "a b a")]
    assert found(spark, rows) == expected(rows)


def test_ties_and_the_bound_on_terms(spark):
    rows = [("en", s, " ".join(f"{s}{chr(97 + i)}" for i in range(20))) for s in "abcd" for _ in range(3)]
    assert found(spark, rows, most_terms=5) == expected(rows, most=5)


def test_shares_of_counts_beyond_a_long(spark):
    n = 9_300_000_000_000
    table = spark.createDataFrame([(n, 10 * n, 1000)], "n long, total long, kinds long")
    assert table.selectExpr(divergence.share_sql("n", "total", "kinds")).first()[0] == 1 + 10**9 * (n + 1) // (10 * n + 1000)
