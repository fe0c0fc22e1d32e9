"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Defined results: null and empty texts have all-zero counts and get the score the trees give those; equal texts get equal
scores; repeated rows are scored alike, each giving a row; without labels every score is 0.5; extra columns pass by unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import docstats, scored, trees

THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, most: int = scored.MAX_TRAIN) -> trees.Forest:
    """Fit on at most about ``most`` labelled texts of ``docs`` whose crc32(id) mod ``mod`` is not ``held``."""
    x, y, _ = scored.featured(scored.training_sample(docs, labels, "quality", mod, held, most), docstats.statistics)
    return trees.fit(x, y)


def scorer(forest: trees.Forest):
    return lambda raw, offsets: forest.probability(docstats.statistics(raw, offsets))


def score(docs: DataFrame, forest: trees.Forest, keep: list[str]) -> DataFrame:
    return scored.score_rows(docs, scorer(forest), keep)


def accept(docs: DataFrame, forest: trees.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    return scored.keep_rows(docs, scorer(forest), lambda s: s >= threshold)
