"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of lexicon words, how near they are to the second person, capitals, punctuation and obfuscation.
The lexicon is a short list of insults and what the training sample adds to it: words, and beginnings of words, that occur
in clearly more toxic texts than chance allows.  The lexicon is learned and the trees are fitted on three
quarters of the sample, and calibrated on the rest.  Of the terms found, the ``MOST_TERMS`` clearest are kept.

Defined results: null and empty texts have no words and get the score of that; equal texts get equal scores; repeated rows
are scored alike, each giving a row; without labels to learn from every score is 0; extra columns pass by unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats, scored, trees
from .common import LOWER, SALTS, byte_table, mix, sliced, span_hashes, spans, text_view

THRESHOLD = 0.3
#: Insults in common use, and second-person words, of the languages at hand.
INSULTS = "idiot idiots stupid moron morons loser losers pathetic worthless scum trash clown clowns disgusting dumb fool imbecile cretin garbage filth vermin parasite bastard freak creep hate ugly shut kill idiota estúpido imbécil basura asqueroso crétin débile ordure abruti dummkopf abschaum widerlich blöd trottel".split()
SECOND = "you your yours yourself u ur tu te toi vous votre du dich dir dein deine ihr euch tú usted ustedes vosotros".split()
#: Stand-ins for letters, and the letters they stand for.
STAND_INS = (b"013457@$!|", b"oieastasil")
PREFIXES = (4, 5, 6, 7, 8)
MOST_TERMS = 4096
NEAR = 3

WORD = byte_table("alnum")
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[0x80:] = True
PLAIN = LOWER.copy()
PLAIN[list(STAND_INS[0])] = list(STAND_INS[1])


def _hash(words) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


def _keys(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; a word shorter than a beginning has 0 there."""
    found = [span_hashes(lower, starts, ends)]
    for i, k in enumerate(PREFIXES):
        value = np.zeros(len(starts), np.uint64)
        long = np.flatnonzero(ends - starts > k)
        for j in range(k):
            value[long] = (value[long] << np.uint64(8)) | lower[starts[long] + j].astype(np.uint64)
        found.append(np.where(value > 0, mix(value ^ SALTS[i + 1]), np.uint64(0)))
    return found


@dataclass
class Lexicon:
    """Sorted hashes and the band (1 weak .. 3 strong) of each, for words and for each length of beginning."""

    keys: list[np.ndarray]
    bands: list[np.ndarray]

    def band(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        keys = self.keys[kind]
        if not len(keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, self.bands[kind][at], 0)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms in at least 6 toxic texts whose toxic count lies 6 standard deviations above their share of all texts."""

    def run(batches):
        for batch in sliced(batches):
            raw, offsets = text_view(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            starts, ends, doc = spans(WORD[raw], offsets)
            for kind, hashes in enumerate(_keys(LOWER[raw], starts, ends)):
                pair = np.unique(np.stack([hashes.view(np.int64), doc], 1)[hashes > 0], axis=0) if len(hashes) else np.zeros((0, 2), np.int64)
                term, at = np.unique(pair[:, 0], return_inverse=True)
                toxic = np.bincount(at, label[pair[:, 1]], len(term)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), kind, np.int32)), pa.array(term), pa.array(toxic), pa.array(np.bincount(at, minlength=len(term)).astype(np.int64) - toxic)], ["kind", "term", "toxic", "clean"])

    sizes = sample.agg(F.sum("label"), F.count("*")).first()
    share = (sizes[0] or 0) / max(sizes[1], 1)
    expected = (F.col("toxic") + F.col("clean")) * max(share, 1e-9)
    counted = sample.mapInArrow(run, "kind int, term long, toxic long, clean long").groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    z = (F.col("toxic") - expected) / F.sqrt(expected)
    found = counted.where((F.col("toxic") >= 6) & (z >= 6)).select("kind", "term", (F.col("toxic") / (F.col("toxic") + F.col("clean"))).alias("rate"), z.alias("z")).orderBy(F.desc("z"), "kind", "term").limit(MOST_TERMS).collect()
    terms: list[dict[int, int]] = [{} for _ in range(1 + len(PREFIXES))]
    for row in found:
        band = 1 + (row["rate"] >= 0.5) + (row["rate"] >= 0.9)
        terms[row["kind"]][int(np.int64(row["term"]).astype(np.uint64))] = band
    for value in _hash(INSULTS):
        terms[0].setdefault(int(value), 2)
    keys = [np.sort(np.array(list(t), np.uint64)) for t in terms]
    return Lexicon(keys, [np.array([t[int(k)] for k in ks], np.int64) for t, ks in zip(terms, keys, strict=True)])


SECOND_KEYS = np.sort(_hash(SECOND))


def features(lexicon: Lexicon, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    lower = LOWER[raw]
    starts, ends, doc = spans(WORD[raw], offsets)
    words = np.bincount(doc, minlength=n).astype(float)
    per_word, per_byte = 1 / np.maximum(words, 1), 1 / np.maximum(size, 1)
    out = [np.log1p(words)]
    hit = np.zeros(len(starts), bool)
    for kind, hashes in enumerate(_keys(lower, starts, ends)):
        band = lexicon.band(kind, hashes)
        for b in (1, 2, 3):
            count = np.bincount(doc, band == b, n)
            out += [count * per_word, np.log1p(count)]
        hit |= band >= 2
        if kind == 0:
            plain_keys = hashes
    second = np.isin(plain_keys, SECOND_KEYS)
    near = np.zeros(len(starts), bool)
    for gap in range(1, NEAR + 1):
        same = doc[gap:] == doc[:-gap]
        near[gap:] |= same & second[:-gap] & hit[gap:]
        near[:-gap] |= same & second[gap:] & hit[:-gap]
    hits = np.bincount(doc, hit, n)
    out += [hits * per_word, np.log1p(hits), np.bincount(doc, second, n) * per_word, np.bincount(doc, near, n) * per_word, np.log1p(np.bincount(doc, near, n))]

    counts = docstats.histogram(raw, offsets)
    capital = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    shouted = (capital[ends] - capital[starts] == ends - starts) & (ends - starts > 2)
    out += [counts[:, 65:91].sum(1) * per_byte, np.bincount(doc, shouted, n) * per_word, np.bincount(doc, shouted & hit, n) * per_word]
    out += [counts[:, c].sum(1) * per_byte for c in ([33], [63], [46, 44], [35, 36, 37, 38, 42, 64], [124])]

    # obfuscation: white-space tokens in which letters stand beside stand-ins, and what those spell
    begin, end, owner = spans(docstats.SPACE[raw], offsets)
    letters = np.concatenate([[0], np.cumsum(LETTER[lower])])
    others = np.concatenate([[0], np.cumsum(np.isin(raw, np.frombuffer(STAND_INS[0] + b"*._-", np.uint8)))])
    tokens = np.maximum(np.bincount(owner, minlength=n), 1)
    inside_end = np.maximum(end - 1, begin)
    mixed = np.flatnonzero((letters[end] - letters[begin] > 1) & (others[inside_end] - others[begin] > 0))
    spelled = np.zeros(len(mixed), bool)
    if len(mixed):
        plain = PLAIN[raw]
        good = LETTER[plain]
        lengths = end[mixed] - begin[mixed]
        at = np.repeat(begin[mixed], lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        kept = good[at]
        token = np.repeat(np.arange(len(mixed)), lengths)[kept]
        stops = np.searchsorted(token, np.arange(len(mixed)), "right")
        starts_ = np.searchsorted(token, np.arange(len(mixed)), "left")
        some = np.flatnonzero(stops > starts_)
        spelled[some] = lexicon.band(0, span_hashes(plain[at][kept], starts_[some], stops[some])) >= 2
    single = np.flatnonzero(ends - starts == 1)
    run_on = np.zeros(len(starts), bool)
    run_on[single] = True
    run_on[1:] &= run_on[:-1] & (doc[1:] == doc[:-1])
    run_on[:1] = False
    out += [np.bincount(owner[mixed], minlength=n) / tokens, np.bincount(owner[mixed], spelled, n) / tokens, np.log1p(np.bincount(owner[mixed], spelled, n)), np.bincount(doc, run_on, n) * per_word]
    return np.column_stack(out).astype(np.float32)


@dataclass
class Model:
    lexicon: Lexicon
    forest: trees.Forest
    knots: np.ndarray
    values: np.ndarray

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.interp(self.forest.probability(features(self.lexicon, raw, offsets)), self.knots, self.values)


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, most: int = scored.MAX_TRAIN) -> Model:
    """Fit on at most about ``most`` labelled texts of ``docs`` whose crc32(id) mod ``mod`` is not ``held``."""
    sample = scored.training_sample(docs, labels, "toxic", mod, held, most)
    lexicon = learn_lexicon(sample.where("part <> 3"))
    x, y, part = scored.featured(sample, lambda raw, offsets: features(lexicon, raw, offsets))
    fitted = part != 3
    if not fitted.any():  # nothing to learn from: no text counts as toxic
        return Model(lexicon, trees.fit(x[fitted], y[fitted], depth=3), np.array([0.0, 1.0]), np.array([0.0, 0.0]))
    forest = trees.fit(x[fitted], y[fitted], depth=3)
    held_back = y[~fitted]
    if not len(held_back) or held_back.min() == held_back.max():
        return Model(lexicon, forest, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return Model(lexicon, forest, *trees.isotonic(forest.probability(x[~fitted]), held_back))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    return scored.score_rows(docs, model, keep)


def accept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    return scored.keep_rows(docs, model, lambda s: s < threshold)
