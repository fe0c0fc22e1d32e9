"""Statistics of whole texts, computed over Arrow buffers for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import LOWER, byte_table, span_hashes, spans

SPACE = byte_table("space")
LINE = np.ones(256, bool)
LINE[0x0A] = False

BYTE_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "newline": (10, 13), "wide": range(0xC0, 256),
    "stop": b".", "comma": b",", "shout": b"!", "ask": b"?", "pipe": b"|", "brackets": b"()[]{}<>", "marks": b"#$%&*+=@^~_\\/", "quotes": b"\"'`", "colon": b":;", "dash": b"-", "control": [*range(0, 9), *range(14, 32), 127],
}
_classes = np.zeros((256, len(BYTE_CLASSES)))
for _i, _members in enumerate(BYTE_CLASSES.values()):
    _classes[list(_members), _i] = 1


def histogram(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte counts, texts x 256."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64) << 8, np.diff(offsets))
    return np.bincount(doc + raw, minlength=n << 8).reshape(n, 256)


def shares(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct items, the largest count of one item, and the weight of second and later occurrences."""
    key = (doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    owner = doc[order][first]
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(np.append(first, len(key))))
    return np.bincount(owner, minlength=n).astype(float), most, np.bincount(doc[order], np.where(new, 0, weight[order]), n)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x features (float32): sizes, byte-class rates, word, sentence and line shape, and repetition."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    counts = histogram(raw, offsets)
    per_byte = 1 / np.maximum(size, 1)
    chars = size - counts[:, 0x80:0xC0].sum(1)
    classes = (counts @ _classes) * per_byte[:, None]
    p = counts * per_byte[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)

    starts, ends, doc = spans(SPACE[raw], offsets)
    length = (ends - starts).astype(float)
    words = np.bincount(doc, minlength=n).astype(float)
    per_word = 1 / np.maximum(words, 1)
    mean = np.bincount(doc, length, n) * per_word
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) * per_word - mean**2, 0))
    hashes = span_hashes(LOWER[raw], starts, ends)
    distinct, most, _ = shares(doc, hashes, length, n)
    again = np.zeros(len(doc))
    again[1:] = (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])
    last = LOWER[raw][ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = raw[starts] if len(starts) else np.zeros(0, np.uint8)
    word_rates = [np.bincount(doc, x, n) * per_word for x in (again, length <= 3, length >= 14, last == ord("."), np.isin(last, np.frombuffer(b"#$%&*!", np.uint8)), (first >= 65) & (first <= 90))]

    begin, end, owner = spans(LINE[raw], offsets)
    span = (end - begin).astype(float)
    lines = np.bincount(owner, minlength=n).astype(float)
    per_line = 1 / np.maximum(lines, 1)
    line_hash = span_hashes(raw, begin, end)
    line_kinds, _, copied = shares(owner, line_hash, span, n)
    closed = np.isin(raw[end - 1], np.frombuffer(b".!?", np.uint8)) if len(end) else np.zeros(0)
    stops = counts[:, [46, 33, 63]].sum(1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), size / np.maximum(chars, 1), classes, entropy, mean, spread, distinct * per_word, most * per_word, *word_rates,
        words / (1 + stops), np.bincount(owner, span, n) * per_line, line_kinds * per_line, copied * per_byte, np.bincount(owner, closed, n) * per_line,
    ]).astype(np.float32)
