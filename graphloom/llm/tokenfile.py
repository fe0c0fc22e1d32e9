"""Token-id files: an adaptive context-mixing range coder over unsigned 32-bit ids.

A file is a row of frames.  A frame holds whole documents and an alphabet: its distinct ids, dealt into ``CLASSES`` classes by
how they neighbour each other, with their frequencies within the class, and how classes follow classes.  The ids are cut into
blocks of ``BLOCK``, each of which has a crc32 of its ids.  The blocks of a frame are coded in step, one id of every block at a
time, which is what makes numpy fast enough for this.  All blocks of a frame learn into one model, which begins afresh with
each frame: frames decode independently, the blocks of one frame together.

The model predicts an id by its last two ids (order 2: the id that followed them last), by its last id (order 1: the same),
and by the class of the last (the class of the next, and in it the id by frequency).  The orders are mixed by shares that
follow, at every fourth id, how often which of them was right, kept for each pair of confidences: one interval goes to the order-2 id, one to the
order-1 id, and the rest, a scale of 2^29, is shared out among classes and, within a class, by frequency.  So an id costs one
coding step.  The coder is a range coder with 16-bit output words and a 64-bit state.

Frame layout, little-endian: magic ``GTF3``; u32 documents, ids, block length, blocks, alphabet bytes; i64 document ids; u8
null flags; u32 ids of each document; u32 output words and u32 crc32 of each block; the alphabet; u16 words; u32 crc32 of all
before; a newline.

Files are written through Spark's text writer, whose rows may be any bytes, and read through its binary reader, so they can
be in any store Spark reaches.  ``FRAMES`` bounds the frames of a file, and so what a reader holds.

Defined results: null and empty texts hold the end id alone; documents go by (id, hash of the text), null ids first;
repeated rows are stored repeatedly; an empty table gives no frames; ids outside 0 .. 2^32 - 1, and more distinct ids in a
frame than its classes can hold (about a million), raise ValueError.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranges, sliced, stage, text_view

MAGIC = b"GTF3"
BLOCK = 1024
FRAME_IDS = 8 << 20
FRAMES = 8
#: Bytes of text encoded at once.
SLICE = 16 << 20
SLOTS = 1 << 17
CLASSES, MOST_IN_CLASS = 64, 1 << 14
#: Totals: of a class's successors, and of the ids within a class.
FOLLOW, INSIDE = 1 << 14, 1 << 15
#: Bits of the shares of the orders 2 and 1, what these may take of that, and bits of the scale of the rest.
SHARE, ROOM, REST = 15, 30720, 29
#: Ids, a frame's first ones, whose neighbourhoods decide its classes; and most frequent distinct ids that place the classes.
SAMPLE, OFTEN = 1 << 18, 1 << 13
#: Places taken at once where a whole frame's would not stay in cache.
CHUNK = 1 << 17


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers of at least one that sum to ``total`` along the last axis, about in proportion to ``counts``."""
    counts = counts + 1e-9
    room = total - counts.shape[-1]
    out = 1 + np.floor(counts * (room / counts.sum(-1, keepdims=True))).astype(np.int64)
    np.put_along_axis(out, counts.argmax(-1)[..., None], np.take_along_axis(out, counts.argmax(-1)[..., None], -1) + total - out.sum(-1, keepdims=True), -1)
    return out


def _classes(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A class for each of the distinct ids: k-means over the main directions in which their neighbours differ."""
    n = len(counts)
    if n <= CLASSES:
        return np.arange(n)
    some = places[:SAMPLE]
    pair, weight = np.unique(some[:-1] * n + some[1:], return_counts=True)
    left, right = pair // n, pair % n
    by_left, by_right = np.bincount(left, weight, n) + 1, np.bincount(right, weight, n) + 1
    weight = weight / np.sqrt(by_left[left] * by_right[right])
    spread = lambda at, values, to: np.stack([np.bincount(to, weight * v[at], n) for v in values.T], 1)
    common = np.sqrt(by_right / by_right.sum())
    after = np.random.default_rng(0).normal(size=(n, 8))
    for _ in range(4):
        after = spread(left, spread(right, after, left), right)
        after = np.linalg.qr(after - np.outer(common, common @ after))[0]
    x = np.concatenate([after / np.sqrt(by_right)[:, None], spread(right, after, left) / np.sqrt(by_left)[:, None]], 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    often = np.argsort(-counts, kind="stable")[:OFTEN]
    centre = x[often[:CLASSES]]
    for _ in range(5):
        nearest = (x[often] @ centre.T).argmax(1)
        centre = np.stack([np.bincount(nearest, counts[often] * v, CLASSES) for v in x[often].T], 1)
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    nearest = (x @ centre.T).argmax(1)
    # a class holds a bounded number of ids; its rarest ones beyond that go where there is room
    by_count = np.lexsort((-counts, nearest))
    begin = np.searchsorted(nearest[by_count], np.arange(CLASSES))
    over = by_count[np.arange(n) - begin[nearest[by_count]] >= MOST_IN_CLASS]
    free = MOST_IN_CLASS - np.minimum(np.bincount(nearest, minlength=CLASSES), MOST_IN_CLASS)
    nearest[over] = np.repeat(np.arange(CLASSES), free)[: len(over)]
    return nearest


class Alphabet:
    """The distinct ids of a frame by (class, id), their intervals within the class, and how classes follow each other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, width: np.ndarray, follow: np.ndarray):
        self.ids, self.sizes, self.width, self.follow = ids, sizes, width, follow
        begin = np.cumsum(width) - width
        low = begin - np.repeat(np.arange(CLASSES) * INSIDE - np.cumsum(np.where(sizes > 0, 0, INSIDE)), sizes)
        #: class, start and width of an id within its class, packed
        self.packed = (np.repeat(np.arange(CLASSES), sizes) << 32) | (low << 16) | width
        #: by the classes of an id and of the next: share of the next, and where it starts
        self.share, self.start = np.ascontiguousarray(follow.ravel()), ((np.cumsum(follow, 1) - follow) * INSIDE).ravel()

    def interval(self, last: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of the ids at ``places``, and start and width of their part of 2^REST after the classes ``last``."""
        packed = self.packed.take(places)
        klass = packed >> 32
        pair = (last * CLASSES) + klass
        share = self.share.take(pair)
        return klass, self.start.take(pair) + share * ((packed >> 16) & 65535), share * (packed & 65535)

    def drawer(self):
        """The way back: the place that holds each point of 2^REST after the classes ``last``."""
        begin = np.concatenate([[0], np.cumsum(self.sizes)])
        klasses = np.repeat(np.tile(np.arange(CLASSES, dtype=np.uint8), CLASSES), self.share)
        spelled = np.zeros((CLASSES, INSIDE), np.int32)
        for c in np.flatnonzero(self.sizes):
            spelled[c] = np.repeat(np.arange(begin[c], begin[c + 1]), self.width[begin[c] : begin[c + 1]])
        spelled = spelled.ravel()

        def drawn(last, point):
            klass = klasses.take(last * FOLLOW + (point >> 15)).astype(np.int64)
            pair = last * CLASSES + klass
            # both below 2^29, so the quotient is exact
            spot = ((point - self.start.take(pair)) / self.share.take(pair)).astype(np.int64)
            return spelled.take((klass << 15) | spot)

        return drawn

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Alphabet, np.ndarray]:
        """The alphabet of ``ids``, and the place in it of each."""
        if int(ids.min()) < 0 or int(ids.max()) >= 1 << 32:
            raise ValueError("ids must lie in 0 .. 2^32 - 1")
        if int(ids.max()) < 1 << 22:
            counts = np.bincount(ids)
            distinct = np.flatnonzero(counts)
            counts, at = counts[distinct], np.zeros(len(counts), np.int32)
            at[distinct] = np.arange(len(distinct))
            some = at[ids[:SAMPLE]]
        else:
            distinct, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
            some = at[:SAMPLE]
        if len(distinct) > CLASSES * MOST_IN_CLASS:
            raise ValueError("too many distinct ids for a frame")
        klass = _classes(some.astype(np.int64), counts)
        order = np.lexsort((distinct, klass))
        sizes = np.bincount(klass, minlength=CLASSES)
        width = np.concatenate([_shares(counts[part], INSIDE) if len(part) else part for part in np.split(order, np.cumsum(sizes)[:-1])])
        again = np.empty(len(order), np.int32)
        again[order] = np.arange(len(order))
        if int(ids.max()) < 1 << 22:
            at[distinct] = again
            places = at[ids]
        else:
            places = again[at]
        kinds, follow = klass[order], np.zeros(CLASSES**2, np.int64)
        for k in range(0, len(places), CHUNK):
            part = kinds[places[k : k + CHUNK + 1]]
            follow += np.bincount(part[:-1] * CLASSES + part[1:], minlength=CLASSES**2)
        follow = follow.reshape(CLASSES, CLASSES)
        return cls(distinct[order], sizes, width, _shares(follow, FOLLOW)), places

    def pack(self) -> bytes:
        parts = self.sizes, self.ids, self.width, self.follow
        return zlib.compress(struct.pack("<I", len(self.ids)) + b"".join(p.astype("<u4").tobytes() for p in parts[:2]) + self.width.astype("<u2").tobytes() + self.follow.astype("<u2").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Alphabet:
        raw = zlib.decompress(data)
        (n,) = struct.unpack_from("<I", raw)
        sizes, ids = np.frombuffer(raw, "<u4", CLASSES, 4).astype(np.int64), np.frombuffer(raw, "<u4", n, 4 + 4 * CLASSES).astype(np.int64)
        width = np.frombuffer(raw, "<u2", n, 4 + 4 * (CLASSES + n)).astype(np.int64)
        follow = np.frombuffer(raw, "<u2", CLASSES**2, 4 + 4 * (CLASSES + n) + 2 * n).astype(np.int64)
        # a class of one id has all of 2^15 and a class with one successor all of 2^14, both below 2^16
        return cls(ids, sizes, width, follow.reshape(CLASSES, CLASSES))


def _turned(table: np.ndarray) -> np.ndarray:
    """The table with rows and columns changed over, some rows at a time so that they stay in cache."""
    out = np.empty(table.shape[::-1], table.dtype)
    for k in range(0, len(table), 64):
        out[:, k : k + 64] = table[k : k + 64].T
    return out


class Model:
    """What the ids of a frame say about the next id of each of its blocks.  ``predict`` and ``update`` take the first ``n``
    blocks one id further; all of them read and write the same tables.

    A cell packs what is read together: an id's place with its confidence.  Where several blocks write a cell at once, the
    last one counts."""

    def __init__(self, blocks: int):
        self.cells = [np.zeros(SLOTS, np.int32) for _ in range(2)]  # order 2, order 1: place * 4 + confidence
        # by pairs of confidences: how often the order-2 id was asked and right, and the order-1 id after it was wrong
        self.tally = np.array([[[2048, 256, 2048, 256]]] * 16, np.int64).reshape(16, 4)
        self.one, self.slots = np.zeros(blocks, np.int64), [np.zeros(blocks, np.int64)] * 2
        self.steps = 0
        self._share()

    def _share(self):
        asked, right, asked_one, right_one = self.tally.T
        first = 1 + right * ROOM // asked
        self.first, self.second = first.astype(np.uint64), (1 + right_one * (ROOM + 1 - first) // asked_one).astype(np.uint64)

    def predict(self, n: int, wide: np.ndarray):
        """Of intervals ``wide``: where the order-2 id's part ends, where the order-1 id's part ends, and a unit of the rest."""
        self.slots = [slot[:n] for slot in self.slots]
        two, one = self.known = [cells.take(slot) for cells, slot in zip(self.cells, self.slots, strict=True)]
        self.ids = two >> 2, one >> 2
        self.state = ((two & 3) << 2) | (one & 3)
        unit = wide >> np.uint64(SHARE)
        first = unit * self.first.take(self.state)
        both = first + unit * (self.second.take(self.state) * (self.ids[0] != self.ids[1]))
        return first, both, (wide - both) >> np.uint64(REST)

    def update(self, places: np.ndarray, hits: tuple[np.ndarray, np.ndarray]):
        """``hits``: whether the order-2 id was right, and whether the order-1 id was."""
        fresh = (places << 2).astype(np.int32)
        for cells, slot, cell, hit in zip(self.cells, self.slots, self.known, hits, strict=True):
            cells[slot] = np.where(hit, np.minimum(cell + 1, cell | 3), np.where(cell & 3, cell - 1, fresh))
        if not self.steps % 4:  # shares need not follow every id
            wrong, one, two, both = (np.bincount((self.state << 2) | (hits[0].view(np.int8) << 1) | hits[1], minlength=64) << 8).reshape(16, 4).T
            two, wrong = two + both, wrong + one
            self.tally += np.stack([two + wrong, two, wrong, one], 1) - (self.tally >> 5)
            self._share()
        self.steps += 1
        self.slots = [((self.one[: len(places)] * 40503 + places * 30011) >> 3) & (SLOTS - 1), places & (SLOTS - 1)]
        self.one = places


def compress(ids: np.ndarray, block: int = BLOCK) -> tuple[Alphabet | None, np.ndarray, np.ndarray]:
    """The alphabet, the output words (u16) of all blocks one after another, and how many each block has."""
    blocks = -(-len(ids) // block)
    if not blocks:
        return None, np.zeros(0, np.uint16), np.zeros(0, np.uint32)
    alphabet, places = Alphabet.of(ids)
    table = np.zeros((blocks, block), np.int32)
    table.ravel()[: len(ids)] = places
    table, places = _turned(table), None
    tail = len(ids) - (blocks - 1) * block
    model, last = Model(blocks), np.zeros(blocks, np.int64)
    low, wide = np.zeros(blocks, np.uint64), np.full(blocks, np.iinfo(np.uint64).max)
    # a row holds a word of each block
    words, at = np.zeros((3 * block + 8) * blocks, np.int32), np.arange(blocks) + blocks
    half, sixteen, top = np.uint64(48), np.uint64(16), np.uint64(1 << 48)
    for step in range(block if blocks > 1 else tail):
        n = blocks if step < tail else blocks - 1
        now = table[step, :n].astype(np.int64)
        first, both, unit = model.predict(n, wide[:n])
        two, one = model.ids[0] == now, model.ids[1] == now
        klass, start, share = alphabet.interval(last[:n], now)
        start = np.where(two, 0, np.where(one, first, both + unit * start.view(np.uint64)))
        left = np.where(two, first, np.where(one, both - first, unit * share.view(np.uint64)))
        base = low[:n] + start
        carry = np.flatnonzero(base < start)
        if len(carry):
            words[at[carry] - blocks] += 1
        # a word more of every block; those that are not ripe yet are written over
        ripe = left < top
        words[at[:n]] = (base >> half).astype(np.int32)
        at[:n] += ripe * blocks
        shift = ripe * sixteen
        base <<= shift
        left <<= shift
        more = np.flatnonzero(left < top)
        while len(more):
            words[at[more]] = (base[more] >> half).astype(np.int32)
            at[more] += blocks
            base[more] <<= sixteen
            left[more] <<= sixteen
            more = more[left[more] < top]
        low[:n], wide[:n], last[:n] = base, left, klass
        model.update(now, (two, one))
    for _ in range(4):
        words[at] = low >> half
        at += blocks
        low <<= sixteen
    counts = at // blocks
    words = words.reshape(-1, blocks)[: int(counts.max())]
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> 16
    inside = np.arange(len(words))[:, None] < counts
    inside[0] = False
    return alphabet, _turned(words.astype(np.uint16))[_turned(inside)], (counts - 1).astype(np.uint32)


def expand(alphabet: Alphabet | None, words: np.ndarray, counts: np.ndarray, total: int, block: int = BLOCK) -> np.ndarray:
    blocks = len(counts)
    if not blocks:
        return np.zeros(0, np.uint32)
    at = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])[:-1]
    source = np.concatenate([words, np.zeros(8, np.uint16)])
    wide, value = np.full(blocks, np.iinfo(np.uint64).max), np.zeros(blocks, np.uint64)
    sixteen, top = np.uint64(16), np.uint64(1 << 48)
    for _ in range(4):
        value = (value << sixteen) | source[at]
        at += 1
    tail = total - (blocks - 1) * block
    table, model, last = np.zeros((block, blocks), np.int32), Model(blocks), np.zeros(blocks, np.int64)
    drawn = alphabet.drawer()
    for step in range(block if blocks > 1 else tail):
        n = blocks if step < tail else blocks - 1
        first, both, unit = model.predict(n, wide[:n])
        value = value[:n]
        two, rest = value < first, value >= both
        one = ~(two | rest)
        point = np.minimum((value - both) // unit, np.uint64((1 << REST) - 1)).view(np.int64)
        now = np.where(rest, drawn(last[:n], point), np.where(two, *model.ids))
        klass, start, share = alphabet.interval(last[:n], now)
        left = np.where(rest, unit * share.view(np.uint64), np.where(two, first, both - first))
        value = value - np.where(rest, both + unit * start.view(np.uint64), np.where(two, 0, first))
        ripe = left < top
        shift = ripe * sixteen
        value = (value << shift) | source.take(at[:n], mode="clip") * ripe
        at[:n] += ripe
        left <<= shift
        more = np.flatnonzero(left < top)
        while len(more):
            value[more] = (value[more] << sixteen) | source.take(at[more], mode="clip")
            at[more] += 1
            left[more] <<= sixteen
            more = more[left[more] < top]
        wide, last = left, klass
        table[step, :n] = now
        # an id that both orders hold is the order-2 id's; only then may both be right
        model.update(now, (two, one | (two & (model.ids[0] == model.ids[1]))))
    return alphabet.ids.astype(np.uint32)[_turned(table).ravel()[:total]]


def _crcs(ids: np.ndarray, block: int) -> list[int]:
    raw = ids.astype("<u4", copy=False)
    return [zlib.crc32(raw[k : k + block]) for k in range(0, len(raw), block)]


def write_frame(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    alphabet, words, counts = compress(ids, block)
    packed = alphabet.pack() if alphabet else b""
    body = b"".join([
        MAGIC, struct.pack("<5I", len(doc_ids), len(ids), block, len(counts), len(packed)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        sizes.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), np.array(_crcs(ids, block), "<u4").tobytes(), packed, words.astype("<u2").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def read_frames(data: bytes):
    """(doc ids, sizes, ids) of each frame of a file; a wrong checksum raises ValueError."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError("not a token-id frame")
        docs, total, block, blocks, alphabet = struct.unpack_from("<5I", data, at + 4)
        pos = at + 24

        def part(kind, n):
            nonlocal pos
            out = np.frombuffer(data, kind, n, pos)
            pos += out.nbytes
            return out

        names, null, sizes, counts, crcs = part("<i8", docs), part("u1", docs), part("<u4", docs), part("<u4", blocks), part("<u4", blocks)
        packed, words = part("u1", alphabet), part("<u2", int(counts.sum()))
        if struct.unpack_from("<I", data, pos)[0] != zlib.crc32(data[at:pos]):
            raise ValueError("a frame's checksum does not match")
        ids = expand(Alphabet.unpack(packed.tobytes()) if alphabet else None, words, counts, total, block)
        if _crcs(ids, block) != crcs.tolist():
            raise ValueError("a block's checksum does not match")
        yield [None if x else int(d) for d, x in zip(names, null, strict=True)], sizes.astype(np.int64), ids
        at = pos + 5  # checksum and newline


def _gathered(pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` with these begins and sizes, one after another."""
    return np.concatenate([pool[:0], *(pool[ranges(begin[k : k + CHUNK], sizes[k : k + CHUNK])] for k in range(0, len(begin), CHUNK))])


class Encoder:
    """The tokenizers library on many texts, each distinct piece of text encoded once.

    A byte-level BPE tokenizer cuts a text before every blank that is followed by something visible, whatever stands around
    it, and merges nothing across.  So texts are cut there, and distinct stretches that are not known yet are cut again where
    such a tokenizer cuts for sure: between letters or digits and signs, and around a single line end.  Distinct pieces go
    through the library, many to a call, and the ids are put together.  Beyond ``MOST`` known pieces only those used again are
    kept.  Texts with an added token's string, and tokenizers of another kind, go through the library whole."""

    MOST = 500_000
    CALL = 20_000  # bytes of pieces to a string

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cutter = spec.get("pre_tokenizer") or {}
        self.cuts = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding") and spec["model"].get("type", "BPE") == "BPE" and not spec["model"].get("dropout")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        words = self.library.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(words.values(), default=0) + 1, np.int64)
        for word, i in words.items():
            self.width[i] = len(word)  # a byte-level token has one character for each byte
        # bytes after which a blank surely begins a token: visible ASCII, and first bytes of U+00C0 to U+07FF
        self.visible = np.zeros(256, bool)
        self.visible[0x21:0x7F] = self.visible[0xC3:0xE0] = True
        self.alnum, self.sign = np.zeros(256, bool), np.zeros(256, bool)
        for begin, end in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            self.alnum[begin:end] = True
        self.sign[0x21:0x7F] = ~self.alnum[0x21:0x7F]
        self.sign[0x27] = False  # an apostrophe may belong to what follows
        self._forget()

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Keep the pieces of these numbers alone."""
        if keep is None:
            keep, self.known, self.pool, self.begin = np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.known, (self.pool, sizes) = self.known.take(pa.array(keep)), self._ids(keep)
        self.begin, self.uses = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(keep), np.int64)

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of these numbers, one after another, and how many each has."""
        begin = self.begin[numbers]
        sizes = self.begin[numbers + 1] - begin
        return _gathered(self.pool, begin, sizes), sizes

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pieces that keep apart when they are joined, each with ``before``, one token or none, in
        front."""
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw, at = text_view(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pieces, pa.scalar(before, pa.large_string())))
        data, skip = raw.tobytes(), len(before)
        groups = np.append(np.flatnonzero(np.diff(at[:-1] // self.CALL, prepend=-1)), len(pieces))
        found, counts = [], []
        for a, b, ids in zip(groups[:-1].tolist(), groups[1:].tolist(), self._library([data[at[a] : at[b]].decode() for a, b in zip(groups[:-1], groups[1:], strict=True)]), strict=True):
            ends = at[a + 1 : b + 1] - at[a]
            reached = np.cumsum(self.width[ids])
            last = np.searchsorted(reached, ends)
            first = np.append(0, last[:-1] + 1)
            if last[-1] >= len(reached) or not np.array_equal(reached[last], ends) or skip and (self.width[ids[first]] != skip).any():
                parts = self._library(pieces[a:b].to_pylist())  # not cut as expected: one by one
                ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            else:
                ids, sizes = np.delete(ids, first) if skip else ids, last + 1 - first - skip
            found.append(ids)
            counts.append(sizes)
        return np.concatenate(found), np.concatenate(counts)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """The numbers that these pieces get."""
        raw, at = text_view(pieces)
        first, last, long = raw[at[:-1]], raw[at[1:] - 1], np.diff(at) > 1
        blank = long & (first == 0x20)
        blank[blank] = self.visible[raw[at[:-1][blank] + 1]]
        shown = (self.alnum | self.sign)[first] & (self.alnum | self.sign)[last]
        order = np.argsort(np.where(blank, 0, np.where(shown, 1, 2)), kind="stable")
        kinds = [pieces.take(pa.array(part)) for part in np.split(order, np.cumsum([blank.sum(), shown.sum()]))]
        parts = self._library(kinds[2].to_pylist())
        made = [self._joined(kinds[0], ""), self._joined(kinds[1], "\n"), (np.concatenate([np.zeros(0, np.int32), *parts]), np.array([len(p) for p in parts], np.int64))]
        self.known = pa.concat_arrays([self.known, *kinds])
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in made)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate([sizes for _, sizes in made]))])
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = len(self.uses) + np.arange(len(pieces))
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int64)])
        return numbers

    def _stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of text, one after another, and how many each has."""
        raw, at = text_view(stretches)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(stretches), np.int64)
        alnum, sign = self.alnum[raw], self.sign[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[at] = True
        alone = (alnum | sign)[:-2] & (raw[1:-1] == 0x0A) & self.visible[raw[2:]] & ~cut[1:-2] & ~cut[2:-1]
        cut[1:-1] |= (alnum[:-1] & sign[1:]) | (sign[:-1] & alnum[1:])
        cut[1:-2] |= alone
        cut[2:-1] |= alone
        bounds = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        found = pc.index_in(pieces.dictionary, value_set=self.known)
        new, number = np.asarray(found.is_null()), np.asarray(found.fill_null(0), np.int64)
        if new.any():
            number[new] = self._learn(pieces.dictionary.filter(pa.array(new)))
        self.uses[number] += 1
        ids, sizes = self._ids(number[np.asarray(pieces.indices)])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(upto[np.searchsorted(bounds, at)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets (texts + 1)."""
        whole = [not self.cuts or any(t in text for t in self.added) for text in texts]
        if len(self.known) > self.MOST:
            again = np.flatnonzero(self.uses > 1)
            self._forget(again if 2 * len(again) < self.MOST else None)
        # a text's words: what comes before the first blank, and what follows each; words that begin otherwise belong to the one before
        cut = pc.split_pattern(pa.array(["" if w else t for w, t in zip(whole, texts, strict=True)], pa.large_string()), " ")
        words, at = cut.flatten().dictionary_encode(), np.asarray(cut.offsets).astype(np.int64)
        index, words = np.asarray(words.indices), words.dictionary
        raw, offsets = text_view(words)
        visible = np.diff(offsets) > 0
        visible[visible] = self.visible[raw[offsets[:-1][visible]]]
        begins, first = visible[index], np.zeros(len(index), bool)
        first[at[:-1]] = begins[at[:-1]] = True
        start = np.flatnonzero(begins)
        length, first = np.diff(np.append(start, len(index))), first[start]
        plain = (length == 1) & ~first
        used = np.flatnonzero(np.bincount(index[start[plain]], minlength=len(visible)))
        others, data = [], raw.tobytes()
        for a, n, f in zip(start[~plain].tolist(), length[~plain].tolist(), first[~plain].tolist(), strict=True):
            others.append((b"" if f else b" ") + b" ".join([data[offsets[i] : offsets[i + 1]] for i in index[a : a + n].tolist()]))
        blank = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words.take(pa.array(used)), pa.scalar(" ", pa.large_string()))
        ids, sizes = self._stretches(pa.concat_arrays([blank, pa.array(others, pa.large_binary()).cast(pa.large_string())]))
        number, of_word = np.zeros(len(start), np.int64), np.zeros(len(visible), np.int64)
        of_word[used] = np.arange(len(used))
        number[plain], number[~plain] = of_word[index[start[plain]]], len(used) + np.arange(len(others))
        ids = _gathered(ids, (np.cumsum(sizes) - sizes)[number], sizes[number])
        counts = np.diff(np.concatenate([[0], np.cumsum(sizes[number])])[np.searchsorted(start, at)])
        if any(whole):
            rest = iter(self._library([t for t, w in zip(texts, whole, strict=True) if w]))
            cut = np.split(ids, np.cumsum(counts)[:-1])
            pieces = [next(rest) if w else x for w, x in zip(whole, cut, strict=True)]
            counts, ids = np.array([len(p) for p in pieces], np.int64), np.concatenate(pieces)
        return ids, np.concatenate([[0], np.cumsum(counts)])


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the files under ``path`` in ascending order of ids; the files of one
    task are numbered in order, and so are the tasks."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(text_col)).alias("hash"))
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = source.repartitionByRange(partitions, F.col("id").asc_nulls_first(), "hash").sortWithinPartitions(F.col("id").asc_nulls_first(), "hash").select("id", "text")

    def run(batches):
        encoder = _encoder(tokenizer_path)
        names, parts, held = [], [], 0

        def frame():
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([write_frame(names, np.array([len(p) for p in parts]), ids)], pa.binary())], ["frame"])

        for batch in sliced(batches, most=SLICE):
            found, at = encoder.encode(batch.column("text").to_pylist())
            for k, name in enumerate(batch.column("id").to_pylist()):
                names.append(name)
                parts.append(np.append(found[at[k] : at[k + 1]], np.int32(end_id)))
                held += len(parts[-1])
                if held >= FRAME_IDS:
                    yield frame()
                    names, parts, held = [], [], 0
        if names:
            yield frame()

    frames = dealt.mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", FRAMES).text(path)


def _stored(spark: SparkSession, path: str, made, schema: str) -> DataFrame:
    """A row for each stored document: task, file, place (its order within the file), doc_id, n_tokens, and what ``made``
    makes of a frame's ids and their offsets."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    order = ["task", "file", "place", "doc_id", "n_tokens"]

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                task, number = map(int, re.search(r"part-(\d+)-[^/]*-c(\d+)[^/]*$", name).groups())
                place = 0
                for names, sizes, ids in read_frames(data.as_buffer().to_pybytes()):
                    n = len(names)
                    column, label = made(ids, np.concatenate([[0], np.cumsum(sizes)]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(place, place + n)), pa.array(names, pa.int64()), pa.array(sizes), column], [*order, label])
                    place += n

    return files.mapInArrow(run, "task int, file int, place long, doc_id long, n_tokens long, " + schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents with their ``ids``."""
    return _stored(spark, path, lambda ids, at: (pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids)).cast(pa.list_(pa.int64())), "ids"), "ids array<long>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents with ``ids_crc32``, the crc32 of their ids as little-endian unsigned 32-bit integers."""

    def made(ids, at):
        raw = ids.astype("<u4", copy=False)
        return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()), "ids_crc32"

    return _stored(spark, path, made, "ids_crc32 long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the documents stored under ``path``.

    Running sums go over documents within a file, and over the totals of files: a few rows for each task."""
    checked = stage(read_checksums(spark, path))
    totals = checked.groupBy("task", "file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = totals.groupBy("task").agg(F.sum("total").alias("total")).select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("task_start"))
    in_task = Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = totals.select("task", "file", F.coalesce(F.sum("total").over(in_task), F.lit(0)).alias("file_start")).join(tasks, "task")
    in_file = Window.partitionBy("task", "file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = checked.withColumn("inner", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0))).join(files, ["task", "file"])
    return placed.select("doc_id", (F.col("task_start") + F.col("file_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
