"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can reach across: before a word mark (unless another stands there) and around
characters that occur in no piece.  The distinct parts are concatenated and indexed by a suffix array, refined only where a
longer piece could begin (4, 8 and at most 16 characters, the longest piece).  Every piece is searched in it by bisection,
all pieces at once; the ranges found are its occurrences, the edges.  Edges are sorted by part, priority and position and
then relaxed.  An edge can be taken if its ends are symbol ends with one symbol end between; taking it merges two symbols.
In every round each part takes its first such edge, and all those that come before every other edge over the same
characters, as nothing merged elsewhere can precede them.  That is the library's merge order, ties going to the left, and
needs few rounds for parts of any length, as in texts without blanks.

Texts beyond ``CHUNK`` characters are encoded a stretch at a time, cut before a word mark.

Characters outside the vocabulary become byte pieces.  Decoding reverses the marks; malformed bytes become U+FFFD.

Defined results: null and empty texts have no ids; repeated rows each give a row; the word mark U+2581 itself in a text
encodes like a blank, as in the library, and so decodes to one; a model that is not BPE with byte fallback, or whose pieces
are longer than ``PAD`` characters, raises ValueError; extra columns pass by unread; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranges, sliced, span_hashes, text_view

MARK = 0x2581
PAD = 16
CHUNK = 1 << 20
BEFORE_WORD = re.compile(r"(?<![ ▁])[ ▁]")


@dataclass
class Vocabulary:
    """Pieces as the encoder needs them; ``load`` makes one from a model file's bytes."""

    pieces: list[str]
    normal: np.ndarray  # ids of the normal pieces
    score: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece
    prefix: bool

    def __post_init__(self):
        texts = [self.pieces[i] for i in self.normal]
        chars = sorted({c for t in texts for c in t})
        self.bits = max(1, len(chars)).bit_length()
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        if self.bits > 16 or max(map(len, texts), default=1) > PAD:
            raise ValueError("this model has too many characters or too long pieces")
        self.mark = int(self.code[MARK])
        self.single = np.full(len(chars) + 1, -1, np.int64)
        lengths = np.array([len(t) for t in texts])
        for i, t in zip(self.normal, texts, strict=True):
            if len(t) == 1:
                self.single[self.code[ord(t)]] = i
        long = np.flatnonzero(lengths > 1)
        self.ids, self.lengths = self.normal[long], lengths[long]
        self.codes = np.zeros((len(long), PAD), np.uint64)
        for row, k in enumerate(long):
            self.codes[row, : lengths[k]] = self.code[[ord(c) for c in texts[k]]]
        # edges of better score come first; equal scores share a rank, and the leftmost wins
        self.rank = np.unique(-self.score[self.ids], return_inverse=True)[1].astype(np.int64)
        self.spelled, self.spelled_at = self._spellings()

    def _spellings(self):
        out = [t.replace("▁", " ").encode() for t in self.pieces]
        normal = set(self.normal.tolist())
        for i in range(len(out)):
            if i not in normal:
                out[i] = b""
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                out[i] = bytes([b])
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def load(path: str) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    norm = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type == 4 for p in proto.pieces):
        raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
    reader = SentencePieceProcessor(model_proto=proto.SerializeToString())
    size = reader.vocab_size()
    normal = np.array([i for i in range(size) if not (reader.is_unknown(i) or reader.is_control(i) or reader.is_byte(i))], np.int64)
    byte_ids = np.array([reader.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    return Vocabulary([reader.id_to_piece(i) for i in range(size)], normal, np.array([reader.get_score(i) for i in range(size)]), byte_ids, norm.add_dummy_prefix)


def _pack(codes: np.ndarray, bits: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest 4-character keys that begin with the first ``known`` of 4 characters (columns)."""
    low = high = np.zeros(len(codes), np.uint64)
    for j in range(4):
        free = known <= j
        low = (low << np.uint64(bits)) | np.where(free, np.uint64(0), codes[:, j])
        high = (high << np.uint64(bits)) | np.where(free, np.uint64((1 << bits) - 1), codes[:, j])
    return low, high


def occurrences(text: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All (start, row of the piece) at which a piece of two or more characters stands in ``text`` (codes, 0 ends a part)."""
    bits, n = np.uint64(vocab.bits), len(text)
    wide = np.concatenate([text, np.zeros(2 * PAD, np.uint16)]).astype(np.uint64)
    key = np.zeros(n + PAD, np.uint64)
    for j in range(4):
        key = (key << bits) | wide[j : j + n + PAD]
    order = np.argsort(key[:n])
    sorted_key = key[:n][order]
    kinds = np.unique(sorted_key) if n else sorted_key
    kinds = np.union1d(kinds, np.zeros(1, np.uint64))
    rank = np.searchsorted(kinds, key).astype(np.int64)
    length = vocab.lengths

    def ranks(codes, known):
        low, high = _pack(codes, vocab.bits, known)
        return np.searchsorted(kinds, low), np.searchsorted(kinds, high, "right")

    def spread(rows, lo, hi, place):
        count = hi - lo
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return place[at], np.repeat(rows, count)

    starts, found = [], []
    rows = np.flatnonzero(length <= 4)
    low, high = _pack(vocab.codes[rows], vocab.bits, length[rows])
    for got, into in zip(spread(rows, np.searchsorted(sorted_key, low), np.searchsorted(sorted_key, high, "right"), order), (starts, found), strict=True):
        into.append(got)

    # longer pieces: the suffixes that begin with their first four characters, sorted further
    rows = np.flatnonzero(length > 4)
    first, end = ranks(vocab.codes[rows, :4], np.full(len(rows), 4))
    rows, first = rows[end > first], first[end > first]
    place = np.flatnonzero(np.isin(rank[:n], first))
    second = (rank[place] << 32) | rank[place + 4]
    sub = np.argsort(second)
    place, second = place[sub], second[sub]
    short = length[rows] <= 8
    lo4, hi4 = ranks(vocab.codes[rows, 4:8], np.minimum(length[rows] - 4, 4))
    some = short & (hi4 > lo4)
    for got, into in zip(spread(rows[some], np.searchsorted(second, (first[some] << 32) | lo4[some]), np.searchsorted(second, (first[some] << 32) | (hi4[some] - 1), "right"), place), (starts, found), strict=True):
        into.append(got)

    some = ~short & (hi4 > lo4)
    rows, eight = rows[some], (first[some] << 32) | lo4[some]
    groups = np.unique(eight)
    place = place[np.isin(second, groups)]
    group = np.searchsorted(groups, (rank[place] << 32) | rank[place + 4])
    third, fourth = rank[place + 8], rank[np.minimum(place + 12, n + PAD - 1)]
    sub = np.lexsort((fourth, third, group))
    place = place[sub]
    size = np.int64(len(kinds) + 1)
    pair = group[sub] * size + third[sub]
    pairs = np.unique(pair)
    tail = np.searchsorted(pairs, pair) * size + fourth[sub]
    lo3, hi3 = ranks(vocab.codes[rows, 8:12], np.minimum(length[rows] - 8, 4))
    whole = length[rows] > 12
    lo_4, hi_4 = ranks(vocab.codes[rows, 12:16], np.clip(length[rows] - 12, 0, 4))
    base = np.searchsorted(groups, eight) * size
    begin, end = np.searchsorted(pairs, base + lo3), np.searchsorted(pairs, base + hi3)
    low = begin * size + np.where(whole, lo_4, 0)
    high = np.where(whole & (end > begin), begin * size + hi_4, end * size)
    some = (end > begin) & (high > low)
    for got, into in zip(spread(rows[some], np.searchsorted(tail, low[some]), np.searchsorted(tail, high[some]), place), (starts, found), strict=True):
        into.append(got)
    return np.concatenate(starts), np.concatenate(found)


def segment(text: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``text`` holds parts, each followed by 0.  Returns (symbol, starts): ids at symbol starts, and where those are."""
    n = len(text)
    starts, rows = occurrences(text, vocab)
    symbol, after = vocab.single[text], np.arange(1, n + 2, dtype=np.int32)
    stops = np.flatnonzero(text == 0)
    part = np.searchsorted(stops, starts)
    rank = vocab.rank[rows]
    # by part, priority and position
    order = np.argsort((part.astype(np.int64) << 40) | (rank << 22) | starts) if n < 1 << 22 and len(vocab.rank) < 1 << 18 else np.lexsort((starts, rank, part))
    boundary = np.ones(n + 1, bool)
    _relax(starts[order].astype(np.int32), (starts[order] + vocab.lengths[rows[order]]).astype(np.int32), part[order].astype(np.int32), vocab.ids[rows[order]].astype(np.int32), symbol, after, boundary)
    return symbol, np.flatnonzero(boundary[:n] & (text > 0))


def _relax(s, e, p, piece, symbol, after, boundary) -> None:
    """Relax sorted edges s .. e: in every round as many as cannot disturb each other.

    An edge that can be taken is taken at once if it comes before every edge that shares a character with it: nothing that is
    merged elsewhere can then come between.  So is the first one of each part, which is always the next to take."""
    parts, base = int(p.max()) + 1 if len(p) else 0, int(s.min()) if len(s) else 0
    best = np.zeros(int(e.max()) - base if len(e) else 0, np.int32)
    while len(s):
        now = after[after[s]] == e
        ready = np.flatnonzero(now)
        if not len(ready):
            break
        owner = p[ready]
        take = now.copy()
        # the first edge over each character: written backwards, so that it is written last
        size = (e - s).astype(np.int64)
        order = np.arange(len(s), dtype=np.int32)[::-1]
        spot, edge = ranges(s[::-1].astype(np.int64) - base, size[::-1]), np.repeat(order, size[::-1])
        best[spot] = edge
        take[edge[best[spot] != edge]] = False
        take[ready[np.flatnonzero(np.diff(owner, prepend=-1))]] = True
        boundary[after[s[take]]] = False
        after[s[take]], symbol[s[take]] = e[take], piece[take]
        # parts with nothing to take are done; edges whose ends are inside a symbol, or that were taken, are void
        busy = np.zeros(parts, bool)
        busy[owner] = True
        alive = busy[p] & boundary[s] & boundary[e] & ~take
        s, e, p, piece = s[alive], e[alive], p[alive], piece[alive]


def encode(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another (int32), and offsets (texts + 1)."""
    prefix = "▁" if vocab.prefix else ""
    stretches, owner = [], []
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = BEFORE_WORD.search(text, at + CHUNK) if len(text) > at + CHUNK else None
            end = cut.start() if cut else len(text)
            stretches.append((prefix if not at else "") + text[at:end])
            owner.append(k)
            at = end
    if all(len(x) <= CHUNK for x in texts):
        ids, at = _encode(stretches, vocab)
    else:
        found = [_encode([x], vocab)[0] for x in stretches]
        ids, at = np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return ids, at[np.searchsorted(owner, np.arange(len(texts) + 1))]


def _encode(marked: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The same for stretches of text, none empty, that begin with a word mark where they should."""
    sizes = np.array([len(t) for t in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points == 0x20, np.uint32(MARK), points)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(marked) + 1, np.int64)
    code = vocab.code[points]
    begins = np.zeros(len(points), bool)
    begins[np.cumsum(sizes[sizes > 0])[:-1]] = True
    begins[0] = True
    mark, known = code == vocab.mark, code > 0
    begins[1:] |= mark[1:] & ~mark[:-1]
    begins |= ~known
    begins[1:] |= ~known[:-1]
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(points))
    # distinct parts; equal hashes are compared character by character, so equal means equal
    is_part = known[start]
    part_start, part_end = start[is_part], end[is_part]
    octets = np.ascontiguousarray(code).view(np.uint8)
    _, first, which = np.unique(span_hashes(octets, part_start * 2, part_end * 2), return_index=True, return_inverse=True)
    length = part_end - part_start
    if not np.array_equal(length, length[first][which]) or not np.array_equal(code[ranges(part_start, length)], code[ranges(part_start[first][which], length)]):
        first = which = np.arange(len(part_start))
    kept = length[first]
    text = np.zeros(int(kept.sum()) + len(kept), np.uint16)
    own = np.cumsum(kept + 1) - kept - 1
    text[ranges(own, kept)] = code[ranges(part_start[first], kept)]
    symbol, at = segment(text, vocab)
    ids, edge = symbol[at], np.searchsorted(at, np.append(own, len(text)))
    # put together: parts by their distinct form, other characters as the pieces of their bytes
    count, source = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    count[is_part], source[is_part] = np.diff(edge)[which], edge[:-1][which]
    other = points[start[~is_part]]
    spelled = [bytes(chr(c), "utf-8", "surrogatepass") for c in np.unique(other)]
    spelled_at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
    index = np.searchsorted(np.unique(other), other)
    count[~is_part], source[~is_part] = np.diff(spelled_at)[index], len(ids) + spelled_at[:-1][index]
    pool = np.concatenate([ids, vocab.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]]).astype(np.int32)
    doc_end = np.searchsorted(start, np.cumsum(sizes))
    return pool[ranges(source, count)], np.concatenate([[0], np.concatenate([[0], np.cumsum(count)])[doc_end]])


def decode(ids: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """Texts of id lists (ids one after another, offsets lists + 1)."""
    begin, size = vocab.spelled_at[ids], vocab.spelled_at[ids + 1] - vocab.spelled_at[ids]
    raw = vocab.spelled[ranges(begin, size)]
    at = np.concatenate([[0], np.cumsum(size)])[offsets]
    start, end = at[:-1], at[1:]
    if vocab.prefix and len(raw):
        start = start + ((end > start) & (raw[np.minimum(start, len(raw) - 1)] == 0x20) & (np.diff(offsets) > 0))
    flat = raw[ranges(start, end - start)]
    new = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    try:
        flat.tobytes().decode()
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(new), pa.py_buffer(np.ascontiguousarray(flat)))
    except UnicodeDecodeError:
        return pa.array([flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(new[:-1], new[1:], strict=True)], pa.large_string())


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = load(path)
    return _loaded[path]


def encode_column(docs: DataFrame, keep: list[str], model_path: str) -> DataFrame:
    """The ``keep`` columns, ``ids`` (array<int>), ``n_tokens`` and ``lossless`` (decoding the ids gives the text back)
    for every row's ``text``.  ``model_path`` is read where a task runs, as installed there."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("lossless", T.BooleanType(), False)])
    source = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("__text"))

    def run(batches):
        vocab = _vocabulary(model_path)
        for batch in sliced(batches, "__text"):
            texts = batch.column("__text")
            ids, offsets = encode(texts.to_pylist(), vocab)
            same = _same(decode(ids, offsets, vocab), texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(np.diff(offsets)), same], [*keep, "ids", "n_tokens", "lossless"])

    return source.mapInArrow(run, schema)


def _same(decoded: pa.Array, texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.equal(decoded, texts.cast(pa.large_string()))


def decode_column(encoded: DataFrame, keep: list[str], model_path: str, ids_col: str = "ids") -> DataFrame:
    """The ``keep`` columns and ``text``, decoded from an array of ids; a null array is the empty text."""
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("text", T.StringType())])
    source = encoded.select(*[F.col(c) for c in keep], F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))

    def run(batches):
        vocab = _vocabulary(model_path)
        for batch in batches:
            column = batch.column("__ids")
            offsets = np.asarray(column.offsets).astype(np.int64)
            ids = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), decode(ids, offsets - offsets[0], vocab).cast(pa.string())], [*keep, "text"])

    return source.mapInArrow(run, schema)
