"""N-gram Jaccard self-join and its connected components, exact, by a count-vector R-tree.

A document's set are hashes of its distinct word n-grams.  The hash space is cut into groups, and the counts of a set in
the groups are a point.  Two sets overlap by at most the sum of the coordinate minima of their points, so an R-tree over
points (boxes of coordinate maxima and size ranges) leaves out whole subtrees that cannot reach the overlap that the
similarity needs; what survives is verified on the sets.

What shares a tree.  Sets of sizes a and b that are similar differ in at most D = (1-t)/(1+t) (a+b) items.  So if the hash
space is cut into more than D groups, the sets are equal in at least one group.  A document therefore signs each of its
groups (with the size class, as D follows the size), and equal signatures meet.  With z groups to spare, at least z + 1 are
equal, and a document with at most z empty groups need not sign those; z is large enough that hardly any has more.  Of the documents that meet under a signature the
smallest id is head; a cluster is everything that shares a head, so each similar pair lies in the cluster of the head of
each signature that it shares, and still does when a cluster is joined to that of its head's own smallest head.

What need not meet.  A document with e <= z empty groups, which it does not sign, shares at least z + 1 - e signatures with
each similar one, so each of the two may leave out any (z - e) / 2 of its own and one that both keep is left (a document that
signs its empty groups leaves out none).  It leaves those heads with which it has the fewest in common: documents
that share a line and little else do not meet, however many they are, while near copies have most of their signatures in common.

Clusters are first searched by points alone (a byte for each group), which leaves only documents with a partner that they
could be similar to; large clusters in pieces, and what is left over in its piece against all others.  The texts of those are then brought together and searched breadth-first: a document is looked up in
the tree of the documents not reached yet, nearest to the cluster's mean first, so that a large group of near copies costs
one look-up of a central document rather than all pairs, while no link that joins two components is missed.

Large clusters are cut into blocks that all hold the head.  Documents that a block could not join to the head visit all
other blocks of the cluster in a second round, dealt into pieces of bounded items.  Of copies (equal sets), one for each task signs, and one in all is searched.
Components are found by label propagation with pointer jumping over staged tables.

Defined results: null and empty texts have an empty set and are alone; fewer words than n form one n-gram; repeated rows and
equal sets are in one component; rows that share an id count as one document; a null id takes part in nothing and has a
null component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import free, owned
from .common import LOWER, MIX1, SALTS, byte_table, mix, sliced, span_hashes, spans, stage, text_view
from .common import small as few

SPACE = byte_table("space")
GROUPS = 256
#: Groups of the finer counts that are compared once the sets are at hand.
FINE_GROUPS = 2048
#: Clusters of more points than this are thinned out in pieces of about half as many.
THINNED = 20_000
FAN_OUT = 16
#: Rows of a leaf when a tree is joined with itself, and count levels that are compared exactly.
LEAF, LEVELS = 256, 4
BLOCK_ITEMS = 1_000_000
FINE_ROWS = 20_000
GROWTH = 1.5
#: A signature that ``HOT`` of one id in ``ONE_IN`` have is very frequent; at most ``MOST_HOT`` such signatures are broadcast.
ONE_IN, HOT, MOST_HOT = 64, 2000, 100_000
#: Rows that are broadcast to the texts, once counted.
FEW = 500_000
#: Sets a task remembers in order to sign equal ones once.
REMEMBERED = 500_000


def sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and offsets (texts + 1)."""
    docs = len(offsets) - 1
    starts, ends, doc = spans(SPACE[raw], offsets)
    words = span_hashes(LOWER[raw], starts, ends)
    count = np.bincount(doc, minlength=docs)
    begin = np.cumsum(count) - count
    grams, owner = [], []
    with np.errstate(over="ignore"):
        if len(words) >= n:
            value = words[: len(words) - n + 1] * SALTS[0]
            for j in range(1, n):
                value = mix(value) + words[j : len(words) - n + 1 + j] * SALTS[j % len(SALTS)]
            inside = doc[: len(value)] == doc[n - 1 :]
            grams.append(mix(value[inside]))
            owner.append(doc[: len(value)][inside])
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            grams.append(np.array([_short(words[begin[d] : begin[d] + count[d]]) for d in few], np.uint64))
            owner.append(few)
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    gram, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=docs))]).astype(np.int64)


def _short(words: np.ndarray) -> np.uint64:
    value = np.array([len(words)], np.uint64) * MIX1
    for w in words:
        value = mix(value) + w * SALTS[7]
    return mix(value)[0]


class Threshold:
    """Similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must lie in (0, 1]")
        self.num, self.den = num, den
        edges, growth = [1], max(GROWTH, den / num)
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * growth))))
        #: Sizes of similar sets lie in one band, or in two that follow each other, of this logarithmic width.
        self.band = float(np.log(growth * 1.001))
        self.edges = np.array(edges, np.int64)
        self.differ = (den - num) * 2 * (self.edges[1:] - 1) // (den + num)
        self.spare = self.differ // 3 + 1
        self.parts = self.differ + 1 + self.spare

    def overlap(self, a, b):
        """The least intersection of similar sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def signatures(self, gram: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of each set, one after another, and offsets."""
        return self.signed(gram, offsets)[:2]

    def signed(self, gram: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of each set, one after another, and offsets; a signature's last bit is that of its size class.  And how
        many signatures of an even and of an odd class each set may leave out."""
        size = np.diff(offsets)
        leave = np.zeros((len(size), 2), np.int32)
        own = np.searchsorted(self.edges, size, "right") - 1
        rows, owners = [], []
        for step in (0, 1):
            level = np.maximum(own + step, 0)
            use = (size > 0) & (self.differ[level] > 0)
            if step:
                use &= size * self.den >= self.edges[level] * self.num
            picked = np.flatnonzero(use)
            if not len(picked):
                continue
            count = size[picked]
            owner = np.repeat(picked, count)
            item = gram[np.repeat(offsets[picked] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            parts = self.parts[level]
            part = ((item >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)
            new = np.ones(len(item), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            with np.errstate(over="ignore"):
                total = np.add.reduceat(mix(item ^ SALTS[3]), first)
                many = np.diff(np.append(first, len(item))).astype(np.uint64)
                rows.append(_classed(mix(total * SALTS[4] + many * SALTS[5] + _place(level[owner[first]], part[first])), level[owner[first]]))
                owners.append(owner[first])
                full = np.bincount(owner[first], minlength=len(size))
                leave[picked, level[picked] & 1] = np.maximum(full[picked] - (parts[picked] - self.spare[level[picked]]), 0) // 2
                for d in picked[full[picked] < parts[picked] - self.spare[level[picked]]]:
                    mine = part[first[owner[first] == d]]
                    empty = np.setdiff1d(np.arange(parts[d], dtype=np.uint64), mine)
                    rows.append(_classed(mix(_place(np.full(len(empty), level[d]), empty) * SALTS[6]), np.full(len(empty), level[d])))
                    owners.append(np.full(len(empty), d))
        if not rows:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), leave
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(rows)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))]).astype(np.int64), leave


def _classed(signature: np.ndarray, level: np.ndarray) -> np.ndarray:
    return (signature & ~np.uint64(1)) | (level.astype(np.uint64) & np.uint64(1))


def _place(level: np.ndarray, part: np.ndarray) -> np.ndarray:
    return mix(level.astype(np.uint64) * SALTS[1] + part * SALTS[2] + SALTS[0])


class CountTree:
    """R-tree over count vectors, packed from points sorted by size and counts; a node keeps coordinate maxima and sizes."""

    def __init__(self, counts: np.ndarray, size: np.ndarray, threshold: Threshold):
        self.threshold = threshold
        self.order = np.lexsort((*counts.T[:4], size))
        self.counts, self.size = counts[self.order], size[self.order]
        self.levels = []
        high, least, most = self.counts, self.size, self.size
        while len(high) > FAN_OUT:
            cut = np.arange(0, len(high), FAN_OUT)
            high, least, most = np.maximum.reduceat(high, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((high, least, most))

    def _open(self, at, q, n, high, least, most):
        t = self.threshold
        near = (most[at] * t.den >= n * t.num) & (least[at] * t.num <= n * t.den)
        at = at[near]
        return at[np.minimum(high[at], q).sum(1) >= t.overlap(np.maximum(least[at], -(-n * t.num // t.den)), n)]

    def search(self, q: np.ndarray, n: int, wanted: np.ndarray) -> np.ndarray:
        """Rows (of the input) that may be similar to a point ``q`` of size ``n``, among those wanted."""
        levels = self.levels[::-1]
        at = np.arange(len(levels[0][0]) if levels else len(self.size))
        for k, (high, least, most) in enumerate(levels):
            at = self._open(at, q, n, high, least, most)
            below = len(levels[k + 1][0]) if k + 1 < len(levels) else len(self.size)
            at = (at[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            at = at[at < below]
        at = at[wanted[self.order[at]]]
        return self.order[self._open(at, q, n, self.counts, self.size, self.size)]


    def paired(self) -> np.ndarray:
        """Which rows (of the input) could be similar to another one: a join of the tree with itself, leaf against leaf.

        Two leaves meet if their boxes' coordinate minima and sizes allow it.  Within a pair of leaves the sums of coordinate
        minima of all pairs are one matrix product, as min(a, b) counts the levels that both reach; levels beyond the
        ``LEVELS``-th are first bounded by the smaller of the two rests, and then summed for the pairs that are left."""
        t, n = self.threshold, len(self.size)
        found = np.zeros(n, bool)
        reach = lambda rows: np.concatenate([self.counts[rows] >= v for v in range(1, LEVELS + 1)], axis=1).astype(np.float32)
        rest = np.maximum(self.counts - LEVELS, 0).sum(1).astype(np.float32)
        cut = np.arange(0, n, LEAF)
        high, least, most = np.maximum.reduceat(self.counts, cut), np.minimum.reduceat(self.size, cut), np.maximum.reduceat(self.size, cut)
        for i, a in enumerate(cut):
            # rows are sorted by size: later leaves are larger
            near = np.flatnonzero(least[i:] * t.num <= most[i] * t.den) + i
            near = near[np.minimum(high[near], high[i]).sum(1) >= t.overlap(np.maximum(least[near], -(-least[i] * t.num // t.den)), least[i])]
            one = slice(a, a + LEAF)
            reach_one = reach(one)
            for j in near:
                b = cut[j]
                two = slice(b, b + LEAF)
                if found[one].all() and found[two].all():
                    continue
                bound = reach_one @ reach(two).T + np.minimum(rest[one, None], rest[None, two])
                x, y = self.size[one, None], self.size[None, two]
                may = (bound >= t.overlap(x, y)) & (x * t.den >= y * t.num) & (y * t.den >= x * t.num)
                if i == j:
                    np.fill_diagonal(may, False)
                self._confirm(found, *(x + y for x, y in zip(np.nonzero(may), (a, b), strict=True)))
        out = np.zeros(n, bool)
        out[self.order] = found
        return out

    def _confirm(self, found: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Mark pairs whose coordinate minima suffice without the shortcut for high levels, unless both are marked."""
        while len(left):
            open_ = ~(found[left] & found[right])
            left, right = left[open_], right[open_]
            x, y, left, right = left[:4096], right[:4096], left[4096:], right[4096:]
            ok = np.minimum(self.counts[x], self.counts[y]).sum(1) >= self.threshold.overlap(self.size[x], self.size[y])
            found[x[ok]] = found[y[ok]] = True


def counts_of(gram: np.ndarray, offsets: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    group = (gram >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(owner * groups + group, minlength=(len(offsets) - 1) * groups).reshape(-1, groups).astype(np.int32)


def _fine(gram: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts in ``FINE_GROUPS`` groups, at most 255, some rows at a time."""
    parts = []
    for a in range(0, len(offsets) - 1, 256):
        at = offsets[a : a + 257]
        parts.append(np.minimum(counts_of(gram[at[0] : at[-1]], at - at[0], FINE_GROUPS), 255).astype(np.uint8))
    return np.concatenate(parts)


def link(gram: np.ndarray, offsets: np.ndarray, visitor: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Component label (a row number) of each set of a block.  With visitors, only visitor-to-resident pairs are looked at
    (residents were linked among themselves before)."""
    n = len(offsets) - 1
    size, label = np.diff(offsets), np.arange(n)
    points = counts_of(gram, offsets)
    fine = _fine(gram, offsets) if n <= FINE_ROWS else None
    centre = points.mean(0)
    far = np.abs(points - centre * (size / max(size.mean(), 1))[:, None]).sum(1)
    tree = CountTree(points, size, threshold)

    def similar(q: int, wanted: np.ndarray) -> np.ndarray:
        rows = tree.search(points[q], int(size[q]), wanted)
        rows = rows[rows != q]
        if not len(rows):
            return rows
        if fine is not None and len(rows) > 1:
            bound = np.minimum(fine[rows], fine[q])
            rows = rows[(bound.sum(1) >= threshold.overlap(size[rows], int(size[q]))) | (bound == 255).any(1)]
            if not len(rows):
                return rows
        own = gram[offsets[q] : offsets[q + 1]]
        length = size[rows]
        item = gram[np.repeat(offsets[rows] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        at = np.minimum(np.searchsorted(own, item), len(own) - 1)
        shared = np.add.reduceat((own[at] == item).astype(np.int64), np.cumsum(length) - length)
        return rows[shared >= threshold.overlap(length, len(own))]

    if visitor.any():
        for q in np.flatnonzero(visitor):
            for r in similar(q, ~visitor):
                label[label == label[r]] = label[q]
        return label
    todo = size > 0
    by_distance = np.argsort(far, kind="stable")
    for seed in by_distance:
        if not todo[seed]:
            continue
        todo[seed] = False
        front = [seed]
        while front and todo.any():
            q = front.pop(0)
            new = similar(q, todo)
            todo[new] = False
            label[new] = seed
            front = sorted([*front, *new.tolist()], key=far.__getitem__)
    return label


def _clusters(batches, n: int, threshold: Threshold):
    """Rows sorted by (head, block): a block's texts -> (head, block, id, root id, joined to the head?)."""
    held: list[tuple] = []
    key = None
    out: list[list] = [[], [], [], [], []]

    def finish():
        ids = np.concatenate([h[0] for h in held])
        visitor = np.concatenate([h[1] for h in held])
        gram = np.concatenate([h[2] for h in held])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([h[3] for h in held]))])
        label = link(gram, offsets, visitor, threshold)
        smallest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, ids)
        root = smallest[label]
        # rows that share an id count as one document
        at_head = np.isin(label, label[ids == key[0]])
        for into, values in zip(out, (np.full(len(ids), key[0]), np.full(len(ids), key[1]), ids, root, at_head), strict=True):
            into.append(values)

    def flush():
        arrays = [np.concatenate(x) for x in out]
        for x in out:
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["head", "block", "id", "root", "joined"])

    for batch in sliced(batches):
        gram, offsets = sets(*text_view(batch.column("text")), n)
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("head", "block", "id", "visitor")]
        cuts = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(columns[0])], strict=True):
            now = int(columns[0][lo]), int(columns[1][lo])
            if key is not None and now != key:
                finish()
                held = []
            key = now
            held.append((columns[2][lo:hi], columns[3][lo:hi], gram[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1])))
        if sum(map(len, out[0])) > 20_000:
            yield flush()
    if held:
        finish()
    if out[0]:
        yield flush()


def _signed(batches, n: int, threshold: Threshold):
    """Sizes, fingerprints and points of all sets; signatures only of the first of equal sets with an id in this task."""
    known: set[tuple[int, int]] = set()
    for batch in sliced(batches):
        gram, offsets = sets(*text_view(batch.column("text")), n)
        size = np.diff(offsets)
        marks = [np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)]
        some = np.flatnonzero(size)
        with np.errstate(over="ignore"):
            for mark, salt in zip(marks, SALTS[5:7], strict=True):
                if len(some):
                    mark[some] = np.add.reduceat(mix(gram ^ salt), offsets[:-1][some])
        new = np.zeros(len(size), bool)
        has_id = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        if len(known) > REMEMBERED:
            known.clear()
        for k, pair in enumerate(zip(*(m.tolist() for m in marks), strict=True)):
            if has_id[k] and pair not in known:
                known.add(pair)
                new[k] = True
        kept = np.where(new, size, 0)
        signature, at, leave = threshold.signed(gram[np.repeat(new, size)], np.concatenate([[0], np.cumsum(kept)]))
        even, odd = (pa.array(x, mask=~new) for x in leave.T)
        points = np.minimum(counts_of(gram, offsets), 255).astype(np.uint8)
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS), len(size), [None, pa.py_buffer(np.ascontiguousarray(points))]).cast(pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signature.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), *(pa.array(m.view(np.int64)) for m in marks), packed, lists, even, odd], ["id", "size", "f1", "f2", "point", "signatures", "even", "odd"])


def _possible(points: np.ndarray, size: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Which points of a cluster could be similar to another one."""
    points = points.astype(np.int32)
    points[points == 255] = 1 << 20  # saturated: no bound in this group
    return CountTree(points, size, threshold).paired()


def _thinned(batches, threshold: Threshold):
    """Rows sorted by head and part -> the (head, id, size) that could have a partner in their part of their cluster."""
    held: list[tuple] = []
    key = None
    out: list[tuple] = []

    def finish():
        ids, size = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        points = np.frombuffer(b"".join(x for h in held for x in h[2]), np.uint8).reshape(-1, GROUPS)
        keep = _possible(points, size, threshold)
        if keep.any():
            out.append((np.full(int(keep.sum()), key[0]), ids[keep], size[keep]))

    def flush():
        arrays = [np.concatenate(c) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["head", "id", "size"])

    for batch in batches:
        heads, parts, ids, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("head", "part", "id", "size"))
        cuts = np.flatnonzero((np.diff(heads) != 0) | (np.diff(parts) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(heads)], strict=True):
            if lo == hi:
                continue
            now = int(heads[lo]), int(parts[lo])
            if key is not None and now != key:
                finish()
                held = []
            key = now
            held.append((ids[lo:hi], size[lo:hi], batch.column("point").slice(lo, hi - lo).to_pylist()))
        if sum(len(o[0]) for o in out) > 20_000:
            yield flush()
    if held:
        finish()
    if out:
        yield flush()


def _thin(points: DataFrame, threshold: Threshold) -> DataFrame:
    """(head, id, size) of those ``points`` (head, part, id, size, point) that could have a partner in their part."""
    dealt = points.repartition("head", "part").sortWithinPartitions("head", "part")
    return dealt.mapInArrow(lambda batches: _thinned(batches, threshold), "head long, id long, size long")


def _thinned_in_pieces(points: DataFrame, threshold: Threshold) -> DataFrame:
    """Like ``_thin``, for clusters that are too large for a task: (head, id, size) of ``points`` (head, id, size, point).

    Each two similar sizes share a pair of neighbouring bands.  The points of such a pair are dealt into pieces; those that
    find no partner in their own piece are, some at a time, put beside each piece."""
    low = F.floor(F.log(F.col("size").cast("double")) / threshold.band)
    banded = points.withColumn("band", F.explode(F.array(low - 1, low)))
    pieces = banded.groupBy("head", "band").agg(F.ceil(F.count("*") / (THINNED // 2)).cast("long").alias("pieces"))
    dealt = stage(banded.join(pieces, ["head", "band"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))))
    part = lambda *names: F.xxhash64(*names).alias("part")
    own = stage(_thin(dealt.select("head", part("band", "piece"), "id", "size", "point"), threshold).distinct())
    rest = dealt.join(own.select("head", "id").distinct(), ["head", "id"], "left_anti").where("pieces > 1")
    guests = rest.groupBy("head", "band").agg(F.ceil(F.count("*") / (THINNED // 2)).cast("long").alias("guests"))
    rest = stage(rest.join(guests, ["head", "band"]).withColumn("guest", F.pmod(F.xxhash64("id", F.lit(1)), F.col("guests"))))
    if not rest.limit(1).count():
        return own
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["head", "band", "piece", "guest", "id", "size", "point"]
    visits = rest.drop("piece").withColumn("piece", every("pieces")).select(columns)
    hosts = dealt.join(guests, ["head", "band"]).withColumn("guest", every("guests")).select(columns)
    # a guest that is dealt to its own piece is there already
    both = hosts.union(visits).dropDuplicates(["head", "band", "piece", "guest", "id", "size", "point"])
    return own.union(_thin(both.select("head", part("band", "piece", "guest"), "id", "size", "point"), threshold)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id of each connected component, for every id in ``edges`` (a, b).

    Every round takes the smallest label of the neighbours, then the label of that label."""
    both = stage(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    label = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        best = label.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = stage(best.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = after.where("old <> label").limit(1).count()
        label = after.select("id", "label")
        if not changed:
            return label.withColumnRenamed("label", "component")


def _heads(signed: DataFrame) -> DataFrame:
    """(id, head, class, n): for each signature of an id, the smallest id that has it, where that is another one; n is how many
    of the (even or odd) class share that head.

    Signatures that are very frequent among one id in ``ONE_IN`` get their smallest id by a partial aggregation, and that id
    is broadcast, so that no task orders all that have such a signature; the result is the same for every signature."""
    met = signed.where(F.col("id").isNotNull()).select("id", "signatures")
    some = met.where(F.pmod(F.xxhash64("id"), F.lit(ONE_IN)) == 0).select(F.explode("signatures").alias("signature"))
    hot = stage(some.groupBy("signature").count().where(F.col("count") >= HOT).select("signature"))
    rows = met.select("id", F.explode("signatures").alias("signature"))
    first = F.first("id").over(Window.partitionBy("signature").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    counted = lambda some: some.where("id <> head").groupBy("id", "head", F.col("signature").bitwiseAND(F.lit(1)).alias("class")).agg(F.count("*").alias("n"))
    headed = lambda some: counted(some.select("id", "signature", first.alias("head")))
    n = hot.limit(MOST_HOT + 1).count()
    if not 0 < n <= MOST_HOT:  # none, or so many that no one of them is a task's burden
        return headed(rows)
    top = stage(rows.join(F.broadcast(hot), "signature", "left_semi").groupBy("signature").agg(F.min("id").alias("head")))
    both = headed(rows.join(F.broadcast(hot), "signature", "left_anti")).union(counted(rows.join(F.broadcast(top), "signature").select("id", "signature", "head")))
    return both.groupBy("id", "head", "class").agg(F.sum("n").alias("n"))


def _kept(shared: DataFrame, signed: DataFrame) -> DataFrame:
    """The distinct (id, head) of ``shared`` (id, head, class, n signatures) that are left when each id leaves out what it may
    of each class, heads with the fewest signatures first.  An id with several sets leaves out what each of them may."""
    may = signed.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("even").alias("even"), F.min("odd").alias("odd"))
    most = F.when(F.col("class") == 1, F.col("odd")).otherwise(F.col("even"))
    left = F.sum("n").over(Window.partitionBy("id", "class").orderBy("n", "head").rowsBetween(Window.unboundedPreceding, 0))
    return shared.join(may, "id").select("id", "head", (left > most).alias("kept")).where("kept").select("id", "head").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links).  Staged; what it took on
    the way is freed."""
    with owned() as passing:
        out = _near_duplicates(docs, n, Threshold(num, den), id_col, text_col)
    out = stage(out)
    free(passing)
    return out


def _near_duplicates(docs: DataFrame, n: int, threshold: Threshold, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with owned() as passing:
        signed = stage(source.mapInArrow(lambda batches: _signed(batches, n, threshold), "id long, size long, f1 long, f2 long, point binary, signatures array<long>, even int, odd int"))
        heads = _kept(stage(_heads(signed)), signed)
    # nothing needs the signatures once the pairs are known
    pairs, signed = stage(heads), stage(signed.drop("signatures", "even", "odd"))
    free(passing)
    # copies: the smallest id stands for all equal sets
    kind = ["f1", "f2", "size"]
    filled = signed.where(F.col("id").isNotNull() & (F.col("size") > 0)).select("id", *kind)
    first = stage(filled.groupBy(*kind).agg(F.min("id").alias("rep")))
    # staged before and after, so that the join stands alone and can be split where one set has very many copies
    alias = stage(stage(filled.join(first, kind).select("id", "size", "rep")).distinct())
    named = pairs.join(alias.select("id", F.col("rep").alias("member")), "id").join(alias.select(F.col("id").alias("head"), F.col("rep").alias("lead")), "head")
    named = stage(named.where("member <> lead").select(F.col("lead").alias("head"), F.col("member").alias("id")).distinct())
    # a head that has a head itself passes its cluster, itself included, on to that one, so that families meet once and not
    # under many heads
    above = named.groupBy("id").agg(F.min("head").alias("above")).withColumnRenamed("id", "head")
    own = named.union(named.select("head", F.col("head").alias("id")).distinct())
    members = stage(own.join(above, "head", "left").select(F.coalesce("above", "head").alias("head"), "id").distinct())
    points = signed.where("size > 0").join(alias.where("id = rep").select("id").distinct(), "id", "left_semi").select("id", "size", "point")
    placed = members.join(points, "id").select("head", "id", "size", "point")
    large = members.groupBy("head").count().where(F.col("count") > THINNED).select("head")
    small = placed.join(large, "head", "left_anti").select("head", F.lit(0).cast("long").alias("part"), "id", "size", "point")
    weighed = _thin(small, threshold)
    if large.limit(1).count():
        weighed = weighed.union(_thinned_in_pieces(placed.join(large, "head", "left_semi"), threshold))
    weighed = stage(weighed)
    blocks = weighed.groupBy("head").agg(F.ceil(F.sum("size") / BLOCK_ITEMS).cast("int").alias("blocks"))
    # the head is in every block, even where it has no partner itself
    heads = weighed.select("head", F.col("head").alias("id"))
    placed = weighed.select("head", "id").union(heads).distinct().join(blocks, "head").select("head", "id", "blocks", F.explode(F.when(F.col("id") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))).alias("block"), F.lit(False).alias("visitor"))
    placed = stage(placed)

    def linked(members: DataFrame) -> DataFrame:
        # few members come to the texts, so that only theirs are moved; many meet all texts in a shuffle
        texts = source.where(F.col("id").isNotNull()).join(few(stage(members), FEW), "id").select("head", "block", "id", "visitor", "text")
        dealt = texts.repartition("head", "block").sortWithinPartitions("head", "block", "id")
        return stage(dealt.mapInArrow(lambda batches: _clusters(batches, n, threshold), "head long, block long, id long, root long, joined boolean"))

    linked_first = linked(placed.drop("blocks"))
    edges = linked_first.select(F.col("id").alias("a"), F.col("root").alias("b"))
    large = placed.where("blocks > 1")
    apart = stage(linked_first.where("not joined").join(large.select("head", "blocks").distinct(), "head").select("head", "blocks", "id", "block").distinct())
    if apart.limit(1).count():
        # the visitors of a block come in pieces of bounded items, each with the block's residents
        sized = apart.join(weighed.groupBy("head", "id").agg(F.sum("size").alias("size")), ["head", "id"])
        shares = sized.groupBy("head").agg(F.ceil(F.sum("size") / BLOCK_ITEMS).cast("long").alias("shares"))
        numbered = lambda share: (F.col("block") * F.col("shares") + share).alias("block")
        visits = apart.join(shares, "head").select("head", "id", "shares", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))).alias("block"))
        visits = visits.select("head", "id", numbered(F.pmod(F.xxhash64("id", F.lit(1)), F.col("shares"))), F.lit(True).alias("visitor"))
        hosts = large.join(shares, "head").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select("head", "id", numbered(F.col("share")), "visitor")
        visited = hosts.join(visits.select("head", "block").distinct(), ["head", "block"], "left_semi").select("head", "id", "block", "visitor")
        second = linked(visited.unionByName(visits))
        edges = edges.union(second.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # an id with several sets joins what stands for them
    shared = alias.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).where("b <> c").select("id", "b")
    edges = edges.union(alias.join(shared, "id").select(F.col("rep").alias("a"), "b"))
    found = components(edges)
    chosen = first.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*kind, F.coalesce("component", "rep").alias("component"))
    k = [F.col(c).alias(f"__{c}") for c in kind]
    out = signed.select("id", *kind).join(chosen.select(*k, "component"), (F.col("size") > 0) & F.col("id").isNotNull() & (F.col("f1") == F.col("__f1")) & (F.col("f2") == F.col("__f2")) & (F.col("size") == F.col("__size")), "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose id is the smallest of its component, one row of each; rows with a
    null id stay."""
    found = near_duplicates(docs, n, num, den)
    ids = lambda df: few(stage(df.select(F.col("doc_id").alias("__id")).distinct()), FEW)
    rest = docs.join(ids(found.where(F.col("doc_id") != F.col("component_id"))), F.col("doc_id") == F.col("__id"), "left_anti")
    # of rows that share an id one stays; only those are put in order
    again = ids(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = rest.join(again, F.col("doc_id") == F.col("__id"), "left_semi").withColumn("__place", first).where("__place = 1").drop("__place")
    return rest.join(again, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(one)
