"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors are integers (``floor(scale * x)``).  Candidates are dealt into blocks by a hash of their id; a block's index has,
for every dimension, one posting segment for each quantised component level.  A query turns every segment into a gain over
the worst segment of its dimension: the segment's impact.  Segments are read by descending impact, each adding its gain to
the accumulators of its postings.  From time to time the search asks for proof.  With t the largest impact unread, a vector
whose accumulator is a and that was met in m dimensions scores between a and a + slack + (sum over dimensions of the
smaller of t and the dimension's largest gain) - m t, as it was met wherever its gain is above t.  A query stops only when
the vectors whose upper bound reaches the k-th lower bound are few, and those are scored exactly.  Without an early proof
every segment is read, and the same test picks the vectors to score.

Vectors with a component of ``WIDE`` or more stand beside the index and are scored one by one, in whole numbers of any size;
so are all vectors for a query whose gains would not fit the accumulators.

Every block sees every query; that is the stated query set against all rows, in blocks.  A task holds one block, whose size
is bounded in components, so long vectors make more blocks and not larger ones.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; components beyond the
range of a long count as its ends, and so do scores, after ranking; vectors of different lengths do not meet; rows with the
query's own id are never its candidates; repeated rows are separate candidates, while identical query rows count once; equal
scores go to the smaller id; fewer candidates give fewer rows; null ids are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges

TOGETHER = 128  # queries to an output batch
#: Vectors of a block, as long as there are no more task slots than blocks, and components, at most.  A block's index takes
#: about six times its vectors as whole numbers, so some 200 MB for BLOCK_CELLS components, whatever the vectors' length.
LEAST_BLOCK, BLOCK_CELLS = 4096, 1 << 22
LEVEL = 2  # width of a quantised impact level
ROUNDS = 16  # how often a query asks for proof
WIDE = 1 << 14
FITS = 1 << 36  # bound on a vector's gains, so that they and the count of dimensions are exact in a double


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, as whole numbers of any size where a long might not do."""
    if not vectors.size:
        return np.zeros(len(vectors), np.int64)
    largest = max(abs(int(vectors.min())), abs(int(vectors.max()))) * max(abs(int(query.min())), abs(int(query.max()))) * len(query)
    return vectors @ query if largest < 1 << 62 else vectors.astype(object) @ query.astype(object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype != object:
        order = np.lexsort((ids, -scores))[:k]
    else:
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return ids[order], scores[order]


class Block:
    """The impact-ordered index of one block of vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        wide = (np.maximum(vectors, -(vectors + 1)) >= WIDE).any(1)
        self.wide_ids, self.wide = ids[wide], vectors[wide]
        self.ids, self.vectors = ids[~wide], vectors[~wide]
        level = self.vectors // LEVEL
        n, dims = self.vectors.shape
        # postings by dimension and level; a segment is a run of them
        order = np.argsort(level, axis=0, kind="stable")
        ranked = np.take_along_axis(level, order, 0)
        new = np.ones((n, dims), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.members = np.ascontiguousarray(order.T).ravel()
        self.begin = np.flatnonzero(new.T.ravel())
        self.size = np.diff(np.append(self.begin, n * dims))
        self.dims, self.low = self.begin // max(n, 1), ranked.T.ravel()[self.begin] * LEVEL
        self.first = np.flatnonzero(np.diff(self.dims, prepend=-1))
        self.read = self.held = 0  # postings read, and postings there were, over all queries

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the best k candidates of one query."""
        near, scores = self._indexed(own, query, k)
        other = self.wide_ids != own
        if other.any():
            wide = _exact(self.wide[other], query)
            near, scores = np.concatenate([near, self.wide_ids[other]]), np.concatenate([scores.astype(wide.dtype), wide]) if wide.dtype == object else np.concatenate([scores, wide])
        return _best(near, scores, k)

    def _indexed(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        allowed = np.flatnonzero(self.ids != own)
        if len(allowed) <= 16 * k:
            return self.ids[allowed], _exact(self.vectors[allowed], query)
        if max(abs(int(query.min())), abs(int(query.max()))) >= WIDE:
            return _best(self.ids[allowed], _exact(self.vectors[allowed], query), k)
        weight = query[self.dims]
        least = np.minimum(weight * self.low, weight * (self.low + LEVEL - 1))
        gain = least - np.repeat(np.minimum.reduceat(least, self.first), np.diff(np.append(self.first, len(least))))
        most = np.maximum.reduceat(gain, self.first)
        if int(most.sum()) >= FITS or len(query) >= 1 << 16:
            return _best(self.ids[allowed], _exact(self.vectors[allowed], query), k)
        slack = int(np.abs(query).sum()) * (LEVEL - 1)
        order = np.argsort(-gain, kind="stable")
        upto = np.cumsum(self.size[order])
        stops = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], ROUNDS + 1)[1:]) + 1)
        n, done, self.held = len(self.ids), 0, self.held + int(upto[-1])
        total = np.zeros(n)
        for stop in np.minimum(stops, len(order)).tolist():
            some = order[done:stop]
            done = stop
            total += np.bincount(self.members[ranges(self.begin[some], self.size[some])], np.repeat(gain[some] + np.float64(FITS), self.size[some]), n)
            met = np.floor(total / FITS)
            sure = total - met * FITS
            unread = int(gain[order[done]]) if done < len(order) else 0
            lower = sure[allowed]
            floor_ = np.partition(lower, -k)[-k]
            possible = allowed[lower + (slack + int(np.minimum(most, unread).sum())) - met[allowed] * unread >= floor_]
            if done == len(order) or len(possible) <= max(16 * k, n // 64):
                break
        self.read += int(upto[done - 1])
        return _best(self.ids[possible], _exact(self.vectors[possible], query), k)


def _search(batches, k: int):
    """Rows arrive sorted by (block, is_query): a block's vectors, then the queries that visit it."""
    block, width, held, index = None, None, [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__block", "__dim")], 1)
        is_query = batch.column("__query").to_numpy(zero_copy_only=False)
        ids = batch.column("__id").to_numpy(zero_copy_only=False)
        flat = batch.column("__vec")
        cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(1) | (np.diff(is_query) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if hi == lo:
                continue
            if block is None or (key[lo] != block).any():
                block, width, held, index = key[lo], int(key[lo][1]), [], None
            part = flat.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(hi - lo, width)
            if not is_query[lo]:
                held.append((ids[lo:hi], part))
                continue
            if not held:
                continue
            if index is None:
                index = Block(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            for at in range(0, len(part), TOGETHER):
                out = [(own, query, *index.search(own, query, k)) for own, query in zip(ids[lo + at : min(hi, lo + at + TOGETHER)].tolist(), part[at : at + TOGETHER], strict=True)]
                n = [len(x[2]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([x[0] for x in out], n).astype(np.int64)),
                        pa.array(np.repeat([_key(x[1]) for x in out], n).astype(np.int64)),
                        pa.array(np.concatenate([x[2] for x in out]).astype(np.int64)),
                        pa.array([_long(score) for x in out for score in x[3].tolist()], pa.int64()),
                        pa.array([_surplus(score) for x in out for score in x[3].tolist()], pa.float64()),
                    ],
                    ["query_id", "__q", "vec_id", "score", "__beyond"],
                )


ENDS = -(1 << 63), (1 << 63) - 1


def _long(score: int) -> int:
    return min(max(score, ENDS[0]), ENDS[1])


def _surplus(score: int) -> float:
    """How far a score lies beyond the range of a long: ranks scores that are cut to it."""
    return float(score - _long(score))


def _key(vector: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(vector.tobytes())).astype(np.int64))


def _whole(value):
    """The floor of a double as a long, the ends of its range standing for what lies beyond."""
    edge = float(1 << 62)
    return F.when(value >= edge * 2, F.lit(ENDS[1])).when(value < -edge * 2, F.lit(-ENDS[1] - 1)).otherwise(F.floor(F.when(F.abs(value) < edge * 2, value).otherwise(0.0)).cast("long"))


def blocks_for(n: int, cells: int, slots: int) -> int:
    """How many blocks hold ``n`` vectors of ``cells`` components in all: one for each task slot while they have LEAST_BLOCK
    vectors, and as many as keep blocks within BLOCK_CELLS components (a single vector may have more)."""
    return max(1, min(slots, n // LEAST_BLOCK), -(-cells // BLOCK_CELLS))


def top_k(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int | None = None) -> DataFrame:
    """The ``k`` best candidates of every query row.

    ``is_query`` is a Column over ``vectors``.  Returns query_id, rank (from 1), vec_id, score.
    """
    x = F.col("__vec")
    ready = (
        vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).alias("__vec"), F.coalesce(is_query, F.lit(False)).alias("__q"))
        .where(F.col("__id").isNotNull() & x.isNotNull() & (F.size(x) > 0))
        .where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf")))))
        .select("__id", "__q", F.transform(x, lambda v: _whole(v.cast("double") * scale)).alias("__vec"))
        .withColumn("__dim", F.size("__vec"))
    )
    n, cells = ready.agg(F.count("*"), F.coalesce(F.sum("__dim"), F.lit(0))).first()
    blocks = -(-n // block) if block else blocks_for(n, cells, vectors.sparkSession.sparkContext.defaultParallelism)
    mine = ready.select(F.pmod(F.xxhash64("__id", "__vec"), F.lit(blocks)).cast("int").alias("__block"), "__dim", F.lit(False).alias("__query"), "__id", "__vec")
    asked = (
        ready.where("__q").select("__id", "__vec", "__dim").distinct()
        .select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"), "__dim", F.lit(True).alias("__query"), "__id", "__vec")
    )
    dealt = mine.unionByName(asked).repartition(blocks, "__block").sortWithinPartitions("__block", "__dim", "__query")
    found = dealt.mapInArrow(lambda batches: _search(batches, k), "query_id long, __q long, vec_id long, score long, __beyond double")
    best = Window.partitionBy("query_id", "__q").orderBy(F.desc("score"), F.desc("__beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
