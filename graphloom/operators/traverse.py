"""Neighbour expansion, adjacency indexes and breadth-first search over edge tables.

A search is a loop on the driver, one level at a time, over edges bucketed by their source.  While all that it has reached is
no more than ``LOCAL`` rows, counted anew at each level, it is kept on the driver: a level is then one pruned read of the
frontier's buckets.  Beyond that visited nodes are a table bucketed by id that grows by a level's files, and a level shuffles
its new nodes only.  Both ways give the same rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import Grown, buckets, stage_sized
from .relational import dense_index

#: Rows of a search that may be kept on the driver, and source ids that may stand in a plan as literals.
LOCAL, LITERALS = 20_000, 500
REACHED = "id long, distance int, predecessor long"
NODE = ["id", "distance", "predecessor"]


def directed(edges: DataFrame, a: str = "p1", b: str = "p2") -> DataFrame:
    """(src, dst) as stored, self-loops left out."""
    return edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("src"), F.col(b).alias("dst"))


def symmetric(edges: DataFrame, a: str = "p1", b: str = "p2", extra: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, extra) in both directions, self-loops left out; one scan of ``edges``."""
    ends = F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst"))))
    return edges.where(F.col(a) != F.col(b)).select(ends.alias("e"), *extra).select("e.src", "e.dst", *extra)


def weighted(edges: DataFrame) -> DataFrame:
    """Edges with their implicit weight, the target's id."""
    return edges.withColumn("weight", F.col("dst"))


def inside(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """The (src, dst) edges with both ends among ``nodes``."""
    known = nodes.select(F.col(key).alias("__n")).distinct()
    return edges.join(known, F.col("src") == F.col("__n"), "left_semi").join(known, F.col("dst") == F.col("__n"), "left_semi")


def edge_index(edges: DataFrame) -> DataFrame:
    """Staged distinct (src, dst), bucketed by their number and sorted by source; what searches run on."""
    return stage_sized(edges.select("src", "dst").distinct(), "src")


def check_sorted(edges: DataFrame, place: str | None = None) -> DataFrame:
    """Violations of the order an adjacency index needs: (src, dst) pairs that occur more than once and, with a ``place``
    column (0, 1, ...) that says how the list is ordered, those that do not come after their predecessor in it."""
    twice = edges.groupBy("src", "dst").count().where("count > 1").select("src", "dst")
    if place is None:
        return twice
    before = edges.select((F.col(place) + 1).alias("__place"), F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    wrong = edges.join(before, F.col(place) == F.col("__place")).where("__src > src or (__src = src and __dst >= dst)").select("src", "dst")
    return twice.union(wrong).distinct()


def positions(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Adjacency index as rows: distinct (src, dst) and their ``position`` in the list ordered by both.  No row holds all
    targets of a source, however many it has.  ``strict`` refuses pairs that occur more than once with a ValueError."""
    if strict and check_sorted(edges).limit(1).count():
        raise ValueError("a target occurs more than once for a source")
    return dense_index(edges.select("src", "dst").distinct(), ["src", "dst"], "position")


def slices(index: DataFrame) -> DataFrame:
    """(src, begin, end) of each source's slice [begin, end) of an index of ``positions``."""
    return index.groupBy("src").agg(F.min("position").alias("begin"), (F.max("position") + 1).alias("end"))


def adjacency(edges: DataFrame, strict: bool = False) -> DataFrame:
    """One row per source: sorted distinct targets as an array, and the slice they take.  For sources whose targets fit a row;
    ``positions`` and ``slices`` have no such bound."""
    index = positions(edges, strict)
    return index.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets"), F.min("position").alias("begin"), (F.max("position") + 1).alias("end"))


def neighbours(index: DataFrame, node: int) -> DataFrame:
    """(src, dst, position) of one node from an index of ``positions``."""
    return index.where(F.col("src") == node).select("src", "dst", "position")


def _local(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "distance": pa.array([r[1] for r in rows], pa.int32()), "predecessor": pa.array([r[2] for r in rows], pa.int64())})
    return spark.createDataFrame(table, REACHED)


def _at_most(df: DataFrame, bound: int) -> list | None:
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def _from(edges: DataFrame, frontier: list[int]) -> DataFrame:
    """The edges that leave a frontier on the driver."""
    if len(frontier) <= LITERALS:
        return edges.where(F.col("src").isin(frontier))
    return edges.join(F.broadcast(_local(edges.sparkSession, [(x, 0, None) for x in frontier]).select(F.col("id").alias("src"))), "src")


def _reached(leaving: DataFrame) -> DataFrame:
    return leaving.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("predecessor"))


def bfs(edges: DataFrame, sources: DataFrame, max_hops: int | None = None, target: int | None = None, local: int = LOCAL) -> DataFrame:
    """(id, distance, predecessor) of every node within ``max_hops`` of ``sources`` (id), or all reachable ones.

    ``edges`` are (src, dst), best an ``edge_index``.  The predecessor is the smallest node one step nearer; sources have none.
    With ``target`` the search ends at the level that reaches it."""
    spark, hop = edges.sparkSession, 0
    first = _at_most(sources.select("id").distinct(), local)
    if first is None:
        return _bfs_staged(edges, sources.select("id").distinct().select("id", F.lit(0).alias("distance"), F.lit(None).cast("long").alias("predecessor")), 0, max_hops, target)
    found = {r["id"]: (0, None) for r in first}
    frontier = list(found)
    while frontier and (max_hops is None or hop < max_hops) and target not in found:
        near = _at_most(_reached(_from(edges, frontier)), local - len(found))
        if near is None:
            return _bfs_staged(edges, _local(spark, [(x, *d) for x, d in found.items()]), hop, max_hops, target)
        hop += 1
        new = {r["id"]: (hop, r["predecessor"]) for r in near if r["id"] not in found}
        found |= new
        frontier = list(new)
    return _local(spark, [(x, *d) for x, d in found.items()])


def _bfs_staged(edges: DataFrame, reached: DataFrame, hop: int, max_hops: int | None, target: int | None) -> DataFrame:
    """The search from what was ``reached`` in ``hop`` steps on.  What has been visited is a table bucketed by id to which
    every level appends its files, so a level shuffles what its frontier reaches, and neither edges nor visited nodes.  It has
    the buckets of the edge index: their number goes by rows, so a level with few nodes is a few tasks."""
    visited = Grown(edges.sparkSession, "id", "distance", buckets(edges))
    visited.append(reached.select(*NODE).repartition(visited.buckets, "id"))
    while max_hops is None or hop < max_hops:
        seen = visited.table()
        if target is not None and seen.where(F.col("id") == target).limit(1).count():
            break
        hop += 1
        visited.append(next_level(edges, seen, hop))
        if not visited.table().where(F.col("distance") == hop).limit(1).count():
            break
    return visited.table().select(*NODE)


def next_level(edges: DataFrame, seen: DataFrame, hop: int) -> DataFrame:
    """The nodes one step beyond those at distance ``hop`` - 1 that are not among ``seen`` (id, distance, predecessor), dealt
    by id to the buckets that the edges have, and ``seen`` too."""
    frontier = seen.where(F.col("distance") == hop - 1).select(F.col("id").alias("src"))
    near = _reached(frontier.join(edges, "src").repartition(buckets(edges), "dst")).join(seen.select("id"), "id", "left_anti")
    return near.select("id", F.lit(hop).alias("distance"), "predecessor")


def hop_levels(edges: DataFrame, sources: DataFrame, hops: int, local: int = LOCAL) -> DataFrame:
    """(hop, id): the distinct nodes at exactly 1 .. ``hops`` steps."""
    return bfs(edges, sources, hops, local=local).where("distance > 0").select(F.col("distance").alias("hop"), "id")


def shortest_path_length(edges: DataFrame, ends: DataFrame, a: int, b: int, undirected: bool = False, local: int = LOCAL) -> DataFrame:
    """One row with the least number of steps from ``a`` to ``b``, -1 if there is no path or if either is not in ``ends`` (id).

    Where edges lead both ways (``undirected``) the search goes out from both ends in turn, the smaller frontier first, and
    ends where they meet."""
    spark = edges.sparkSession
    answer = lambda n: spark.range(1).select(F.lit(n).alias("distance"))
    known = {r["id"] for r in ends.where(F.col("id").isin([a, b])).select("id").distinct().collect()}
    if not {a, b} <= known:
        return answer(-1)
    if a == b:
        return answer(0)
    one = lambda x: spark.range(1).select(F.lit(x).cast("long").alias("id"))
    if not undirected:
        found = bfs(edges, one(a), target=b, local=local)
        return found.where(F.col("id") == b).agg(F.coalesce(F.min("distance"), F.lit(-1)).alias("distance"))
    sides = [({a: 0}, [a]), ({b: 0}, [b])]
    while True:
        side = int(len(sides[1][1]) < len(sides[0][1]))
        (seen, frontier), (other, _) = sides[side], sides[1 - side]
        near = _at_most(_from(edges, frontier).select("dst").distinct(), local - len(seen))
        if near is None:  # too large for the driver: one search, from the end with the smaller frontier
            found = bfs(edges, one((a, b)[side]), target=(a, b)[1 - side], local=0)
            return found.where(F.col("id") == (a, b)[1 - side]).agg(F.coalesce(F.min("distance"), F.lit(-1)).alias("distance"))
        hop = seen[frontier[0]] + 1
        new = [r["dst"] for r in near if r["dst"] not in seen]
        seen.update(dict.fromkeys(new, hop))
        met = [hop + other[x] for x in new if x in other]
        if met:
            return answer(min(met))
        if not new:
            return answer(-1)
        sides[side] = (seen, new)
