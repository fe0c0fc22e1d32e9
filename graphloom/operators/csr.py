"""Compressed sparse rows of a graph over dense node numbers: offsets for every node, slots in the order of the edge list.

Building takes an edge list that is ordered already and refuses one that is not.  The list is cut into ranges of places; each
range is swept once, and its last edge is carried over into the next.  Slots are written a folder for each range, so that a
node's slice, whose begin and end its offsets give, is read from the folders that hold it.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage, stage_bucketed, staged_path
from .relational import RANGE_ROWS, _before, ranged

#: Nodes in a row that one step of filling a gap lists.
GAP = 100_000


class EdgesNotSorted(ValueError):
    """The first edge that does not come after its predecessor: its place, ends, and whether it is repeated or unsorted."""

    def __init__(self, place: int, src: int, dst: int, kind: str):
        super().__init__(f"the edge {src} -> {dst} at place {place} is {kind}")
        self.place, self.src, self.dst, self.kind = place, src, dst, kind


@dataclass
class Csr:
    """``offsets``: (node, begin, end) of nodes 0 .. ``nodes`` - 1, bucketed by node, those without edges too.  ``slots``:
    (position, src, dst, weight, part), the weight being the target.  ``starts``: the first position of each part."""

    nodes: int
    edges: int
    offsets: DataFrame
    slots: DataFrame
    starts: list[int]

    def slice_of(self, node: int) -> tuple[int, int] | None:
        """Where a node's slots begin and end, None for a node that the graph does not have.  Reads one bucket."""
        row = self.offsets.where(F.col("node") == node).select("begin", "end").first()
        return None if row is None else (row["begin"], row["end"])

    def degree(self, node: int) -> int | None:
        found = self.slice_of(node)
        return None if found is None else found[1] - found[0]

    def read(self, begin: int, end: int) -> DataFrame:
        """The slots [begin, end), from the parts that hold them."""
        parts = range(max(0, bisect_right(self.starts, begin) - 1), bisect_right(self.starts, end - 1)) if end > begin else ()
        return self.slots.where(F.col("part").isin(list(parts)) & F.col("position").between(begin, end - 1))

    def neighbours(self, node: int) -> DataFrame:
        """(position, src, dst, weight) of a node's slots; none for an unknown node."""
        return self.read(*(self.slice_of(node) or (0, 0))).select("position", "src", "dst", "weight")

    def kth(self, node: int, k: int) -> DataFrame:
        """The slot of a node's k-th neighbour, counted from 0; no row if it has fewer."""
        begin, end = self.slice_of(node) or (0, 0)
        return self.read(begin + k, begin + k + (0 <= k < end - begin)).select("position", "src", "dst", "weight")


def _swept(edges: DataFrame, place: str, rows: int) -> DataFrame:
    """Staged edges with the edge before each (__s, __d; null for the first) and their position."""
    cut = ranged(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col(place).cast("long").alias("__place")), ["__place"], rows)
    inside = Window.partitionBy("__range").orderBy("__place")
    last = cut.groupBy("__range").agg(F.max_by(F.struct("src", "dst"), "__place").alias("last"))
    by_range = Window.orderBy("__range")  # a row for each range
    carried = last.select("__range", F.lag("last").over(by_range).alias("__carried"))
    own = cut.withColumn("__own", F.lag(F.struct("src", "dst")).over(inside)).withColumn("__nth", F.row_number().over(inside) - 1)
    both = own.join(F.broadcast(carried), "__range").join(F.broadcast(_before(cut, F.count("*"))), "__range").withColumn("__last", F.coalesce("__own", "__carried"))
    return stage(both.select("__range", "__place", "src", "dst", (F.col("__before") + F.col("__nth")).alias("position"), F.col("__last.src").alias("__s"), F.col("__last.dst").alias("__d")))


def faults(edges: DataFrame, place: str, rows: int = RANGE_ROWS) -> DataFrame:
    """(place, src, dst, fault) of the edges of a list, ordered by ``place``, that do not come after their predecessor."""
    return _faults(_swept(edges, place, rows))


def _faults(swept: DataFrame) -> DataFrame:
    equal = (F.col("__s") == F.col("src")) & (F.col("__d") == F.col("dst"))
    later = (F.col("__s") > F.col("src")) | ((F.col("__s") == F.col("src")) & (F.col("__d") > F.col("dst")))
    return swept.where(equal | later).select(F.col("__place").alias("place"), "src", "dst", F.when(equal, "repeated").otherwise("unsorted").alias("fault"))


def from_sorted(edges: DataFrame, place: str, nodes: int | None = None, rows: int = RANGE_ROWS) -> Csr:
    """The index of an edge list (src, dst) whose order ``place`` gives; ends are node numbers from 0.

    Raises EdgesNotSorted at the first edge that is not after its predecessor.  There are as many nodes as the greatest number
    says, or ``nodes`` if that is more."""
    swept = _swept(edges, place, rows)
    wrong = _faults(swept).orderBy("place").first()
    if wrong is not None:
        raise EdgesNotSorted(*wrong)
    count, most = swept.agg(F.count("*"), F.max(F.greatest("src", "dst"))).first()
    nodes = max(nodes or 0, 0 if most is None else most + 1)
    starts = {r["__range"]: r["first"] for r in swept.groupBy("__range").agg(F.min("position").alias("first")).collect()}  # a row for each range
    path = staged_path(swept.sparkSession)
    slots = swept.select("position", "src", "dst", F.col("dst").alias("weight"), F.col("__range").alias("part"))
    slots.repartition(max(1, len(starts)), "part").sortWithinPartitions("part", "position").write.partitionBy("part").parquet(path)
    read = swept.sparkSession.read.schema("position long, src long, dst long, weight long, part int").parquet(path)
    order = sorted(starts)
    return Csr(nodes, count, stage_bucketed(_offsets(swept, count, nodes), "node"), read, [starts[k] for k in order])


def _offsets(swept: DataFrame, count: int, nodes: int) -> DataFrame:
    """Offsets of all nodes: of those with edges from their slots, of others from the edge that follows them in the list."""
    held = swept.groupBy(F.col("src").alias("node")).agg(F.min("position").alias("begin"), (F.max("position") + 1).alias("end"))
    end = swept.agg(F.coalesce(F.max("src"), F.lit(-1)).alias("__s")).select(F.lit(nodes).cast("long").alias("src"), "__s", F.lit(count).cast("long").alias("position"))
    gaps = swept.select("src", F.coalesce("__s", F.lit(-1)).alias("__s"), "position").where("src > __s + 1").unionByName(end.where("src > __s + 1"))
    stretches = gaps.select("src", "position", F.explode(F.sequence(F.col("__s") + 1, F.col("src") - 1, F.lit(GAP).cast("long"))).alias("at"))
    empty = stretches.select(F.explode(F.sequence("at", F.least(F.col("at") + GAP - 1, F.col("src") - 1))).alias("node"), F.col("position").alias("begin"), F.col("position").alias("end"))
    return held.unionByName(empty)
