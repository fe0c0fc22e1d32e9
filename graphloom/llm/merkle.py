"""Merkle manifest of a table: bottom-up build, top-down proof push.  DataFrame functions only.

Every row is a leaf, every group (a null group is one of its own) a tree over its leaves, and the trees' roots are the
leaves of one more tree.  Each level is a staged table in which a node holds the hashes of its run of children; the next
level is one aggregation of it, so a level costs a shuffle of its nodes and no task sees more than a run.  Proofs go down
the same tables: children are joined to their parents, and each prepends its siblings to what its parent inherited.  A row's
place in its tree comes from ranges cut at sampled (group, order) keys, so a group with most of all rows is spread over
many tasks.

``H`` is sha256 as lowercase hex text of its inputs put together, digests as their hex text.

Defined results: a null value is ``-`` in a leaf, an empty text ``0:``; rows of a null id come first, ties are ordered by
leaf (rows that agree in both are the same leaf twice); a group of one row has that leaf as its root, and likewise one group
for the whole table; the proof of a leaf without siblings anywhere is H of nothing; columns beyond the hashed ones do not
matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import dense_index
from .common import small, stage

#: Nodes in a run.
FAN = 8
#: Rows that one task orders: at least ``FEWEST`` as long as there are tasks enough, never more than about ``MOST``.
FEWEST, MOST = 10_000, 1_000_000
SMALL = 500_000


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def spelled(value: Column) -> Column:
    """A value as it stands in a leaf: ``-`` if null, otherwise its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_of(group: Column) -> Column:
    """A text that tells groups, null among them, apart and orders them: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return digest(*map(spelled, columns))


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``place`` (from 0) within their tree by ``order``, and the ``size`` of the tree."""
    n = rows.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-n // MOST), min(-(-n // FEWEST), tasks))
    cut = stage(rows.repartitionByRange(ranges, tree, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(tree).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(tree, "__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("size", F.sum("__n").over(Window.partitionBy(tree)))
    inside = F.row_number().over(Window.partitionBy("__range", tree).orderBy(*order)) - 1
    # a row for each range and tree in it
    joined = cut.withColumn("__inside", inside).join(small(stage(sizes.drop("__n")), SMALL), [tree, "__range"])
    return joined.withColumn("place", F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def build(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The levels of all trees over ``leaves`` (tree, place, size, hash, further columns), themselves the first.

    Above them a row is (tree, place, size, hash, children): ``size`` counts the nodes of its tree on its level, so a row of
    size 1 is a root, and trees of all heights share the tables."""
    levels = [leaves]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        runs = levels[-1].where("size > 1").groupBy("tree", F.expr(f"place div {fan}").alias("place"), F.expr(f"(size + {fan - 1}) div {fan}").alias("size"))
        listed = runs.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]).alias("children"))
        levels.append(stage(listed.select("tree", "place", "size", F.sha2(F.array_join("children", ""), 256).alias("hash"), "children")))
        most = -(-most // fan)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash): the root of each tree."""
    found = None
    for level in levels:
        one = level.where("size = 1").select("tree", "hash")
        found = one if found is None else found.unionByName(one)
    return found


def push(levels: list[DataFrame], inherited: DataFrame, fan: int = FAN) -> DataFrame:
    """The rows of the first level with ``steps``, their proofs: from the leaf's own run upwards, what stands before and after
    the node in its run.  ``inherited`` has, for each tree, the ``steps`` that follow its root and any columns that its
    leaves shall have too."""
    also = [c for c in inherited.columns if c not in ("tree", "steps")]
    begun = small(inherited, SMALL, F.expr("aggregate(steps, 1, (n, s) -> n + length(s.before) + length(s.after))"))
    above = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        done = level.where("size = 1").join(begun, "tree")
        if above is not None:
            mine = F.expr(f"cast(place % {fan} as int)")
            step = F.struct(F.array_join(F.slice("__run", F.lit(1), mine), "").alias("before"), F.array_join(F.slice("__run", mine + 2, F.lit(fan)), "").alias("after"))
            down = level.where("size > 1").join(above, [level["tree"] == above["__tree"], F.expr(f"place div {fan}") == above["__place"]])
            done = down.withColumn("steps", F.concat(F.array(step), "steps")).select(*done.columns).unionByName(done)
        if k == 0:
            return done
        above = stage(done.select(F.col("tree").alias("__tree"), F.col("place").alias("__place"), F.col("children").alias("__run"), "steps", *also))
    return done


def fold(hash_: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(steps, hash_, lambda h, s: digest(s["before"], h, s["after"]))


def proof_digest(steps: Column) -> Column:
    """H of all siblings, from the leaf's run upwards, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, altered: Column | None = None, fan: int = FAN) -> DataFrame:
    """(id: ``order``, group, leaf, other_leaf, subroot, root, steps) of every row: its leaf over ``columns``, the roots of its
    group and of the table, and its proof.

    ``altered`` stands for a column struct like ``columns``; ``other_leaf`` is the leaf of those values, for checks of what a
    changed row folds to, and equals ``leaf`` without it."""
    own = [docs[c] for c in columns]
    other = own if altered is None else [altered[c] for c in columns]
    leaves = stage(docs.select(tree_of(docs[group]).alias("tree"), docs[order].alias("__id"), docs[group].alias("__group"), leaf_of(own).alias("hash"), leaf_of(other).alias("__other")))
    levels = build(stage(placed(leaves, "tree", ["__id", "hash"])), fan)
    subroots = stage(roots(levels))
    top = build(stage(dense_index(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("__of"), "hash"), "__of", "place").withColumn("size", F.lit(subroots.count()).cast("long"))), fan)
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    start = roots(top).select("tree", nothing.alias("steps"), F.col("hash").alias("root"))
    inherited = stage(push(top, start, fan).select(F.col("__of").alias("tree"), "steps", F.col("hash").alias("subroot"), "root"))
    return push(levels, inherited, fan).select(F.col("__id").alias(order), F.col("__group").alias(group), F.col("hash").alias("leaf"), F.col("__other").alias("other_leaf"), "subroot", "root", "steps")
