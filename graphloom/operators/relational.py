"""Relational operators of the graph queries that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import adopt, free, owned, stage

#: Rows that one task may order.
RANGE_ROWS = 1_000_000


def other_endpoint(known: Column, p1: Column, p2: Column) -> Column:
    return F.when(p1 == known, p2).otherwise(p1)


def canonical_pair(edges: DataFrame, a: str = "p1", b: str = "p2") -> DataFrame:
    """``low`` and ``high`` of each undirected pair, self-loops left out; other columns stay."""
    return edges.where(F.col(a) != F.col(b)).withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b))


def tagged_union(parts: dict[int, DataFrame], tag: str = "type") -> DataFrame:
    """UNION ALL of tables by column name, each row tagged with its table's number."""
    out = None
    for number, df in parts.items():
        one = df.withColumn(tag, F.lit(number))
        out = one if out is None else out.unionByName(one)
    return out


def top_k(df: DataFrame, k: int, order: list, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows; ``order`` must end in a unique key.  With ``rank``, their places from 1."""
    first = df.orderBy(*order).limit(k)
    return first if rank is None else first.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def held(df: DataFrame) -> DataFrame:
    """The rows of a ``df`` that a limit bounds, computed now and kept as a local table."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def ranged(df: DataFrame, keys: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``__range``: numbers, ascending with ``keys``, of ranges of about ``rows`` rows.

    Ranges are cut at sampled keys, so outliers do not matter, and their number grows with the rows.  Staged, so that every use
    sees the same ranges and ``df`` is computed once.  Rows of equal keys share a range."""
    return _cut(df, keys, rows)[0]


def _cut(df: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, bool]:
    """``ranged`` and whether there are several ranges; of a single one nothing is carried anywhere."""
    with owned() as first:
        kept = stage(df)
    ranges = -(-kept.count() // rows)
    if ranges <= 1:
        adopt(first)
        return kept.withColumn("__range", F.lit(0)), False
    cut = stage(kept.repartitionByRange(ranges, *keys).withColumn("__range", F.spark_partition_id()))
    free(first)
    return cut, True


def _before(sizes: DataFrame, value) -> DataFrame:
    """(__range, __before): the sum of ``value`` over smaller ranges; one row for each range."""
    return sizes.groupBy("__range").agg(value.alias("__n")).select("__range", F.coalesce(F.sum("__n").over(_smaller()), F.lit(0)).alias("__before"))


def _smaller():
    """All ranges before a range; for tables with one row for each range."""
    return Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)


def _greater():
    """All ranges after a range, swept downwards."""
    return Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)


def dense_index(df: DataFrame, key: str | list[str], name: str = "index", rows: int = RANGE_ROWS) -> DataFrame:
    """Place (from 0) of each row by a unique ``key``, without ordering all rows in one task: places within ranges of the key,
    plus the sizes of the ranges before."""
    keys = [key] if isinstance(key, str) else key
    cut, several = _cut(df, keys, rows)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return _carried(cut, several, inside, F.count("*"), name)


def _carried(cut: DataFrame, several: bool, inside, value, name: str) -> DataFrame:
    """``inside`` plus the sum of ``value`` over the ranges before."""
    if not several:
        return cut.withColumn(name, inside).drop("__range")
    both = cut.withColumn("__inside", inside).join(F.broadcast(_before(cut, value)), "__range")
    return both.withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")


def running_total(df: DataFrame, key: str, value: str, name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``key`` (unique), by the same two levels."""
    cut, several = _cut(df, [key], rows)
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _carried(cut, several, inside, F.sum(value), name)


def align(keys: DataFrame, key: str, bounds: DataFrame, bound: str, low: int, high: int, rows: int = RANGE_ROWS) -> DataFrame:
    """As-of alignment: for each row of ``keys`` the greatest bound <= key (``floor_bound``) and the least bound > key
    (``next_bound``), the bounds being extended by ``low`` and ``high``.

    Distinct keys and bounds meet in ranges of the key; what lies before and after a range is carried in from a table with one
    row for each range; rows then look their key up.  A null key aligns with nothing."""
    marks = bounds.select(F.col(bound).cast("long").alias("__k"), F.lit(True).alias("__is_bound"))
    points = keys.select(F.col(key).cast("long").alias("__k"), F.lit(False).alias("__is_bound")).union(marks).where("__k is not null")
    # one row for each value: whether it is a bound, and a key
    values = points.groupBy("__k").agg(F.max("__is_bound").alias("__is_bound"), F.min("__is_bound").alias("__no_key"))
    cut, several = _cut(values, ["__k"], rows)
    mark = F.when(F.col("__is_bound"), F.col("__k"))
    # one sweep up a range and one down: a frame that ends at the row before costs a step a row
    up, down = Window.partitionBy("__range").orderBy("__k"), Window.partitionBy("__range").orderBy(F.desc("__k"))
    near = cut.withColumn("__floor", F.last(mark, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.last(mark, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    near = near.where("not __no_key")
    if several:
        by_range = cut.groupBy("__range").agg(F.max(mark).alias("__max"), F.min(mark).alias("__min"))
        carried = by_range.select("__range", F.max("__max").over(_smaller()).alias("__before"), F.min("__min").over(_greater()).alias("__after"))
        near = near.join(F.broadcast(carried), "__range")
    before, after = (["__before"], ["__after"]) if several else ([], [])
    placed = near.select("__k", F.coalesce("__floor", *before, F.lit(low)).alias("floor_bound"), F.coalesce("__next", *after, F.lit(high)).alias("next_bound"))
    return keys.join(placed, F.col(key).cast("long") == F.col("__k"), "left").select(*keys.columns, "floor_bound", "next_bound")


def adjacent_pairs(df: DataFrame, key: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Each distinct ``key`` with the next greater one (null for the last), ranges at a time."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    cut, several = _cut(keys, [key], rows)
    cut = cut.withColumn("__next", F.lead(key).over(Window.partitionBy("__range").orderBy(key)))
    if not several:
        return cut.select(key, F.col("__next").alias("next"))
    starts = cut.groupBy("__range").agg(F.min(key).alias("__first"))
    after = starts.select("__range", F.min("__first").over(_greater()).alias("__after"))
    return cut.join(F.broadcast(after), "__range").select(key, F.coalesce("__next", "__after").alias("next"))


def member_flag(df: DataFrame, key: str, members: DataFrame, member: str, name: str = "in_set") -> DataFrame:
    """Every row of ``df`` with whether its ``key`` is among ``members``, a set of any size."""
    found = members.select(F.col(member).alias("__m")).where("__m is not null").distinct()
    return df.join(found, F.col(key) == F.col("__m"), "left").withColumn(name, F.col("__m").isNotNull()).drop("__m")


def match_matrix(df: DataFrame, key: str, ids: list[int], most: int = 10) -> DataFrame:
    """One boolean column ``match_0`` ... for each of the first ``most`` ids, sorted and distinct; at least that many are
    needed."""
    wanted = sorted(set(ids))[:most]
    if len(wanted) < most:
        raise ValueError(f"at least {most} distinct ids are needed")
    return df.select("*", *[(F.col(key) == x).alias(f"match_{i}") for i, x in enumerate(wanted)])


def outsiders(keys: DataFrame, key: str, members: DataFrame, member: str, low: int, high: int, rows: int = RANGE_ROWS) -> DataFrame:
    """The distinct keys that are not among ``members``, each with what proves it: the members next below and above, the set
    being extended by ``low`` and ``high``.  Null keys are left out."""
    known = members.select(F.col(member).cast("long").alias("__m")).where("__m is not null").distinct()
    apart = keys.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct().join(known, F.col(key) == F.col("__m"), "left_anti")
    return align(apart, key, known, "__m", low, high, rows).withColumnsRenamed({"floor_bound": "below", "next_bound": "above"})
