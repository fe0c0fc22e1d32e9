"""Checks that results can be audited with: each returns the violating rows, so a result is valid where all are empty.

None of them relies on how a result was computed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage
from .relational import adjacent_pairs, dense_index


#: Result rows up to which ``members`` and ``tags`` filter the base table by a Bloom filter of them, its bits, and bits set by a row.
BLOOM_ROWS, BLOOM_BITS, BLOOM_HASHES = 50_000, 1 << 20, 4


def _places(columns: list[Column]) -> list[Column]:
    """The bits that a row sets in a Bloom filter; nulls are told apart from values."""
    told = [x for c in columns for x in (c.isNull(), c)]
    return [F.pmod(F.xxhash64(F.lit(i), *told), F.lit(BLOOM_BITS)) for i in range(BLOOM_HASHES)]


def sifted(base: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``base`` that a Bloom filter of ``keys`` lets through: all that are among the keys, and few others.  The filter
    comes to the scan as one row of BLOOM_BITS bits, so no base row is shuffled."""
    bits = keys.select(F.explode(F.array(*_places([F.col(c) for c in columns]))).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word")).toArrow()  # at most BLOOM_BITS / 64 rows
    filled = np.zeros(BLOOM_BITS // 64, np.int64)
    filled[words["at"].to_numpy()] = words["word"].to_numpy()
    held = base.sparkSession.createDataFrame(pa.table({"__words": pa.array([filled])}))
    one = lambda p: F.getbit(F.get("__words", F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
    test = reduce(lambda a, b: a & b, [one(p) for p in _places([base[c] for c in columns])])
    return base.join(F.broadcast(held), test).drop("__words")


def _narrowed(found: DataFrame, base: DataFrame) -> DataFrame:
    """``base`` (the columns of ``found``) or, while the distinct rows of ``found`` are few, only its rows that pass a Bloom filter of
    them: a large base is then scanned and neither shuffled nor grouped.  Columns of other types hash otherwise, and so are not sifted."""
    columns = found.columns
    base, alike = base.select(*columns), [t for _, t in found.dtypes] == [t for _, t in base.select(*columns).dtypes]
    return sifted(base, found, columns) if alike and found.limit(BLOOM_ROWS + 1).count() <= BLOOM_ROWS else base


def members(result: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """Result rows that are not in the base table.

    While the result is small, only base rows that pass a Bloom filter of it are compared, so a large base is scanned and not
    shuffled; beyond that both sides meet as they are."""
    base = _narrowed(result.select(*columns), base)
    test = reduce(lambda a, b: a & b, [result[c].eqNullSafe(base[c]) for c in columns])
    return result.join(base, test, "left_anti").select(*columns)


def fingerprint(df: DataFrame) -> tuple:
    """A number of rows and the sums of two 64-bit hashes of them: equal for tables with the same rows in any order, and but
    for a chance of about 2^-128 for no others.  One pass with partial sums; rows are not shuffled."""
    told = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    sums = [F.sum(F.xxhash64(F.lit(salt), *told).cast("decimal(20,0)")) for salt in (1, 2)]
    return tuple(df.agg(F.count("*"), *sums).first())


def _alike(a: DataFrame, b: DataFrame) -> bool:
    return [t for _, t in a.dtypes] == [t for _, t in b.select(*a.columns).dtypes] and fingerprint(a) == fingerprint(b.select(*a.columns))


def _none(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)


def permutation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the surplus (positive: of ``a``).

    Rows are only grouped, and so shuffled, where the fingerprints of the two sides differ."""
    columns = a.columns
    count = a.select(*columns, F.lit(1).alias("__n")).unionByName(b.select(*columns, F.lit(-1).alias("__n")))
    surplus = count.groupBy(*columns).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")
    return _none(a.sparkSession, surplus) if _alike(a, b) else surplus


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur on one side only; grouped only where the fingerprints of the two sides differ."""
    columns = a.columns
    count = a.select(*columns, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*columns, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    apart = count.groupBy(*columns).agg(F.max("__a").alias("in_first"), F.max("__b").alias("in_second")).where("in_first + in_second = 1")
    return _none(a.sparkSession, apart) if _alike(a, b) else apart


def ordered(result: DataFrame, place: str, order: list[tuple[str, bool]], strict: bool = False) -> DataFrame:
    """Places whose row does not come before (or, unless ``strict``, with) the next row.

    ``order`` lists (column, descending?).  Neighbours meet by their place, so no task orders all rows."""
    after = result.select((F.col(place) - 1).alias("__p"), *[F.col(c).alias(f"__{c}") for c, _ in order])
    return result.join(after, F.col(place) == F.col("__p")).where(_out_of_order(order, strict)).select(place)


def ordered_in_place(result: DataFrame, place: str, order: list[tuple[str, bool]], strict: bool = False) -> DataFrame:
    """``ordered``, for results whose rows already lie in the order of their (unique) places within files or partitions.

    Every partition is read once, in stretches of consecutive places; what comes out is the places at fault inside, and the
    first and last row of each stretch, which meet by place.  So only a row or two for each stretch is shuffled; rows that lie
    in another order cost a stretch each."""
    columns = [c for c, _ in order]
    kinds = ", ".join(f"`{c}` {result.schema[c].dataType.simpleString()}" for c in columns)

    def wrong(before: pa.Table, after: pa.Table) -> np.ndarray:
        bad, equal = pa.array([False] * len(before)), pa.array([True] * len(before))
        for c, descending in order:
            x, y = before[c], after[c]
            bad = pc.or_(bad, pc.and_(equal, pc.fill_null((pc.less if descending else pc.greater)(x, y), False)))
            equal = pc.and_(equal, pc.fill_null(pc.equal(x, y), False))
        return (pc.or_(bad, equal) if strict else bad).to_numpy(zero_copy_only=False)

    def run(batches):
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if last is not None:
                rows = pa.concat_tables([last, rows])
            if not rows.num_rows:
                continue
            at = rows["__place"].to_numpy()
            follows = np.flatnonzero(np.diff(at) == 1)
            faulty = follows[wrong(rows.take(pa.array(follows)), rows.take(pa.array(follows + 1)))] if len(follows) else follows
            cut = np.flatnonzero(np.diff(at) != 1)  # the last rows of stretches; the row carried over is compared again, not told again
            yield from _told(rows, faulty, "fault")
            yield from _told(rows, cut, "last")
            yield from _told(rows, cut + 1, "first")
            if last is None:
                yield from _told(rows, np.zeros(1, int), "first")
            last = rows.slice(rows.num_rows - 1)
        if last is not None:
            yield from _told(last, np.zeros(1, int), "last")

    read = result.select(F.col(place).cast("long").alias("__place"), *columns)
    swept = stage(read.mapInArrow(run, f"__place long, {kinds}, __kind string"))
    ends = swept.where("__kind <> 'fault'")
    lasts, firsts = ends.where("__kind = 'last'"), ends.where("__kind = 'first'").withColumn("__place", F.col("__place") - 1)
    met = lasts.join(firsts.select(F.col("__place"), *[F.col(c).alias(f"__{c}") for c in columns]), "__place")
    between = met.where(_out_of_order(order, strict)).select("__place")
    return swept.where("__kind = 'fault'").select("__place").union(between).select(F.col("__place").cast(result.schema[place].dataType).alias(place))


def _told(rows: pa.Table, at: np.ndarray, kind: str):
    found = rows.take(pa.array(at))
    yield from found.append_column("__kind", pa.array([kind] * len(at), pa.string())).combine_chunks().to_batches()


def _out_of_order(order: list[tuple[str, bool]], strict: bool) -> Column:
    """Whether a row (c, ...) does not come before, or unless ``strict`` with, the row (__c, ...)."""
    wrong, equal = F.lit(False), F.lit(True)
    for c, descending in order:
        wrong = wrong | (equal & ((F.col(c) < F.col(f"__{c}")) if descending else (F.col(c) > F.col(f"__{c}"))))
        equal = equal & (F.col(c) == F.col(f"__{c}"))
    return wrong | equal if strict else wrong


def top_boundary(candidates: DataFrame, result: DataFrame, k: int, key: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """Candidates outside a top-k result that should be in it: those that come before its last row, and all of them if the
    result has fewer than ``k`` rows."""
    names = [c for c, _ in order]
    last = result.orderBy(*[(F.asc if d else F.desc)(c) for c, d in order]).limit(1).select(*[F.col(c).alias(f"__{c}") for c in names])
    size = result.agg(F.count("*").alias("__size"))
    rest = candidates.join(result.select(*key).distinct(), key, "left_anti")
    before, equal = F.lit(False), F.lit(True)
    for c, descending in order:
        before = before | (equal & ((F.col(c) > F.col(f"__{c}")) if descending else (F.col(c) < F.col(f"__{c}"))))
        equal = equal & (F.col(c) == F.col(f"__{c}"))
    # one row each: the k-th row and the size
    return rest.join(F.broadcast(last), F.lit(True), "left").join(F.broadcast(size), F.lit(True)).where(before | (F.col("__size") < k)).select(*key)


def partition(whole: DataFrame, selected: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows whose count in ``whole`` is not that in ``selected`` and ``rest`` together, or that are on both sides.

    (columns, parts): how many more rows the parts have; 0 where a row is merely on both sides."""
    columns = whole.columns
    one = [whole.select(*columns, F.lit(1).alias("__w"), F.lit(0).alias("__s"), F.lit(0).alias("__r")), selected.select(*columns, F.lit(0).alias("__w"), F.lit(1).alias("__s"), F.lit(0).alias("__r")), rest.select(*columns, F.lit(0).alias("__w"), F.lit(0).alias("__s"), F.lit(1).alias("__r"))]
    counted = reduce(lambda a, b: a.unionByName(b), one).groupBy(*columns).agg(F.sum("__w").alias("__w"), F.sum("__s").alias("__s"), F.sum("__r").alias("__r"))
    return counted.where("__w <> __s + __r or (__s > 0 and __r > 0)").select(*columns, (F.col("__s") + F.col("__r") - F.col("__w")).alias("parts"))


def slices(index: DataFrame, slots: DataFrame, edges: DataFrame) -> DataFrame:
    """Sources of an adjacency index (``slots``: src, begin, end; ``index``: src, dst, position) whose slice has not the size
    of their targets, whose targets are not strictly ascending by position or not those of the edges, or whose slice does not
    begin where another one (or the list) ends."""
    degree = index.groupBy("src").agg(F.count("*").alias("__n"), F.min("position").alias("__low"), F.max("position").alias("__high"))
    sized = slots.join(degree, "src", "full").where("__n is null or begin is null or `end` - begin <> __n or begin <> __low or `end` <> __high + 1").select("src")
    before = index.select("src", (F.col("position") + 1).alias("position"), F.col("dst").alias("__before"))
    unordered = index.join(before, ["src", "position"]).where("__before >= dst").select("src")
    unlike = same_set(index.select("src", "dst"), edges.select("src", "dst")).select("src")
    ends = slots.select(F.col("end").alias("begin")).union(slots.sparkSession.range(1).select(F.lit(0).cast("long").alias("begin")))
    loose = slots.join(ends, "begin", "left_anti").select("src")
    return sized.union(unordered).union(unlike).union(loose).distinct()


def tags(result: DataFrame, tables: dict[int, DataFrame], key: str = "id", tag: str = "type") -> DataFrame:
    """Rows whose tag names a table that does not have their key."""
    known = reduce(lambda a, b: a.union(b), [t.select(F.col(key), F.lit(n).alias(tag)) for n, t in tables.items()])
    return result.join(_narrowed(result.select(key, tag), known), [key, tag], "left_anti").select(key, tag)


def distances(found: DataFrame, edges: DataFrame, source: int, max_hops: int | None = None) -> DataFrame:
    """(check, id) for every fault of BFS distances and predecessors over (src, dst) ``edges``.

    source: the source is not at 0, or another node is.  predecessor: it is no node of the result one step nearer, or no
    edge leads from it.  shortest: an edge leads to a node that is farther than one step more, or was not reached though
    the hop limit allows it."""
    nodes = found.select("id", "distance", "predecessor")
    start = nodes.where((F.col("id") == source) != (F.col("distance") == 0)).select(F.lit("source").alias("check"), "id")
    missing = edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id")).join(nodes, "id", "left_anti").select(F.lit("source").alias("check"), "id")
    parents = nodes.select(F.col("id").alias("predecessor"), (F.col("distance") + 1).alias("distance"))
    others = nodes.where(F.col("id") != source)
    apart = others.join(parents, ["predecessor", "distance"], "left_anti").select(F.lit("predecessor").alias("check"), "id")
    unlinked = others.join(edges.select(F.col("src").alias("predecessor"), F.col("dst").alias("id")), ["predecessor", "id"], "left_anti").select(F.lit("edge").alias("check"), "id")
    near = nodes.select(F.col("id").alias("src"), F.col("distance").alias("near"))
    far = nodes.select(F.col("id").alias("dst"), F.col("distance").alias("far"))
    across = edges.join(near, "src").join(far, "dst", "left")
    allowed = F.lit(True) if max_hops is None else F.col("near") < max_hops
    long = across.where((F.col("far") > F.col("near") + 1) | (F.col("far").isNull() & allowed)).select(F.lit("shortest").alias("check"), F.col("dst").alias("id")).distinct()
    return start.union(missing).union(apart).union(unlinked).union(long)


def levels(found: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """(check, hop, id) for every fault of exact-hop node sets (hop, id): a node without an edge from the level before, a
    node in two levels or equal to the source, and a node that an edge from a level reaches but no level up to the next has."""
    start = edges.sparkSession.range(1).select(F.lit(0).alias("hop"), F.lit(source).cast("long").alias("id"))
    nodes = found.select("hop", "id").union(start)
    fed = nodes.select((F.col("hop") + 1).alias("hop"), F.col("id").alias("src")).join(edges, "src").select("hop", F.col("dst").alias("id")).distinct()
    orphan = found.select("hop", "id").join(fed, ["hop", "id"], "left_anti").select(F.lit("unfed").alias("check"), "hop", "id")
    twice = nodes.groupBy("id").agg(F.count("*").alias("n"), F.max("hop").alias("hop")).where("n > 1").select(F.lit("repeated").alias("check"), "hop", "id")
    deepest = found.agg(F.max("hop").alias("deepest"))
    first = nodes.groupBy("id").agg(F.min("hop").alias("first"))
    lost = fed.join(F.broadcast(deepest), F.col("hop") <= F.col("deepest")).join(first, "id", "left").where(F.col("first").isNull() | (F.col("first") > F.col("hop"))).select(F.lit("lost").alias("check"), "hop", "id")
    return orphan.union(twice).union(lost)


def alignment(aligned: DataFrame, key: str, bounds: DataFrame, bound: str, low: int, high: int) -> DataFrame:
    """Keys whose neighbours are not adjacent members of the extended set around them."""
    known = bounds.select(F.col(bound).alias("b")).where("b is not null").distinct()
    outside = aligned.where(~((F.col("floor_bound") <= F.col(key)) & (F.col(key) < F.col("next_bound")))).select(key)
    strangers = [aligned.where(F.col(c) != end).join(known, F.col(c) == F.col("b"), "left_anti").select(key) for c, end in (("floor_bound", low), ("next_bound", high))]
    # adjacent members have neighbouring places in the extended set
    ends = known.sparkSession.range(1).select(F.explode(F.array(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias("b"))
    place = stage(dense_index(known.select(F.col("b").cast("long").alias("b")).union(ends).distinct(), "b"))
    placed = aligned.join(place.select(F.col("b").alias("floor_bound"), F.col("index").alias("i")), "floor_bound").join(place.select(F.col("b").alias("next_bound"), F.col("index").alias("j")), "next_bound")
    gaps = placed.where("j <> i + 1").select(key)
    return reduce(lambda a, b: a.union(b), [outside, *strangers, gaps]).distinct()


def absent(witness: DataFrame, members: DataFrame, member: str, key: str, low: int, high: int) -> DataFrame:
    """Keys of ``witness`` (key, below, above) that it does not prove to be outside a set of members: their neighbours do not
    enclose them, or are not adjacent in the set extended by ``low`` and ``high``.

    Adjacent are the pairs that a lead over the members gives, so this shares nothing with how alignment finds neighbours."""
    known = members.select(F.col(member).cast("long").alias("__b"))
    ends = known.sparkSession.range(1).select(F.explode(F.array(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias("__b"))
    pairs = adjacent_pairs(known.union(ends), "__b").select(F.col("__b").alias("below"), F.col("next").alias("above"))
    enclosed = F.coalesce((F.col("below") < F.col(key)) & (F.col(key) < F.col("above")), F.lit(False))
    loose = witness.join(pairs, ["below", "above"], "left_anti").select(key)
    return witness.where(~enclosed).select(key).union(loose).distinct()


def witnessed(flags: DataFrame, key: str, flag: str, witness: DataFrame) -> DataFrame:
    """Keys that are flagged as no members without a witness, or as members with one."""
    told = witness.select(F.col(key).alias("__w")).distinct()
    both = flags.where(F.col(key).isNotNull()).select(key, flag).distinct().join(told, F.col(key) == F.col("__w"), "left")
    return both.where(F.col(flag) == F.col("__w").isNotNull()).select(key)


def path_length(result: DataFrame, found: DataFrame, target: int) -> DataFrame:
    """The row of a path-length result that is not the target's distance in a checked table of distances (id, distance), -1
    standing for a target without one."""
    truth = found.where(F.col("id") == target).agg(F.coalesce(F.min("distance"), F.lit(-1)).alias("__truth"))
    return result.join(F.broadcast(truth), F.col("distance") != F.col("__truth")).select("distance")


def found_flags(lookups: DataFrame, tables: dict[int, DataFrame], wanted: int, key: str = "id") -> DataFrame:
    """Tags of look-ups (type, found) whose flag is not what the table of that tag says of the ``wanted`` key."""
    has = reduce(lambda a, b: a.union(b), [t.where(F.col(key) == wanted).select(F.lit(n).alias("type")) for n, t in tables.items()]).distinct().withColumn("__has", F.lit(True))
    return lookups.join(has, "type", "left").where(F.col("found") != F.coalesce("__has", F.lit(False))).select("type").distinct()


def picked(result: DataFrame, lookups: DataFrame, key: str = "id") -> DataFrame:
    """Result rows whose key no successful look-up (found, person_id) picked, and picks that are not in the result."""
    picks = lookups.where("found").select(F.col("person_id").alias(key)).distinct()
    return same_set(result.select(key).distinct(), picks).select(key)


def level_rows(found: DataFrame, persons: DataFrame) -> DataFrame:
    """(hop, id) that are in a level set but not flagged with that distance in the table of all persons (id, distance), or the
    other way round."""
    flagged = persons.where("distance > 0").select(F.col("distance").alias("hop"), "id")
    return same_set(found.select("hop", "id"), flagged).select("hop", "id")


def visited(found: DataFrame, seen: DataFrame, source: int) -> DataFrame:
    """(hop, id) of the tables of visited nodes (hop, id) that are not the union of the source and the levels up to the hop."""
    deepest = seen.agg(F.max("hop")).first()[0] or 0
    start = seen.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(source).cast("long").alias("id"))
    reached = found.select(F.col("hop").alias("level"), "id").union(start).where(F.col("level") <= deepest)
    union = reached.select(F.explode(F.sequence("level", F.lit(deepest))).alias("hop"), "id").distinct()
    return same_set(seen.select("hop", "id"), union).select("hop", "id")
