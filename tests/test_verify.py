"""Checks: silent on right results, and naming the rows of wrong ones."""

import pytest

from pyspark.sql import functions as F

from graphloom.operators import relational as rel
from graphloom.operators import traverse as walk
from graphloom.operators import verify
from graphloom.staging import stage


@pytest.fixture(scope="module")
def edges(spark):
    return walk.symmetric(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "p1 long, p2 long"))


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id long, distance int, predecessor long")


GOOD = [(1, 0, None), (2, 1, 1), (3, 2, 2), (4, 3, 3), (5, 1, 1)]


@pytest.mark.parametrize(
    ("rows", "faults"),
    [
        (GOOD, set()),
        ([r if r[0] != 3 else (3, 2, 5) for r in GOOD], {"edge"}),
        ([r if r[0] != 5 else (5, 3, 1) for r in GOOD], {"predecessor", "shortest"}),
        ([r for r in GOOD if r[0] != 5], {"shortest"}),
        ([r for r in GOOD if r[0] != 1], {"source", "predecessor", "shortest"}),
        ([*GOOD, (9, 0, None)], {"source", "predecessor", "edge"}),
    ],
)
def test_distances(spark, edges, rows, faults):
    assert {r["check"] for r in verify.distances(nodes(spark, rows), edges, 1).collect()} == faults


def test_distances_with_limit(spark, edges):
    assert verify.distances(nodes(spark, [r for r in GOOD if r[1] <= 2]), edges, 1, 2).count() == 0


@pytest.mark.parametrize(("extra", "fault"), [([], None), ([(2, 5)], "repeated"), ([(2, 4)], "unfed")])
def test_levels(spark, edges, extra, fault):
    found = spark.createDataFrame([(1, 2), (1, 5), (2, 3), *extra], "hop int, id long")
    assert {r["check"] for r in verify.levels(found, edges, 1).collect()} >= ({fault} if fault else set())
    assert bool(fault) == bool(verify.levels(found, edges, 1).count())


def test_lost_node(spark, edges):
    found = spark.createDataFrame([(1, 2), (2, 3)], "hop int, id long")
    assert ("lost", 1, 5) in {tuple(r) for r in verify.levels(found, edges, 1).collect()}


def test_permutation_and_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 1, 2], [2, 1, 3]))
    assert {tuple(r) for r in verify.permutation(a, b).collect()} == {(1, 1), (3, -1)}
    assert {tuple(r) for r in verify.same_set(a, b).collect()} == {(3, 0, 1)}
    assert verify.permutation(a, a.orderBy("x")).count() == 0


def test_order_and_top(spark):
    rows = spark.createDataFrame([(1, 9, 1), (2, 9, 2), (3, 7, 1)], "place int, date int, id int")
    order = [("date", True), ("id", False)]
    assert verify.ordered(rows, "place", order, strict=True).count() == 0
    twice = rows.union(spark.createDataFrame([(4, 7, 1)], rows.schema))
    assert verify.ordered(twice, "place", order).count() == 0
    assert [r[0] for r in verify.ordered(twice, "place", order, strict=True).collect()] == [3]
    assert verify.top_boundary(rows, rows.where("place <= 2"), 2, ["id", "date"], order).count() == 0
    assert [tuple(r) for r in verify.top_boundary(rows, rows.where("place <> 2"), 2, ["id", "date"], order).collect()] == [(2, 9)]
    assert verify.top_boundary(rows, rows.where("place < 0"), 2, ["id", "date"], order).count() == 3


def test_members_and_tags(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    assert verify.members(base, base, ["id", "name"]).count() == 0
    assert verify.members(spark.createDataFrame([(1, "b")], base.schema), base, ["id", "name"]).count() == 1
    tagged = spark.createDataFrame([(1, 0), (1, 1)], "id int, type int")
    assert [tuple(r) for r in verify.tags(tagged, {0: base, 1: base.where("id = 2")}).collect()] == [(1, 1)]


def test_alignment(spark):
    bounds = spark.createDataFrame([(3,), (5,)], "b long")
    aligned = lambda rows: spark.createDataFrame(rows, "k long, floor_bound long, next_bound long")
    assert verify.alignment(aligned([(2, 0, 3), (4, 3, 5), (9, 5, 99)]), "k", bounds, "b", 0, 99).count() == 0
    wrong = aligned([(2, 0, 5), (4, 2, 5), (9, 5, 8), (6, 0, 3)])
    assert {r[0] for r in verify.alignment(wrong, "k", bounds, "b", 0, 99).collect()} == {2, 4, 9, 6}


def test_partition(spark):
    whole = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int")
    assert verify.partition(whole, whole.where("x < 3"), whole.where("x >= 3")).count() == 0
    wrong = verify.partition(whole, whole.where("x < 3"), whole.where("x = 1"))
    assert {tuple(r) for r in wrong.collect()} == {(1, 1), (3, -1)}


def test_slices(spark, edges):
    index = walk.positions(edges)
    slots = walk.slices(index)
    assert verify.slices(index, slots, edges).count() == 0
    assert {r[0] for r in verify.slices(index, slots.selectExpr("src", "begin + cast(src = 2 as int) as begin", "`end` + cast(src = 2 as int) as end"), edges).collect()} >= {2}
    assert {r[0] for r in verify.slices(index, slots, edges.where("src <> 3")).collect()} == {3}
    turned = index.join(slots, "src").selectExpr("src", "dst", "begin + `end` - 1 - position as position")
    assert {r[0] for r in verify.slices(turned, slots, edges).collect()} == {1, 2, 3}
    assert {r[0] for r in verify.slices(index, slots.where("src <> 4"), edges).collect()} >= {4}


def test_level_tables(spark, edges):
    found = spark.createDataFrame([(1, 2), (1, 5), (2, 3)], "hop int, id long")
    persons = spark.createDataFrame([(1, 0), (2, 1), (5, 1), (3, 2), (4, None)], "id long, distance int")
    seen = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 5), (2, 3)], "hop int, id long")
    assert verify.level_rows(found, persons).count() == 0 == verify.visited(found, seen, 1).count()
    assert [tuple(r) for r in verify.level_rows(found, persons.where("id <> 5")).collect()] == [(1, 5)]
    assert {tuple(r) for r in verify.visited(found, seen.where("id <> 2"), 1).collect()} == {(1, 2), (2, 2)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("y"))
    assert verify.fingerprint(rows) == verify.fingerprint(rows.orderBy(F.desc("y")).repartition(5))
    for other in (rows.where("y is null or y <> 4"), rows.select(F.col("y").alias("x"), F.col("x").alias("y")), rows.union(rows.limit(1)), rows.withColumn("y", F.when(F.col("y") != 4, F.col("y")))):
        assert verify.fingerprint(other) != verify.fingerprint(rows)
    nulls = [spark.createDataFrame([r], "x int, y int") for r in ((None, 1), (1, None))]
    assert verify.fingerprint(nulls[0]) != verify.fingerprint(nulls[1])


def test_alike_tables_are_not_grouped(spark):
    rows = stage(spark.range(1000).select("id", (F.col("id") % 7).alias("x")))
    clean = verify.permutation(rows, rows.orderBy("x"))
    assert clean.count() == 0 and clean.columns == ["id", "x", "surplus"] and "Exchange" not in plan(clean)
    assert "Exchange" in plan(verify.permutation(rows, rows.where("id <> 3")))
    assert {tuple(r) for r in verify.permutation(rows, rows.where("id <> 3")).collect()} == {(3, 3, 1)}
    same = verify.same_set(rows, rows)
    assert same.count() == 0 and "Exchange" not in plan(same)
    assert verify.same_set(rows, rows.union(rows)).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_order_in_place_finds_what_the_join_finds(spark, strict):
    order = [("v", True), ("s", False)]
    rows = spark.range(500).select(F.col("id").alias("place"), (500 - F.expr("id div 3")).alias("v"), F.when(F.col("id") % 3 == 2, F.lit(None)).otherwise(F.format_string("%03d", F.col("id"))).alias("s"))
    wrong = rows.withColumn("v", F.when(F.col("place") % 50 == 9, 900).otherwise(F.col("v"))).where("place % 97 <> 5")
    for df in (rows, wrong):
        for laid in (df.repartitionByRange(7, "place").sortWithinPartitions("place"), stage(df.repartitionByRange(5, "place").sortWithinPartitions("place")), df.repartition(3)):
            assert sorted(r[0] for r in verify.ordered_in_place(laid, "place", order, strict).collect()) == sorted(r[0] for r in verify.ordered(df, "place", order, strict).collect())
    assert verify.ordered_in_place(rows.limit(0), "place", order, strict).count() == 0


def test_members_of_a_small_result(spark):
    base = stage(spark.range(20_000).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), "id")).alias("name")))
    result = spark.createDataFrame([(3, "n3"), (5, None), (6, None), (30_000, "n3"), (7, "n8")], base.schema)
    wrong = verify.members(result, base, ["id", "name"])
    assert {tuple(r) for r in wrong.collect()} == {(6, None), (30_000, "n3"), (7, "n8")}
    # of the base, only rows that pass the filter are shuffled
    assert verify.sifted(base, result, ["id", "name"]).count() < 10
    shown = plan(wrong)
    assert shown.rindex("BroadcastNestedLoopJoin") < shown.rindex("FileScan") and "Exchange" in shown


def test_members_of_a_large_result(spark, monkeypatch):
    monkeypatch.setattr(verify, "BLOOM_ROWS", 2)
    base = spark.range(100).select("id")
    assert [r[0] for r in verify.members(spark.createDataFrame([(1,), (2,), (3,), (101,)], "id long"), base, ["id"]).collect()] == [101]


def test_non_members(spark):
    keys, members = spark.createDataFrame([(1,), (1,), (5,), (9,), (6,), (None,)], "k long"), spark.createDataFrame([(5,), (7,), (7,), (None,)], "m long")
    found = rel.outsiders(keys, "k", members, "m", 0, 99)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 5), (6, 5, 7), (9, 7, 99)]
    assert verify.absent(found, members, "m", "k", 0, 99).count() == 0
    wrong = spark.createDataFrame([(6, 5, 99), (5, 0, 5), (5, 5, 7), (9, 8, 99), (1, 0, 5), (2, None, 5)], "k long, below long, above long")
    assert sorted(r[0] for r in verify.absent(wrong, members, "m", "k", 0, 99).collect()) == [2, 5, 6, 9]
    flags = rel.member_flag(keys, "k", members, "m")
    assert verify.witnessed(flags, "k", "in_set", found).count() == 0
    assert [r[0] for r in verify.witnessed(flags, "k", "in_set", found.where("k <> 6")).collect()] == [6]
    assert rel.outsiders(keys.limit(0), "k", members.limit(0), "m", 0, 9).count() == 0


def test_tags_do_not_group_the_tables(spark):
    """A small result is compared with the rows that pass a Bloom filter of it; the tables are only scanned."""
    table = stage(spark.range(5000).withColumn("note", F.lit("x")))
    tables = {0: table, 1: table.where("id % 2 = 0").select("id", "note")}
    tagged = spark.createDataFrame([(3, 0), (3, 1), (4, 1), (9000, 0), (None, 1)], "id long, type int")
    found = verify.tags(tagged, tables)
    assert {tuple(r) for r in found.collect()} == {(3, 1), (9000, 0), (None, 1)} and "Aggregate" not in plan(found) and "BroadcastNestedLoopJoin" in plan(found)
    # the same beyond the filter's bound, and where the types of keys differ, so that their hashes do
    many = spark.range(verify.BLOOM_ROWS + 10).select("id", F.lit(0).alias("type"))
    assert verify.tags(many, tables).count() == verify.BLOOM_ROWS + 10 - 5000 and "Aggregate" not in plan(verify.tags(many, tables))
    narrow = tagged.select(F.col("id").cast("int").alias("id"), F.col("type").cast("long").alias("type"))
    assert {tuple(r) for r in verify.tags(narrow, tables).collect()} == {(3, 1), (9000, 0), (None, 1)}
    assert verify.members(narrow.select("id").where("id < 9000"), table, ["id"]).count() == 0
