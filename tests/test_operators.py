"""Operators, sources and encoders on tiny tables with known answers."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import staging
from graphloom.functions import encode
from graphloom.operators import relational as rel
from graphloom.operators import traverse as walk
from graphloom.plans import queries as q
from graphloom.sources import graph as source

KNOWS = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6)]


@pytest.fixture(scope="module")
def knows(spark):
    return spark.createDataFrame(KNOWS, "p1 long, p2 long")


def one(spark, x):
    return spark.range(1).select(F.lit(x).cast("long").alias("id"))


def levels(edges, spark, start, hops):
    out = {}
    for r in walk.hop_levels(edges, one(spark, start), hops).collect():
        out.setdefault(r["hop"], set()).add(r["id"])
    return out


def test_levels(spark, knows):
    assert levels(walk.symmetric(knows), spark, 1, 6) == {1: {2, 3}, 2: {4}, 3: {5}, 4: {6}}
    assert levels(walk.directed(knows), spark, 4, 6) == {1: {5}, 2: {6}}
    assert levels(walk.symmetric(knows), spark, 4, 2) == {1: {2, 3, 5}, 2: {1, 6}}
    assert levels(walk.symmetric(knows), spark, 7, 3) == {}


def test_paths_and_predecessors(spark, knows):
    edges = walk.symmetric(knows)
    people = spark.range(1, 8)
    for both in (False, True):
        for local in (0, 1, walk.LOCAL):
            assert [walk.shortest_path_length(edges, people, 1, b, both, local).first()[0] for b in (6, 7, 1, 99)] == [4, -1, 0, -1]
    assert walk.shortest_path_length(edges, people, 99, 99).first()[0] == -1
    found = {r["id"]: (r["distance"], r["predecessor"]) for r in walk.bfs(edges, one(spark, 1)).collect()}
    assert found == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (2, 2), 5: (3, 4), 6: (4, 5)}


def test_dangling_edges_and_loops(spark):
    edges = walk.symmetric(spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "p1 long, p2 long"))
    kept = walk.inside(edges, spark.createDataFrame([(1,), (2,)], "id long"))
    assert sorted(map(tuple, kept.collect())) == [(1, 2), (2, 1)]


def test_adjacency(spark, knows):
    index = {r["src"]: (list(r["targets"]), r["begin"], r["end"]) for r in walk.adjacency(walk.directed(knows), strict=True).collect()}
    assert index == {1: ([2, 3], 0, 2), 2: ([4], 2, 3), 3: ([4], 3, 4), 4: ([5], 4, 5), 5: ([6], 5, 6)}
    assert walk.check_sorted(walk.directed(knows)).count() == 0
    twice = walk.directed(knows.union(knows.limit(1)))
    assert walk.check_sorted(twice).count() == 1
    with pytest.raises(ValueError):
        walk.positions(twice, strict=True)
    assert {tuple(r) for r in walk.slices(walk.positions(twice)).collect()} == {(1, 0, 2), (2, 2, 3), (3, 3, 4), (4, 4, 5), (5, 5, 6)}
    listed = spark.createDataFrame([(1, 2, 0), (1, 4, 1), (1, 3, 2), (2, 1, 3)], "src long, dst long, at long")
    assert [tuple(r) for r in walk.check_sorted(listed, "at").collect()] == [(1, 3)]


def test_align(spark):
    keys = spark.createDataFrame([(2,), (3,), (9,), (None,)], "k long")
    bounds = spark.createDataFrame([(3,), (5,), (5,), (None,)], "b long")
    for rows in (1, 2, 1024):
        found = {r["k"]: (r["floor_bound"], r["next_bound"]) for r in rel.align(keys, "k", bounds, "b", 0, 99, rows).collect()}
        assert found == {2: (0, 3), 3: (3, 5), 9: (5, 99), None: (None, None)}
    assert rel.align(keys.limit(0), "k", bounds.limit(0), "b", 0, 9).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=30), st.lists(st.integers(-50, 50), max_size=10), st.integers(5, 90))
def test_align_like_bisection(spark, keys, bounds, rows):
    found = rel.align(spark.createDataFrame([(k,) for k in keys], "k long"), "k", spark.createDataFrame([(b,) for b in bounds], "b long"), "b", -99, 99, rows)
    want = sorted((k, max([b for b in bounds if b <= k], default=-99), min([b for b in bounds if b > k], default=99)) for k in keys)
    assert sorted(map(tuple, found.collect())) == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25))
def test_bfs_like_a_queue(spark, pairs):
    around = {}
    for a, b in pairs:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    want, queue = {0: 0}, [0]
    for x in queue:
        for y in sorted(around.get(x, ())):
            if y not in want:
                want[y] = want[x] + 1
                queue.append(y)
    edges = walk.symmetric(spark.createDataFrame(pairs, "p1 long, p2 long"))
    for local in (0, 3, walk.LOCAL):
        assert {r["id"]: r["distance"] for r in walk.bfs(edges, one(spark, 0), local=local).collect()} == want


def test_places(spark):
    df = spark.createDataFrame([(x, 2) for x in (90, 5, 7, -3)], "k long, v long")
    assert sorted((r["k"], r["index"]) for r in rel.dense_index(df, "k", rows=2).collect()) == [(-3, 0), (5, 1), (7, 2), (90, 3)]
    assert sorted((r["k"], r["t"]) for r in rel.running_total(df, "k", "v", "t", rows=1).collect()) == [(-3, 0), (5, 2), (7, 4), (90, 6)]
    for rows in (1, 100):
        assert sorted(map(tuple, rel.adjacent_pairs(df, "k", rows).collect()), key=str) == sorted([(-3, 5), (5, 7), (7, 90), (90, None)], key=str)


def test_an_outlying_key_does_not_fill_a_range(spark):
    keys = spark.range(20_000).union(spark.range(1).select(F.lit(10**13).cast("long").alias("id")))
    sizes = [r["count"] for r in rel.ranged(keys, ["id"], 1000).groupBy("__range").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 3000
    assert rel.dense_index(keys, "id", rows=1000).where("id = 10000000000000").first()["index"] == 20_000


def test_a_hub_is_split_into_ranges(spark):
    hub = spark.range(5000).select(F.lit(7).cast("long").alias("src"), F.col("id").alias("dst"))
    assert max(r["count"] for r in rel.ranged(hub, ["src", "dst"], 500).groupBy("__range").count().collect()) < 1500


def test_slices_and_weights(spark, knows):
    index = walk.positions(walk.directed(knows))
    assert [tuple(r) for r in walk.neighbours(index, 1).orderBy("dst").collect()] == [(1, 2, 0), (1, 3, 1)]
    assert {(r["dst"], r["weight"]) for r in walk.weighted(walk.directed(knows)).collect()} == {(d, d) for _, d in KNOWS}
    from graphloom.functions import logic

    assert [r[0] for r in spark.range(4).select(logic.within(F.col("id"), 1, 3)).collect()] == [False, True, True, False]


def test_members(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    ids = spark.createDataFrame([(2,), (2,), (None,)], "id long")
    assert {r["k"]: r["in_set"] for r in rel.member_flag(df, "k", ids, "id").collect()} == {1: False, 2: True, None: False}
    with pytest.raises(ValueError):
        rel.match_matrix(df, "k", [1, 2])


def test_encoders(spark):
    texts = spark.createDataFrame([("Chau",), ("é€",), ("",)], "t string")
    assert [r[0] for r in texts.select(encode.string_code(F.col("t"))).collect()] == [1034, 16961, 0]
    name = "a long name that wraps 64 bits é"
    total, by = 0, 1
    for b in name.encode():
        total, by = (total + by * b) % 2**64, by * 31 % 2**64
    assert spark.createDataFrame([(name,)], "t string").select(encode.name_code(F.col("t"))).first()[0] == total % (2**32 - 1)
    dates = spark.createDataFrame([("2010-01-31",), ("2010-02-01",), ("2010-02",), ("x-y-z",), ("2010-x-01",), ("2010--1-3",)], "t string")
    assert [r[0] for r in dates.select(encode.date_code(F.col("t"))).collect()] == [733711, 733711, 0, 0, 733651, 0]
    assert dates.select(encode.stamp_code(F.lit("2010-01-31T10:00:00"))).first()[0] == 733711
    addresses = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("1.2.3",), ("256.1.1.1",)], "t string")
    assert [r[0] for r in addresses.select(encode.ipv4_code(F.col("t"))).collect()] == [16909060, 4294967295, None, None]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "person_knows_person_0_0.csv").write_text("Person.id|Person.id|creationDate\n1|2|2010-01-31T10:00:00.000\n3|4\n|5|2010-01-31\nx|2|2010-01-31\n5|6|2011-02-03\n")
    (tmp_path / "place_0_0.csv").write_text('id|name|url|type\n7|"A|u|city\n8||u|city\n')
    graph = source.load_delimited(spark, str(tmp_path))
    assert [(r["p1"], r["p2"], str(r["creation_date"])) for r in graph.knows.orderBy("p1").collect()] == [(1, 2, "2010-01-31 10:00:00"), (5, 6, "2011-02-03 00:00:00")]
    assert [tuple(r) for r in graph.place.orderBy("id").collect()] == [(7, '"A'), (8, "")]
    with pytest.raises(AttributeError):
        graph.nothing  # noqa: B018


def test_parquet_graph(spark, tmp_path):
    graph = source.from_star(spark, "/root/testdata/sf0.001")
    source.write_parquet(graph, str(tmp_path / "g"))
    again = source.load_parquet(spark, str(tmp_path / "g"))
    for name in source.FILES:
        assert getattr(again, name).schema == getattr(graph, name).schema or getattr(again, name).columns == getattr(graph, name).columns
        assert getattr(again, name).exceptAll(getattr(graph, name)).count() == 0 == getattr(graph, name).exceptAll(getattr(again, name)).count()


def test_staged_tables_are_freed(spark):
    graph = source.from_star(spark, "/root/testdata/sf0.001")
    folder = os.path.join(staging.shared_dir(spark), "graphloom-staged")
    listed = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = listed()
    with staging.scope():
        assert q.distances(graph, 7, 3).count() == 150
    kept = listed() - before
    assert len(kept) == 1  # the edge index, which is the graph's
    for query in (lambda: q.friends_by_name(graph, 7, "BUILDING").collect(), lambda: q.path_length(graph, 7, 0).collect(), lambda: walk.bfs(q.edges_of(graph, True), spark.range(5, 9), local=2).collect()):
        with staging.scope():
            query()
        assert listed() - before == kept
    tables = spark.sql(f"SHOW TABLES IN {staging.DATABASE}").count()
    graph.close()
    assert listed() == before and spark.sql(f"SHOW TABLES IN {staging.DATABASE}").count() == tables - 1
