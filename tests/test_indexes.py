"""Dense codes, offsets and slots, the search that keeps nothing on the driver, and sweeps over long ranges."""

import shutil
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import staging
from graphloom.functions import logic
from graphloom.operators import csr, dense
from graphloom.operators import relational as rel
from graphloom.operators import traverse as walk
from graphloom.plans import registry

LIST = [(0, 1, 10), (0, 3, 11), (2, 0, 15), (2, 5, 20), (7, 1, 30)]
OFFSETS = [(0, 0, 2), (1, 2, 2), (2, 2, 4), (3, 4, 4), (4, 4, 4), (5, 4, 4), (6, 4, 4), (7, 4, 5)]


def listed(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, at long")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [1, 2, 100])
def test_offsets_and_slices(spark, rows):
    index = csr.from_sorted(listed(spark, LIST), "at", rows=rows)
    assert (index.nodes, index.edges) == (8, 5)
    assert sorted(map(tuple, index.offsets.select("node", "begin", "end").collect())) == OFFSETS
    assert [index.degree(n) for n in (0, 1, 2, 7, 8, -1)] == [2, 0, 2, 1, None, None]
    assert sorted(map(tuple, index.neighbours(2).collect())) == [(2, 2, 0, 0), (3, 2, 5, 5)]
    assert index.neighbours(1).count() == index.neighbours(99).count() == 0
    assert [[r["dst"] for r in index.kth(2, k).collect()] for k in (-1, 0, 1, 2)] == [[], [0], [5], []]


@pytest.mark.parametrize("rows", [1, 2, 100])
@pytest.mark.parametrize(("edges", "place", "kind"), [([(0, 1, 0), (0, 1, 4)], 4, "repeated"), ([(0, 3, 0), (0, 1, 1), (0, 0, 2)], 1, "unsorted"), ([(0, 1, 0), (2, 0, 5), (1, 0, 7)], 7, "unsorted")])
def test_refused_lists(spark, rows, edges, place, kind):
    with pytest.raises(csr.EdgesNotSorted) as refused:
        csr.from_sorted(listed(spark, edges), "at", rows=rows)
    assert (refused.value.place, refused.value.kind) == (place, kind) and isinstance(refused.value, ValueError)


def test_empty_lists_and_gaps(spark, monkeypatch):
    nothing = listed(spark, LIST).limit(0)
    assert csr.from_sorted(nothing, "at").nodes == 0 and csr.from_sorted(nothing, "at", 3).offsets.count() == 3
    monkeypatch.setattr(csr, "GAP", 3)
    wide = csr.from_sorted(listed(spark, [(5, 20, 0), (17, 0, 1)]), "at", 30)
    assert sorted(map(tuple, wide.offsets.select("node", "begin", "end").collect())) == [(n, (n > 5) + (n > 17), (n >= 5) + (n >= 17)) for n in range(30)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40), st.integers(1, 20))
def test_slices_like_a_dict(spark, pairs, rows):
    around = {}
    for a, b in sorted(pairs):
        around.setdefault(a, []).append(b)
    index = csr.from_sorted(listed(spark, [(a, b, i) for i, (a, b) in enumerate(sorted(pairs))]), "at", rows=rows)
    assert {r["node"]: r["end"] - r["begin"] for r in index.offsets.collect()} == {n: len(around.get(n, [])) for n in range(max(max(p) for p in pairs) + 1)}
    node = min(around)
    assert [r["dst"] for r in index.neighbours(node).orderBy("position").collect()] == around[node]


def test_a_slice_is_read_from_its_parts(spark):
    edges = spark.range(1000).select(F.expr("id div 10").alias("src"), (F.col("id") % 10).alias("dst"), F.col("id").alias("at"))
    index = csr.from_sorted(edges, "at", rows=100)
    assert len(index.starts) > 5
    found = index.neighbours(50)
    assert found.count() == 10 and "part#" in plan(found).split("PartitionFilters")[1][:80]
    touched = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert len(touched) <= 2 < len(index.slots.inputFiles())


def test_dense_codes(spark):
    codes = dense.dictionary(spark.createDataFrame([(50,), (7,), (7,), (None,)], "id long"), "id")
    assert sorted(map(tuple, codes.by_key.collect())) == [(7, 0), (50, 1)]
    edges = spark.createDataFrame([(50, 7, "a"), (7, 7, "b"), (9, 7, "c"), (None, 7, "d")], "src long, dst long, note string")
    coded = dense.encode_edges(edges, codes)
    assert sorted(map(tuple, coded.collect())) == [(0, 0, "b"), (1, 0, "a")]
    assert sorted(map(tuple, dense.decode_edges(coded, codes).collect())) == [(7, 7, "b"), (50, 7, "a")]


def test_coding_shuffles_edges_once_a_column(spark):
    codes = dense.dictionary(spark.range(100), "id")
    edges = staging.stage(spark.range(500).select((F.col("id") % 100).alias("src"), F.expr("id % 7").alias("dst")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shown = plan(dense.encode_edges(edges, codes))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shown.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(key" not in shown


def test_a_level_does_not_shuffle_visited_nodes(spark):
    edges = walk.edge_index(walk.symmetric(spark.range(300).select(F.col("id").alias("p1"), (F.col("id") + 1).alias("p2"))))
    visited = staging.Grown(spark, "id", "distance")
    for hop in range(3):
        visited.append(spark.createDataFrame([(50 - hop, hop, None), (50 + hop, hop, None)][: 2 if hop else 1], walk.REACHED))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        level = walk.next_level(edges, visited.table(), 3)
        shown = plan(level)
        assert {r["id"] for r in level.collect()} == {47, 53}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # only the new nodes by their id; edges, visited nodes and the frontier among them lie in buckets
    assert shown.count("Exchange") == 1 and "LeftAnti" in shown and "Bucketed: true" in shown


def test_long_searches_keep_nothing_on_the_driver(spark):
    edges = walk.edge_index(walk.symmetric(spark.range(40).select(F.col("id").alias("p1"), (F.col("id") + 1).alias("p2"))))
    start = spark.range(1)
    assert {r["id"]: r["distance"] for r in walk.bfs(edges, start, 12, local=0).collect()} == {i: i for i in range(13)}
    assert walk.bfs(edges, start, target=5, local=0).where("id = 5").first()["distance"] == 5


def test_levels_have_tasks_by_rows_and_not_by_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        edges = walk.edge_index(spark.range(1, 400).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
        found = walk.bfs(edges, spark.range(1), local=0)
        assert found.count() == 400 and staging.buckets(edges) == spark.sparkContext.defaultParallelism < 64
        # a file for each bucket that a level has rows in: the source, and its neighbours
        assert len(found.inputFiles()) <= 1 + staging.buckets(edges)
        level = plan(walk.next_level(edges, found.where("distance = 0"), 1))
        assert "hashpartitioning(dst" in level and ", 64)" not in level
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_indexes_have_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(staging, "BUCKET_ROWS", 10)
    edges = walk.edge_index(spark.range(95).select("id", (F.col("id") + 1).alias("to")).toDF("src", "dst"))
    assert staging.buckets(edges) == 10 and walk.bfs(edges, spark.range(1), local=0).count() == 96


def test_long_ranges_are_swept_once(spark):
    """200,000 rows in one range; a frame evaluated anew for each row would take minutes."""
    began = time.perf_counter()
    keys = spark.range(200_000)
    found = rel.align(keys, "id", spark.range(0, 200_000, 3), "id", -1, 10**9).agg(F.sum("floor_bound"), F.sum("next_bound")).first()
    assert tuple(found) == (sum(i - i % 3 for i in range(200_000)), sum(i - i % 3 + 3 for i in range(199_998)) + 2 * 10**9)
    assert time.perf_counter() - began < 40


def test_many_ranges_carry_both_ways(spark):
    keys = spark.range(3000)
    bounds = spark.createDataFrame([(100,), (2900,)], "b long")
    found = rel.align(keys, "id", bounds, "b", -1, 9999, 50)
    assert {(r["floor_bound"], r["next_bound"], r["count"]) for r in found.groupBy("floor_bound", "next_bound").count().collect()} == {(-1, 100, 100), (100, 2900, 2800), (2900, 9999, 100)}


@pytest.mark.parametrize(("octets", "high", "low"), [([1, 2], 0, 513), ([255] * 8, 0, 2**64 - 1), ([0] * 8 + [1], 1, 0), ([255] * 16, 2**64 - 1, 2**64 - 1), ([0] * 15 + [64], 2**62, 0), ([], 0, 0)])
def test_wide_bytes(spark, octets, high, low):
    one = spark.createDataFrame([(octets,)], "o array<int>").select(logic.limbs(F.col("o")).alias("l"), logic.wide_little_endian(F.col("o")).alias("n")).first()
    value = int.from_bytes(bytes(octets), "little")
    assert (int(one["l"]["high"]), int(one["l"]["low"])) == (high, low) and (None if one["n"] is None else int(one["n"])) == (value if value < 10**38 else None)


def test_what_is_no_sixteen_bytes_is_null(spark):
    odd = spark.createDataFrame([([1] * 17,), ([256],), ([-1],), ([None],), (None,)], "o array<int>")
    assert all(r[0] is None and r[1] is None for r in odd.select(logic.limbs(F.col("o")), logic.wide_little_endian(F.col("o"))).collect())
    edge = spark.createDataFrame([(list(x.to_bytes(16, "little")),) for x in (10**38 - 1, 10**38)], "o array<int>")
    assert [r[0] and int(r[0]) for r in edge.select(logic.wide_little_endian(F.col("o"))).collect()] == [10**38 - 1, None]


def test_a_graph_is_made_anew_when_its_tables_change(spark, tmp_path):
    folder = str(tmp_path / "star")
    shutil.copytree("/root/testdata/sf0.001", folder)
    before = registry.graph(spark, folder)
    assert registry.graph(spark, folder) is before
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").limit(5).write.parquet(folder + "/new")
    shutil.rmtree(f"{folder}/customer.parquet") if (tmp_path / "star" / "customer.parquet").is_dir() else (tmp_path / "star" / "customer.parquet").unlink()
    shutil.move(folder + "/new", f"{folder}/customer.parquet")
    after = registry.graph(spark, folder)
    assert after is not before and after.person.count() == 5


def test_one_failed_delete_does_not_keep_the_others(spark):
    table = staging.stage(spark.range(3))
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    entries = [e for e in staging._staged if e[1].split(":")[-1].strip("/") == path.strip("/")]
    staging.free([*entries, (spark, "nosuchscheme://x/y", None)])
    assert not __import__("os").path.exists(path)
