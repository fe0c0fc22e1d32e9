"""The registered queries, with the parameters they run with, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode, logic
from ..operators import csr, dense
from ..operators import relational as rel
from ..operators import traverse as walk
from ..operators import verify
from ..sources.graph import Graph, from_star, load_delimited, load_parquet, write_delimited, write_parquet
from ..sources.star import BASE_TABLES, with_views
from ..staging import free, owned, stage, staged_path
from . import queries as q

PERSON, OTHER, ALONE = 7, 0, 100
NAME = "BUILDING"
POST, COMMENT, MISSING = 1234, 1000000042, 999999999
UNTIL = "2024-01-15 00:00:00"
LOW, HIGH = 0, 100_000_000_000_000

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


_graphs: dict[tuple[str, str], tuple[tuple, Graph]] = {}


def _written(spark: SparkSession, sf_dir: str) -> tuple:
    """When the files of the base tables were last written, and their sizes."""
    found = []
    for table in BASE_TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        found += sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files)
    return tuple(found)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder; one for each session and folder, so that its indexes are built once, and a new one when the
    folder's tables have been written anew."""
    key, written = (spark.sparkContext.applicationId, sf_dir), _written(spark, sf_dir)
    before, found = _graphs.get(key, (None, None))
    if before != written:
        if found is not None:
            found.close()
        _graphs[key] = written, (found := from_star(spark, sf_dir))
    return found


def settled(run: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    """``run`` with its result staged, so that what it staged on the way can be freed."""

    def both(g: Graph) -> DataFrame:
        with owned() as passing:
            out = run(g)
        kept = stage(out)
        free(passing)
        return kept

    return both


def add(name: str, sql: str, run: Callable[[Graph], DataFrame]) -> None:
    """Register a query; the results of checks are few rows, and their intermediate tables go with the check."""
    run = settled(run) if name.startswith("verify") else run
    _queries[name] = lambda spark, sf_dir: run(graph(spark, sf_dir))
    _sql[name] = with_views(sql)


def until():
    return F.lit(UNTIL).cast("timestamp_ntz")


# ---- short reads

_PROFILE = "first_name, last_name, birthday, location_ip, browser_used, place_id AS city_id, gender, creation_date"
add("is1_profile", f" SELECT {_PROFILE} FROM person JOIN located ON id = person_id WHERE id = {PERSON}", lambda g: q.profile(g, PERSON))
add(
    "is1_adjacency",
    f", slots AS (SELECT person_id, place_id, row_number() OVER (ORDER BY person_id, place_id) - 1 AS position FROM (SELECT DISTINCT person_id, place_id FROM located)) SELECT {_PROFILE}, position FROM person JOIN slots ON id = person_id WHERE id = {PERSON}",
    lambda g: q.profile_by_adjacency(g, PERSON),
)
_FRIENDS = f" SELECT p.id AS friend_id, p.first_name, p.last_name, k.creation_date FROM knows k JOIN person p ON p.id = CASE WHEN p1 = {PERSON} THEN p2 ELSE p1 END WHERE p1 <> p2 AND (p1 = {PERSON} OR p2 = {PERSON})"
add("is3_friends", _FRIENDS, lambda g: q.friends(g, PERSON))
add("knows_undirected", _FRIENDS, lambda g: q.friends_unordered(g, PERSON))
add("knows_directed", f" SELECT p.id AS friend_id, p.first_name, p.last_name, k.creation_date FROM knows k JOIN person p ON p.id = p2 WHERE p1 = {PERSON} AND p2 <> {PERSON}", lambda g: q.friends_directed(g, PERSON))
add(
    "knows_symmetrised",
    f", both_ways AS (SELECT p1, p2, creation_date FROM knows WHERE p1 <> p2 UNION ALL SELECT p2, p1, creation_date FROM knows WHERE p1 <> p2) SELECT p.id AS friend_id, p.first_name, p.last_name, k.creation_date FROM both_ways k JOIN person p ON p.id = p2 WHERE p1 = {PERSON}",
    lambda g: q.friends_symmetrised(g, PERSON),
)
_MESSAGES = ", message AS (SELECT id, creation_date, content, image_file, 0 AS type FROM comment UNION ALL SELECT id, creation_date, content, image_file, 1 FROM post), creator AS (SELECT message_id, person_id, 0 AS type FROM comment_creator UNION ALL SELECT message_id, person_id, 1 FROM post_creator)"
for _name, _id in (("is4_message", POST), ("is4_comment", COMMENT)):
    add(_name, f"{_MESSAGES} SELECT creation_date, coalesce(nullif(content, ''), image_file) AS content, type FROM message WHERE id = {_id}", lambda g, i=_id: q.message(g, i))
for _name, _id in (("is5_creator", POST), ("is5_comment_creator", COMMENT)):
    add(_name, f"{_MESSAGES} SELECT p.id, p.first_name, p.last_name FROM creator c JOIN person p ON p.id = c.person_id WHERE message_id = {_id}", lambda g, i=_id: q.creator(g, i))
_LOOKUP = f"{_MESSAGES}, tables AS (SELECT unnest([0, 1]) AS type)"
for _name, _id in (("is4_lookup", POST), ("is4_lookup_missing", MISSING)):
    add(_name, f"{_LOOKUP} SELECT t.type, m.id IS NOT NULL AS found, m.creation_date, coalesce(nullif(content, ''), image_file) AS content FROM tables t LEFT JOIN message m ON m.type = t.type AND m.id = {_id}", lambda g, i=_id: q.message_lookup(g, i))
add("is5_lookup", f"{_LOOKUP} SELECT t.type, c.message_id IS NOT NULL AS found, c.person_id FROM tables t LEFT JOIN creator c ON c.type = t.type AND c.message_id = {COMMENT}", lambda g: q.creator_lookup(g, COMMENT))

# ---- traversal

_BOTH = "SELECT p1 AS src, p2 AS dst FROM knows WHERE p1 <> p2 UNION ALL SELECT p2, p1 FROM knows WHERE p1 <> p2"
_ONE_WAY = "SELECT p1 AS src, p2 AS dst FROM knows WHERE p1 <> p2"


def _bfs(source: int, hops: int, edges: str) -> str:
    return f""", ed AS (SELECT DISTINCT e.src, e.dst FROM ({edges}) e JOIN person a ON a.id = e.src JOIN person b ON b.id = e.dst),
        steps AS (SELECT CAST(id AS BIGINT) AS id, 0 AS d FROM person WHERE id = {source} UNION SELECT ed.dst, s.d + 1 FROM steps s JOIN ed ON ed.src = s.id WHERE s.d < {hops}),
        near AS (SELECT id, min(d) AS distance FROM steps GROUP BY id),
        bfs AS (SELECT n.id, n.distance, min(b.id) AS predecessor FROM near n LEFT JOIN ed ON ed.dst = n.id AND n.distance > 0 LEFT JOIN near b ON b.id = ed.src AND b.distance = n.distance - 1 GROUP BY n.id, n.distance)"""


def _everyone(hops: int, edges: str) -> str:
    return _bfs(PERSON, hops, edges) + " SELECT p.id, distance, predecessor FROM person p LEFT JOIN bfs ON bfs.id = p.id"


add("sssp_undirected_3", _everyone(3, _BOTH), lambda g: q.distances(g, PERSON, 3))
add("sssp_directed_4", _everyone(4, _ONE_WAY), lambda g: q.distances(g, PERSON, 4, undirected=False))
add("sssp_symmetrised_3", _everyone(3, _BOTH), lambda g: q.distances_symmetrised(g, PERSON, 3))
add("sssp_unbounded", _everyone(32, _BOTH), lambda g: q.distances(g, PERSON, None))
for _k in range(2, 7):
    add(f"bfs_hop{_k}", _bfs(OTHER, _k, _ONE_WAY) + " SELECT distance AS hop, id FROM bfs WHERE distance > 0", lambda g, k=_k: q.hop_levels(g, OTHER, k))


def _path(b: int) -> str:
    return _bfs(PERSON, 32, _BOTH) + f" SELECT coalesce(min(distance), -1) AS distance FROM bfs WHERE id = {b}"


add("ic13_shortest_path", _path(OTHER), lambda g: q.path_length(g, PERSON, OTHER))
add("ic13_unreachable", _path(ALONE), lambda g: q.path_length(g, PERSON, ALONE))
# the same searches with nothing held on the driver
add("sssp_distributed", _everyone(32, _BOTH), lambda g: q.distances(g, PERSON, None, local=0))
add("bfs_distributed_4", _bfs(OTHER, 4, _ONE_WAY) + " SELECT distance AS hop, id FROM bfs WHERE distance > 0", lambda g: q.hop_levels(g, OTHER, 4, local=0))
add("ic13_distributed", _path(OTHER), lambda g: q.path_length(g, PERSON, OTHER, local=0))
add("adjacency_index", f", ed AS ({_BOTH}), lists AS (SELECT src, list_sort(list(DISTINCT dst)) AS t FROM ed GROUP BY src), sums AS (SELECT src, t, sum(len(t)) OVER (ORDER BY src) AS e FROM lists) SELECT src, array_to_string(t, ',') AS targets, (e - len(t))::BIGINT AS slice_begin, e::BIGINT AS slice_end FROM sums",
    lambda g: walk.adjacency(walk.symmetric(g.knows)).select("src", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"), F.col("begin").alias("slice_begin"), F.col("end").alias("slice_end")))
add("adjacency_positions", f", ed AS ({_BOTH}) SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS position FROM (SELECT DISTINCT src, dst FROM ed) e",
    lambda g: walk.positions(walk.symmetric(g.knows)).withColumn("position", F.col("position").cast("long")))
add("adjacency_counts", f", ed AS (SELECT DISTINCT src, dst FROM ({_BOTH}) e) SELECT count(DISTINCT src) AS nodes, count(*) AS edges FROM ed",
    lambda g: walk.symmetric(g.knows).distinct().groupBy("src").count().agg(F.count("*").alias("nodes"), F.coalesce(F.sum("count"), F.lit(0)).alias("edges")))

add("edge_weights", f" SELECT src, dst, dst AS weight FROM ({_BOTH}) e", lambda g: walk.weighted(walk.symmetric(g.knows)))

# ---- dense codes, offsets and slots

_CODES = f", codes AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM person), coded AS (SELECT DISTINCT a.code AS src, b.code AS dst FROM ({_BOTH}) e JOIN codes a ON a.id = e.src JOIN codes b ON b.id = e.dst)"
add("dense_edges", _CODES + " SELECT src, dst FROM coded", lambda g: dense.encode_edges(q.edges_of(g, True), q.person_codes(g)).select("src", "dst"))
add("dense_decoded", f" SELECT DISTINCT e.src, e.dst FROM ({_BOTH}) e JOIN person a ON a.id = e.src JOIN person b ON b.id = e.dst", lambda g: dense.decode_edges(q.friend_csr(g).slots.select("src", "dst"), q.person_codes(g)).select("src", "dst"))
add("csr_offsets", _CODES + ", deg AS (SELECT code, count(dst) AS n FROM codes LEFT JOIN coded ON src = code GROUP BY code) SELECT code AS node, (sum(n) OVER (ORDER BY code) - n)::BIGINT AS begin, (sum(n) OVER (ORDER BY code))::BIGINT AS \"end\" FROM deg", lambda g: q.friend_csr(g).offsets.select("node", "begin", "end"))
add("csr_slots", _CODES + " SELECT row_number() OVER (ORDER BY src, dst) - 1 AS position, src, dst, dst AS weight FROM coded", lambda g: q.friend_csr(g).slots.select("position", "src", "dst", "weight"))
add("csr_counts", _CODES + " SELECT (SELECT count(*) FROM codes) AS nodes, (SELECT count(*) FROM coded) AS edges", lambda g: g.spark.range(1).select(F.lit(q.friend_csr(g).nodes).cast("long").alias("nodes"), F.lit(q.friend_csr(g).edges).cast("long").alias("edges")))
add("csr_friends", _bfs(PERSON, 1, _BOTH) + " SELECT row_number() OVER (ORDER BY id) - 1 AS k, id AS friend_id FROM bfs WHERE distance = 1", lambda g: q.friends_by_slots(g, PERSON))
add("csr_second_friend", _bfs(PERSON, 1, _BOTH) + " SELECT id AS friend_id, n AS degree FROM (SELECT id, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM bfs WHERE distance = 1) x WHERE k = 2", lambda g: q.kth_friend(g, PERSON, 1))


def _csr_faults(g: Graph) -> DataFrame:
    listed = stage(rel.dense_index(walk.directed(g.knows).distinct(), ["src", "dst"], "place").withColumn("place", F.col("place") * 10))
    again = listed.where("place % 1000 = 30").withColumn("place", F.col("place") + 5)
    moved = listed.withColumn("place", F.when(F.col("place") % 1000 == 70, F.col("place") - 25).otherwise(F.col("place")))
    return _both(csr.faults(listed, "place"), csr.faults(moved.union(again), "place"))


add(
    "csr_faults",
    f""", ed AS (SELECT src, dst, (row_number() OVER (ORDER BY src, dst) - 1) * 10 AS place FROM (SELECT DISTINCT src, dst FROM ({_ONE_WAY}) x) y),
        l AS (SELECT src, dst, CASE WHEN place % 1000 = 70 THEN place - 25 ELSE place END AS place FROM ed UNION ALL SELECT src, dst, place + 5 FROM ed WHERE place % 1000 = 30),
        p AS (SELECT *, lag(src) OVER (ORDER BY place) AS s, lag(dst) OVER (ORDER BY place) AS d FROM l)
        SELECT place, src, dst, CASE WHEN s = src AND d = dst THEN 'repeated' ELSE 'unsorted' END AS fault, true AS tampered FROM p WHERE s > src OR (s = src AND d >= dst)""",
    _csr_faults,
)

# ---- tables written and read again


def _reread(g: Graph, write: Callable[[Graph, str], None], load: Callable[[SparkSession, str], Graph]) -> DataFrame:
    folder = staged_path(g.spark)
    write(g, folder)
    again = load(g.spark, folder)
    home = again.located.join(again.place.select(F.col("id").alias("place_id"), F.col("name").alias("city")), "place_id").select(F.col("person_id").alias("id"), "city")
    return again.person.join(home, "id").join(again.knows.groupBy(F.col("p1").alias("id")).agg(F.max("creation_date").alias("last_friendship")), "id", "left").select("id", "first_name", "last_name", "gender", "birthday", "location_ip", "city", "last_friendship")


_REREAD = " SELECT p.id, first_name, last_name, gender, birthday, location_ip, pl.name AS city, (SELECT max(k.creation_date) FROM knows k WHERE k.p1 = p.id) AS last_friendship FROM person p JOIN located l ON l.person_id = p.id JOIN place pl ON pl.id = l.place_id"
add("delimited_files", _REREAD, lambda g: _reread(g, write_delimited, load_delimited))
add("parquet_files", _REREAD, lambda g: _reread(g, write_parquet, load_parquet))

# ---- complex reads


def _by_name(edges: str) -> str:
    return _bfs(PERSON, 3, edges) + f""", first AS (SELECT p.*, b.distance, row_number() OVER (ORDER BY b.distance, p.last_name, p.id) AS rank FROM bfs b JOIN person p ON p.id = b.id
            WHERE b.distance > 0 AND p.first_name = '{NAME}' QUALIFY rank <= 20),
        org AS (SELECT o.id, o.name, pl.name AS place FROM organisation o LEFT JOIN org_located l ON l.org_id = o.id LEFT JOIN place pl ON pl.id = l.place_id),
        mails AS (SELECT person_id, string_agg(DISTINCT email, ';' ORDER BY email) AS v FROM email GROUP BY person_id),
        langs AS (SELECT person_id, string_agg(DISTINCT language, ';' ORDER BY language) AS v FROM speaks GROUP BY person_id),
        unis AS (SELECT person_id, string_agg(DISTINCT x, ';' ORDER BY x) AS v FROM (SELECT person_id, concat_ws(':', name, class_year, place) AS x FROM study_at JOIN org ON org.id = org_id) j GROUP BY person_id),
        jobs AS (SELECT person_id, string_agg(DISTINCT x, ';' ORDER BY x) AS v FROM (SELECT person_id, concat_ws(':', name, work_from, place) AS x FROM work_at JOIN org ON org.id = org_id) j GROUP BY person_id)
        SELECT rank::INTEGER AS rank, f.id, last_name, distance, birthday, creation_date, gender, browser_used, location_ip, pl.name AS city,
            coalesce(mails.v, '') AS emails, coalesce(langs.v, '') AS languages, coalesce(unis.v, '') AS universities, coalesce(jobs.v, '') AS companies
        FROM first f LEFT JOIN located l ON l.person_id = f.id LEFT JOIN place pl ON pl.id = l.place_id LEFT JOIN mails ON mails.person_id = f.id
            LEFT JOIN langs ON langs.person_id = f.id LEFT JOIN unis ON unis.person_id = f.id LEFT JOIN jobs ON jobs.person_id = f.id"""


add("ic1_friends_by_name", _by_name(_BOTH), lambda g: q.friends_by_name(g, PERSON, NAME))
add("ic1_directed", _by_name(_ONE_WAY), lambda g: q.friends_by_name(g, PERSON, NAME, undirected=False))


def _newest(people: str, compare: str) -> str:
    return f"""{_MESSAGES}, people AS ({people}), first AS (SELECT m.*, c.person_id, row_number() OVER (ORDER BY m.creation_date DESC, m.id, m.type) AS rank
            FROM message m JOIN creator c ON c.message_id = m.id AND c.type = m.type JOIN people ON people.person_id = c.person_id WHERE m.creation_date {compare} TIMESTAMP '{UNTIL}' QUALIFY rank <= 20)
        SELECT rank::INTEGER AS rank, f.person_id, p.first_name, p.last_name, f.id AS message_id, f.creation_date, coalesce(nullif(f.content, ''), f.image_file) AS content, f.type
        FROM first f JOIN person p ON p.id = f.person_id"""


_DIRECT = f"SELECT DISTINCT p.id AS person_id FROM knows JOIN person p ON p.id = CASE WHEN p1 = {PERSON} THEN p2 ELSE p1 END WHERE p1 <> p2 AND (p1 = {PERSON} OR p2 = {PERSON})"
add("ic2_recent_messages", _newest(_DIRECT, "<="), lambda g: q.recent_messages(g, PERSON, until()))
add("ic9_two_hop_messages", _bfs(PERSON, 2, _BOTH) + _newest("SELECT id AS person_id FROM bfs WHERE distance > 0", "<"), lambda g: q.recent_messages_two_hops(g, PERSON, until()))

# ---- sets, alignment, encoders

_IDS = list(range(1, 51))
add("set_expand", f"{_MESSAGES} SELECT message_id, person_id, type, person_id BETWEEN 1 AND 50 AS in_set FROM creator", lambda g: q.set_expand(g, g.spark.range(1, 51)))
add("multi_match", f"{_MESSAGES} SELECT message_id, person_id, type, " + ", ".join(f"person_id = {i + 1} AS match_{i}" for i in range(10)) + " FROM creator", lambda g: q.multi_match(g, _IDS))


def _bounds(g: Graph) -> DataFrame:
    return g.knows.where(F.col("p1") % 5 == 0).select(F.col("p1").alias("bound")).distinct()


def _aligned(g: Graph) -> DataFrame:
    return rel.align(g.person.select("id"), "id", _bounds(g), "bound", LOW, HIGH)


_ALIGN = f", bounds AS (SELECT DISTINCT p1 AS bound FROM knows WHERE p1 % 5 = 0), ext AS (SELECT bound FROM bounds UNION SELECT {LOW} UNION SELECT {HIGH}), nxt AS (SELECT bound, lead(bound) OVER (ORDER BY bound) AS following FROM ext), aligned AS (SELECT p.id, n.bound AS floor_bound, n.following AS next_bound FROM person p JOIN nxt n ON n.bound <= p.id AND p.id < n.following)"
add("asof_align", _ALIGN + " SELECT * FROM aligned", _aligned)
add("adjacent_pairs", ", ids AS (SELECT DISTINCT p1 FROM knows) SELECT p1, lead(p1) OVER (ORDER BY p1) AS next FROM ids", lambda g: rel.adjacent_pairs(g.knows, "p1"))
add("dense_index", " SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM organisation", lambda g: rel.dense_index(g.organisation.select("id"), "id").withColumn("index", F.col("index").cast("long")))
_OUTSIDE = f", bounds AS (SELECT DISTINCT p1 AS bound FROM knows WHERE p1 % 5 = 0), ext AS (SELECT bound FROM bounds UNION SELECT -1 UNION SELECT {HIGH}), nxt AS (SELECT bound AS below, lead(bound) OVER (ORDER BY bound) AS above FROM ext), wit AS (SELECT p.id, below, above FROM person p JOIN nxt n ON n.below < p.id AND p.id < n.above)"
add("non_members", _OUTSIDE + " SELECT id, below, above FROM wit", lambda g: rel.outsiders(g.person, "id", _bounds(g), "bound", -1, HIGH))
add("canonical_pairs", " SELECT p1, p2, least(p1, p2) AS low, greatest(p1, p2) AS high FROM knows WHERE p1 <> p2", lambda g: rel.canonical_pair(g.knows.select("p1", "p2")))


def _codes_sql(c: str) -> str:
    each = f"list_transform(range(1, length({c}) + 1), lambda i: i * unicode(substr({c}, i, 1)))"
    return f"coalesce(list_sum({each}), 0)::BIGINT"


_BYTES = "list_transform(range(0, octet_length(encode(last_name))), lambda i: ('0x' || substr(hex(encode(last_name)), (2 * i + 1)::INTEGER, 2))::INTEGER::HUGEINT)"
add("encode_strings",
    f", powers AS (SELECT 0 AS i, 1::HUGEINT AS p UNION ALL SELECT i + 1, (p * 31) % 18446744073709551616 FROM powers WHERE i < 100), pw AS (SELECT list(p ORDER BY i) AS pl FROM powers), b AS (SELECT *, {_BYTES} AS octets FROM person, pw)"
    f" SELECT id, {_codes_sql('first_name')} AS first_code, {_codes_sql('last_name')} AS last_code, ((list_sum(list_transform(range(1, len(octets) + 1), lambda i: (octets[i] * pl[i]) % 18446744073709551616))::HUGEINT % 18446744073709551616) % 4294967295)::BIGINT AS name_code,"
    " CASE WHEN gender = 'male' THEN 1 ELSE 0 END AS gender_code FROM b",
    lambda g: g.person.select("id", encode.string_code(F.col("first_name")).alias("first_code"), encode.string_code(F.col("last_name")).alias("last_code"), encode.name_code(F.col("last_name")).alias("name_code"), encode.gender_code(F.col("gender")).alias("gender_code")))
add("encode_dates", " SELECT id, (year(birthday) * 365 + month(birthday) * 30 + day(birthday))::BIGINT AS birthday_code, (year(creation_date) * 365 + month(creation_date) * 30 + day(creation_date))::BIGINT AS creation_code FROM person",
    lambda g: g.person.select("id", encode.date_code(F.col("birthday").cast("string")).alias("birthday_code"), encode.stamp_code(F.date_format("creation_date", "yyyy-MM-dd'T'HH:mm:ss")).alias("creation_code")))
add("encode_ipv4", " SELECT id, split_part(location_ip, '.', 1)::BIGINT * 16777216 + split_part(location_ip, '.', 2)::BIGINT * 65536 + split_part(location_ip, '.', 3)::BIGINT * 256 + split_part(location_ip, '.', 4)::BIGINT AS ip_code FROM person",
    lambda g: g.person.select("id", encode.ipv4_code(F.col("location_ip")).alias("ip_code")))


def _wide(g: Graph) -> DataFrame:
    """Sixteen bytes of each friendship as one number."""
    part = lambda c, n: [F.pmod(F.shiftright(F.col(c) * 2654435761, 4 * i), F.lit(256)) for i in range(n)]
    octets = F.array(*part("p1", 8), *part("p2", 8))
    pair = logic.limbs(octets)
    return g.knows.select("p1", "p2", pair["high"].cast("string").alias("high"), pair["low"].cast("string").alias("low"), logic.wide_little_endian(octets).cast("string").alias("number"))


_OCTET = "((({} * 2654435761) >> {}) % 256)::UHUGEINT * {}::UHUGEINT"
_LOW, _HIGH = (" + ".join(_OCTET.format(c, 4 * i, 256**i) for i in range(8)) for c in ("p1", "p2"))
add("wide_bytes", f", v AS (SELECT p1, p2, {_LOW} AS low, {_HIGH} AS high FROM knows), w AS (SELECT *, high * 18446744073709551616::UHUGEINT + low AS number FROM v) SELECT p1, p2, high::VARCHAR AS high, low::VARCHAR AS low, CASE WHEN number < {10**38}::UHUGEINT THEN number::VARCHAR END AS number FROM w", _wide)


def _logic(g: Graph) -> DataFrame:
    a, b = F.col("p1") % 2 == 0, F.col("p2") % 3 == 0
    octets = F.array(*[F.pmod(F.shiftright(F.col("p1"), i * 8), F.lit(256)) for i in range(4)])
    return g.knows.select(
        "p1", "p2", logic.all_of(a, b).alias("both"), logic.any_of(a, b).alias("either"), logic.negate(a).alias("neither"), logic.differ(a, b).alias("differ"), logic.choose(a, F.col("p1"), F.col("p2")).alias("chosen"),
        logic.in_range(F.col("p1"), 256).alias("is_byte"), logic.is_bit(F.col("p1")).alias("is_bit"), logic.is_zero(F.col("p1")).alias("is_zero"), logic.total(F.col("p1"), F.col("p2"), logic.lift(1)).alias("total"),
        logic.power_of_two((F.col("p1") % 40).cast("int")).alias("power"), logic.little_endian(octets).alias("again"),
    )


add("scalar_logic", " SELECT p1, p2, p1 % 2 = 0 AND p2 % 3 = 0 AS both, p1 % 2 = 0 OR p2 % 3 = 0 AS either, p1 % 2 <> 0 AS neither, (p1 % 2 = 0) <> (p2 % 3 = 0) AS differ, CASE WHEN p1 % 2 = 0 THEN p1 ELSE p2 END AS chosen, p1 BETWEEN 0 AND 255 AS is_byte, p1 IN (0, 1) AS is_bit, p1 = 0 AS is_zero, p1 + p2 + 1 AS total, (1::BIGINT << (p1 % 40)::INTEGER) AS power, p1 AS again FROM knows", _logic)

# ---- checks, each on a result as computed (no violations) and on one that is tampered with


def _both(clean: DataFrame, tampered: DataFrame) -> DataFrame:
    return clean.withColumn("tampered", F.lit(False)).unionByName(tampered.withColumn("tampered", F.lit(True)))


_ORDER = [("creation_date", True), ("id", False), ("type", False)]


def _top(g: Graph) -> tuple[DataFrame, DataFrame]:
    found = stage(q.message_candidates(g, q.direct_friends(g, PERSON), until(), False).select("id", "type", "creation_date"))
    return found, stage(rel.top_k(found, 20, [F.desc("creation_date"), "id", "type"], "rank"))


def _verify_topk(g: Graph) -> DataFrame:
    candidates, top = _top(g)
    check = lambda t: verify.top_boundary(candidates, t, 20, ["id", "type"], _ORDER)
    return _both(check(top), check(top.where("rank <> 3")))


_TOP = f"{_MESSAGES}, people AS ({_DIRECT}), cand AS (SELECT m.id, m.type, m.creation_date FROM message m JOIN creator c ON c.message_id = m.id AND c.type = m.type JOIN people ON people.person_id = c.person_id WHERE m.creation_date <= TIMESTAMP '{UNTIL}'), ranked AS (SELECT *, row_number() OVER (ORDER BY creation_date DESC, id, type) AS rank FROM cand)"
add("verify_topk", f"{_TOP} SELECT id, type, true AS tampered FROM ranked WHERE (SELECT count(*) FROM cand) > 0 AND (rank = 3 OR rank > 20)", _verify_topk)


def _verify_order(g: Graph) -> DataFrame:
    _, top = _top(g)
    swapped = top.withColumn("rank", F.when(F.col("rank") == 2, 3).when(F.col("rank") == 3, 2).otherwise(F.col("rank")))
    return _both(verify.ordered(top, "rank", _ORDER, strict=True), verify.ordered(swapped, "rank", _ORDER, strict=True))


add("verify_order", f"{_TOP} SELECT 2 AS rank, true AS tampered FROM ranked WHERE rank = 3", _verify_order)


def _verify_membership(g: Graph) -> DataFrame:
    columns = ["id", "first_name", "last_name"]
    found = q.friends_unordered(g, PERSON).select(F.col("friend_id").alias("id"), "first_name", "last_name")
    return _both(verify.members(found, g.person, columns), verify.members(found.withColumn("last_name", F.concat("last_name", F.lit("!"))), g.person, columns))


add("verify_membership", f", found AS ({_FRIENDS}) SELECT friend_id AS id, first_name, last_name || '!' AS last_name, true AS tampered FROM found", _verify_membership)


def _verify_permutation(g: Graph) -> DataFrame:
    rows = g.knows.select("p1", "p2")
    doubled = rows.union(rows.where("p1 % 100 = 0")).where("p2 % 100 <> 1")
    return _both(verify.permutation(rows.orderBy("p2", "p1"), rows), verify.permutation(doubled, rows))


add("verify_permutation", ", t AS (SELECT p1, p2, (CASE WHEN p2 % 100 = 1 THEN 0 WHEN p1 % 100 = 0 THEN 2 ELSE 1 END) - 1 AS surplus FROM knows) SELECT p1, p2, surplus::BIGINT AS surplus, true AS tampered FROM t WHERE surplus <> 0", _verify_permutation)


def _verify_same_set(g: Graph) -> DataFrame:
    ids = q.direct_friends(g, PERSON).withColumnRenamed("person_id", "id")
    hop = stage(walk.hop_levels(q.edges_of(g, True), q.one(g, PERSON), 1).select("id"))
    return _both(verify.same_set(ids, hop), verify.same_set(ids, hop.where("id % 2 = 0")))


add("verify_same_set", f", people AS ({_DIRECT}) SELECT person_id AS id, 1 AS in_first, 0 AS in_second, true AS tampered FROM people WHERE person_id % 2 <> 0", _verify_same_set)


def _verify_partition(g: Graph) -> DataFrame:
    whole = g.knows.select("p1", "p2")
    low, high = whole.where("p1 < p2 - 50"), whole.where("p1 >= p2 - 50")
    return _both(verify.partition(whole, low, high), verify.partition(whole, whole.where("p1 < p2 - 40"), high.where("p1 % 9 <> 0")))


add("verify_partition", ", c AS (SELECT p1, p2, (p1 < p2 - 40)::INTEGER AS s, (p1 >= p2 - 50 AND p1 % 9 <> 0)::INTEGER AS r FROM knows) SELECT p1, p2, (s + r - 1)::BIGINT AS parts, true AS tampered FROM c WHERE s + r <> 1", _verify_partition)


def _verify_slices(g: Graph) -> DataFrame:
    edges = stage(walk.symmetric(g.knows))
    index = stage(walk.positions(edges))
    slots = stage(walk.slices(index))
    moved = slots.withColumn("end", F.when(F.col("src") % 10 == 3, F.col("end") + 1).otherwise(F.col("end")))
    return _both(verify.slices(index, slots, edges), verify.slices(index, moved, edges))


# a moved end is wrong itself, and leaves the slice that follows it without one to begin at (unless one of length 1 is moved there)
add(
    "verify_slices",
    f""", ed AS (SELECT DISTINCT src, dst FROM ({_BOTH}) e), deg AS (SELECT src, count(*) AS n FROM ed GROUP BY src), s AS (SELECT src, sum(n) OVER (ORDER BY src) - n AS b, sum(n) OVER (ORDER BY src) + (src % 10 = 3)::INTEGER AS e FROM deg)
        SELECT src, true AS tampered FROM s WHERE src % 10 = 3 OR (b > 0 AND b NOT IN (SELECT e FROM s))""",
    _verify_slices,
)


def _verify_tags(g: Graph) -> DataFrame:
    _, top = _top(g)
    tables = {0: g.comment, 1: g.post}
    return _both(verify.tags(top, tables), verify.tags(top.withColumn("type", 1 - F.col("type")), tables))


add("verify_tags", f"{_TOP} SELECT id, 1 - type AS type, true AS tampered FROM ranked WHERE rank <= 20", _verify_tags)


def _verify_bfs(g: Graph) -> DataFrame:
    edges = q.edges_of(g, True)
    found = stage(walk.bfs(edges, q.one(g, PERSON), 3))
    far = found.withColumn("distance", F.when(F.col("distance") == 3, 5).otherwise(F.col("distance")))
    return _both(verify.distances(found, edges, PERSON, 3), verify.distances(far, edges, PERSON, 3))


add("verify_bfs", _bfs(PERSON, 3, _BOTH) + " SELECT unnest(['predecessor', 'shortest']) AS \"check\", id, true AS tampered FROM bfs WHERE distance = 3", _verify_bfs)


def _verify_levels(g: Graph) -> DataFrame:
    edges = q.edges_of(g, False)
    found = stage(walk.hop_levels(edges, q.one(g, OTHER), 4))
    return _both(verify.levels(found, edges, OTHER), verify.levels(found.union(found.where("hop = 2").select(F.lit(4), "id")), edges, OTHER))


add(
    "verify_levels",
    _bfs(OTHER, 4, _ONE_WAY) + """, more AS (SELECT id FROM bfs WHERE distance = 2), four AS (SELECT DISTINCT ed.dst AS id FROM ed JOIN bfs ON bfs.id = ed.src WHERE bfs.distance = 3)
        SELECT 'repeated' AS "check", 4 AS hop, id, true AS tampered FROM more UNION ALL SELECT 'unfed', 4, id, true FROM more WHERE id NOT IN (SELECT id FROM four)""",
    _verify_levels,
)


def _verify_alignment(g: Graph) -> DataFrame:
    bounds = stage(_bounds(g))
    found = stage(_aligned(g))
    shifted = found.withColumn("floor_bound", F.when(F.col("id") % 7 == 0, F.lit(LOW)).otherwise(F.col("floor_bound")))
    return _both(verify.alignment(found, "id", bounds, "bound", LOW, HIGH), verify.alignment(shifted, "id", bounds, "bound", LOW, HIGH))


add("verify_alignment", _ALIGN + f" SELECT id, true AS tampered FROM aligned WHERE id % 7 = 0 AND floor_bound <> {LOW}", _verify_alignment)


def _verify_non_members(g: Graph) -> DataFrame:
    bounds = stage(_bounds(g))
    found = stage(rel.outsiders(g.person, "id", bounds, "bound", -1, HIGH))
    flags = stage(rel.member_flag(g.person.select("id"), "id", bounds, "bound"))
    wide = found.withColumn("above", F.when(F.col("id") % 7 == 0, F.lit(HIGH)).otherwise(F.col("above")))
    check = lambda w: verify.absent(w, bounds, "bound", "id", -1, HIGH).withColumn("check", F.lit("witness")).union(verify.witnessed(flags, "id", "in_set", w).withColumn("check", F.lit("flag")))
    return _both(check(found), check(wide.where("id % 11 <> 0")))


add("verify_non_members", _OUTSIDE + f" SELECT id, 'witness' AS \"check\", true AS tampered FROM wit WHERE id % 7 = 0 AND id % 11 <> 0 AND above <> {HIGH} UNION ALL SELECT id, 'flag', true FROM wit WHERE id % 11 = 0", _verify_non_members)


def _verify_in_place(g: Graph) -> DataFrame:
    order = [("src", False), ("dst", False)]
    listed = stage(walk.positions(walk.directed(g.knows)).select(F.col("position").cast("long").alias("position"), "src", "dst").repartitionByRange("position").sortWithinPartitions("position"))
    wrong = listed.withColumn("dst", F.when(F.col("position") % 50 == 7, F.lit(-1)).otherwise(F.col("dst")))
    return _both(verify.ordered_in_place(listed, "position", order, strict=True), verify.ordered_in_place(wrong, "position", order, strict=True))


add(
    "verify_in_place",
    f", ed AS (SELECT src, CASE WHEN place % 50 = 7 THEN -1 ELSE dst END AS dst, place FROM (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS place FROM (SELECT DISTINCT src, dst FROM ({_ONE_WAY}) x) y) z), p AS (SELECT *, lead(src) OVER (ORDER BY place) AS s, lead(dst) OVER (ORDER BY place) AS d FROM ed) SELECT place AS position, true AS tampered FROM p WHERE src > s OR (src = s AND dst >= d)",
    _verify_in_place,
)


def _verify_path(g: Graph) -> DataFrame:
    far = stage(walk.bfs(q.edges_of(g, True), q.one(g, PERSON)))
    length = stage(q.path_length(g, PERSON, OTHER).union(q.path_length(g, PERSON, PERSON)))
    return _both(verify.path_length(length.where("distance > 0"), far, OTHER), verify.path_length(length.where("distance > 0").select((F.col("distance") + 1).alias("distance")), far, OTHER).union(verify.path_length(length.where("distance = 0"), far, ALONE)))


add("verify_path", _bfs(PERSON, 32, _BOTH) + f" SELECT distance + 1 AS distance, true AS tampered FROM bfs WHERE id = {OTHER} UNION ALL SELECT 0, true FROM (SELECT coalesce(min(distance), -1) AS d FROM bfs WHERE id = {ALONE}) WHERE d <> 0", _verify_path)


def _verify_found(g: Graph) -> DataFrame:
    tables = {0: g.comment, 1: g.post}
    found = q.message_lookup(g, POST)
    by = {0: g.comment_creator, 1: g.post_creator}
    wrote = q.creator_lookup(g, COMMENT)
    both = lambda flip: verify.found_flags(flip(found), tables, POST).withColumn("query", F.lit("is4")).union(verify.found_flags(flip(wrote), by, COMMENT, "message_id").withColumn("query", F.lit("is5")))
    return _both(both(lambda df: df), both(lambda df: df.withColumn("found", ~F.col("found"))))


add("verify_found", " SELECT unnest([0, 1, 0, 1]) AS type, unnest(['is4', 'is4', 'is5', 'is5']) AS query, true AS tampered", _verify_found)


def _verify_creator(g: Graph) -> DataFrame:
    result, picks = stage(q.creator(g, COMMENT)), stage(q.creator_lookup(g, COMMENT))
    return _both(verify.picked(result, picks), verify.picked(result.withColumn("id", F.col("id") + 1), picks))


add("verify_creator", f" SELECT unnest([person_id, person_id + 1]) AS id, true AS tampered FROM comment_creator WHERE message_id = {COMMENT}", _verify_creator)

_NAME_ORDER = [("distance", False), ("last_name", False), ("id", False)]


def _verify_topk_names(g: Graph) -> DataFrame:
    candidates = stage(q.named_candidates(g, PERSON, NAME).select("id", "distance", "last_name"))
    top = stage(rel.top_k(candidates, 20, [c for c, _ in _NAME_ORDER], "rank"))
    check = lambda t: verify.top_boundary(candidates, t, 20, ["id"], _NAME_ORDER)
    order = lambda t: verify.ordered(t, "rank", _NAME_ORDER, strict=True).select(F.col("rank").cast("long").alias("id"))
    both = lambda t: check(t).withColumn("check", F.lit("boundary")).union(order(t).withColumn("check", F.lit("order")))
    swapped = top.where("rank <> 3").withColumn("rank", F.when(F.col("rank") == 1, 2).when(F.col("rank") == 2, 1).otherwise(F.col("rank")))
    return _both(both(top), both(swapped))


_NAMED = _bfs(PERSON, 3, _BOTH) + f", cand AS (SELECT p.id, b.distance, row_number() OVER (ORDER BY b.distance, p.last_name, p.id) AS rank FROM bfs b JOIN person p ON p.id = b.id WHERE b.distance > 0 AND p.first_name = '{NAME}')"
add("verify_topk_names", _NAMED + " SELECT id, 'boundary' AS \"check\", true AS tampered FROM cand WHERE rank = 3 OR rank > 20 UNION ALL SELECT 1, 'order', true FROM cand WHERE rank = 2", _verify_topk_names)


def _verify_topk_two_hops(g: Graph) -> DataFrame:
    candidates = stage(q.message_candidates(g, q.two_hops(g, PERSON), until(), True).select("id", "type", "creation_date"))
    top = stage(rel.top_k(candidates, 20, [F.desc("creation_date"), "id", "type"], "rank"))
    check = lambda t: verify.top_boundary(candidates, t, 20, ["id", "type"], _ORDER)
    return _both(check(top), check(top.where("rank <> 5")))


add("verify_topk_two_hops", _bfs(PERSON, 2, _BOTH) + f"{_MESSAGES}, cand AS (SELECT m.id, m.type, row_number() OVER (ORDER BY m.creation_date DESC, m.id, m.type) AS rank FROM message m JOIN creator c ON c.message_id = m.id AND c.type = m.type JOIN bfs ON bfs.id = c.person_id WHERE distance > 0 AND m.creation_date < TIMESTAMP '{UNTIL}') SELECT id, type, true AS tampered FROM cand WHERE rank = 5 OR rank > 20", _verify_topk_two_hops)


def _verify_level_rows(g: Graph) -> DataFrame:
    levels = stage(q.hop_levels(g, OTHER, 4))
    persons = stage(q.distances(g, OTHER, 4, undirected=False))
    seen = stage(g.spark.range(5).select(F.col("id").cast("int").alias("hop")).join(persons.where("distance is not null").select("id", "distance"), F.col("distance") <= F.col("hop")).select("hop", "id"))
    both = lambda p, s: verify.level_rows(levels, p).withColumn("check", F.lit("level")).union(verify.visited(levels, s, OTHER).withColumn("check", F.lit("visited")))
    return _both(both(persons, seen), both(persons.withColumn("distance", F.when(F.col("distance") == 4, 3).otherwise(F.col("distance"))), seen.where("hop <> 2 or id % 2 = 0")))


add(
    "verify_level_rows",
    _bfs(OTHER, 4, _ONE_WAY) + " SELECT unnest([3, 4]) AS hop, id, 'level' AS \"check\", true AS tampered FROM bfs WHERE distance = 4 UNION ALL SELECT 2, id, 'visited', true FROM bfs WHERE distance <= 2 AND id % 2 <> 0",
    _verify_level_rows,
)


def _verify_sorted_list(g: Graph) -> DataFrame:
    listed = stage(walk.positions(walk.directed(g.knows)))
    swapped = listed.withColumn("position", F.when(F.col("position") == 1, 2).when(F.col("position") == 2, 1).otherwise(F.col("position")))
    doubled = swapped.union(swapped.where("position = 0").select("src", "dst", F.lit(-1).alias("position")))
    return _both(walk.check_sorted(listed, "position"), walk.check_sorted(doubled, "position"))


add("verify_sorted_list", f", ed AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS position FROM ({_ONE_WAY}) e) SELECT src, dst, true AS tampered FROM ed WHERE position IN (0, 1)", _verify_sorted_list)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
