"""The graph queries: functions from a ``Graph`` and parameters to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import csr, dense
from ..operators import relational as rel
from ..operators import traverse as walk
from ..sources.graph import Graph
from ..staging import stage, stage_bucketed


def profile(g: Graph, person: int) -> DataFrame:
    """IS1: a person's attributes and city."""
    city = g.located.where(F.col("person_id") == person).select(F.col("person_id").alias("id"), F.col("place_id").alias("city_id"))
    found = g.person.where(F.col("id") == person)
    return found.join(city, "id").select("first_name", "last_name", "birthday", "location_ip", "browser_used", "city_id", "gender", "creation_date")


def profile_by_adjacency(g: Graph, person: int) -> DataFrame:
    """IS1 through an adjacency index of the location edges."""
    index = g.kept("places", lambda: stage_bucketed(walk.positions(g.located.select(F.col("person_id").alias("src"), F.col("place_id").alias("dst"))), "src"))
    city = walk.neighbours(index, person).select(F.col("src").alias("id"), F.col("dst").alias("city_id"), "position")
    found = g.person.where(F.col("id") == person)
    return found.join(city, "id").select("first_name", "last_name", "birthday", "location_ip", "browser_used", "city_id", "position", "gender", "creation_date")


def _named(g: Graph, ids: DataFrame) -> DataFrame:
    return ids.join(g.person.select(F.col("id").alias("friend_id"), "first_name", "last_name"), "friend_id").select("friend_id", "first_name", "last_name", "creation_date")


def friends(g: Graph, person: int) -> DataFrame:
    """IS3: friends in either direction, newest friendship first, then smallest id."""
    return friends_unordered(g, person).orderBy(F.desc("creation_date"), "friend_id")


def friends_unordered(g: Graph, person: int) -> DataFrame:
    edges = g.knows.where((F.col("p1") == person) | (F.col("p2") == person)).where("p1 <> p2")
    return _named(g, edges.select(rel.other_endpoint(F.lit(person), F.col("p1"), F.col("p2")).alias("friend_id"), "creation_date"))


def friends_directed(g: Graph, person: int) -> DataFrame:
    """Only along the stored direction, oldest first."""
    edges = g.knows.where((F.col("p1") == person) & (F.col("p2") != person))
    return _named(g, edges.select(F.col("p2").alias("friend_id"), "creation_date")).orderBy("creation_date", "friend_id")


def friends_symmetrised(g: Graph, person: int) -> DataFrame:
    """Over the edge list doubled beforehand."""
    edges = walk.symmetric(g.knows, extra=("creation_date",))
    return _named(g, edges.where((F.col("src") == person) & (F.col("dst") != person)).select(F.col("dst").alias("friend_id"), "creation_date"))


def messages(g: Graph) -> DataFrame:
    """Comments (type 0) and posts (type 1)."""
    columns = ["id", "creation_date", "content", "image_file"]
    return rel.tagged_union({0: g.comment.select(*columns), 1: g.post.select(*columns)})


def creators(g: Graph) -> DataFrame:
    return rel.tagged_union({0: g.comment_creator.select("message_id", "person_id"), 1: g.post_creator.select("message_id", "person_id")})


def shown_content():
    return F.coalesce(F.nullif("content", F.lit("")), F.col("image_file"))


def message(g: Graph, message_id: int) -> DataFrame:
    """IS4: date and content (or image file) of a message, and the table (type) it is in."""
    return messages(g).where(F.col("id") == message_id).select("creation_date", shown_content().alias("content"), "type")


def _looked_up(g: Graph, found: DataFrame) -> DataFrame:
    """A row for each of the two tables, found there or not; ``found`` (type, ...) has at most a few rows."""
    both = g.spark.range(2).select(F.col("id").cast("int").alias("type"))
    return both.join(F.broadcast(found.withColumn("found", F.lit(True))), "type", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def message_lookup(g: Graph, message_id: int) -> DataFrame:
    """IS4 by table: type, found, creation_date, content; nulls where a table does not have the message."""
    return _looked_up(g, message(g, message_id)).select("type", "found", "creation_date", "content")


def creator_lookup(g: Graph, message_id: int) -> DataFrame:
    """IS5 by table: type, found, person_id; a null person where a table does not have the message."""
    return _looked_up(g, creators(g).where(F.col("message_id") == message_id).select("type", "person_id")).select("type", "found", "person_id")


def creator(g: Graph, message_id: int) -> DataFrame:
    """IS5: who wrote a message."""
    by = creators(g).where(F.col("message_id") == message_id).select(F.col("person_id").alias("id"))
    return by.join(g.person, "id").select("id", "first_name", "last_name")


def edges_of(g: Graph, undirected: bool) -> DataFrame:
    """The edge index of the graph, among known persons; built once."""
    return g.kept("both ways" if undirected else "one way", lambda: walk.edge_index(walk.inside(walk.symmetric(g.knows) if undirected else walk.directed(g.knows), g.person)))


def doubled_edges(g: Graph) -> DataFrame:
    """The index of a list of friendships that was doubled beforehand and is then read as directed."""

    def build() -> DataFrame:
        doubled = stage(walk.symmetric(g.knows).select(F.col("src").alias("p1"), F.col("dst").alias("p2")))
        return walk.edge_index(walk.inside(walk.directed(doubled), g.person))

    return g.kept("doubled", build)


def one(g: Graph, person: int) -> DataFrame:
    """The person as a one-row table, empty if there is none."""
    return g.person.where(F.col("id") == person).select("id")


def distances(g: Graph, person: int, hops: int | None, undirected: bool = True, local: int = walk.LOCAL) -> DataFrame:
    """Every person with distance and predecessor, both null where the search did not get.  ``local`` is the number of nodes
    that a search may hold on the driver, here and below."""
    return everyone(g, walk.bfs(edges_of(g, undirected), one(g, person), hops, local=local))


def distances_symmetrised(g: Graph, person: int, hops: int | None) -> DataFrame:
    """The same by a directed search over the doubled list."""
    return everyone(g, walk.bfs(doubled_edges(g), one(g, person), hops))


def everyone(g: Graph, found: DataFrame) -> DataFrame:
    return g.person.select("id").join(found, "id", "left").select("id", "distance", "predecessor")


def hop_levels(g: Graph, person: int, hops: int, local: int = walk.LOCAL) -> DataFrame:
    return walk.hop_levels(edges_of(g, False), one(g, person), hops, local)


def path_length(g: Graph, a: int, b: int, local: int = walk.LOCAL) -> DataFrame:
    """IC13: least number of friendships between two persons, -1 if there is no path."""
    return walk.shortest_path_length(edges_of(g, True), g.person, a, b, undirected=True, local=local)


def person_codes(g: Graph) -> dense.Dictionary:
    """The dictionary of person ids, built once for a graph."""
    return g.kept("person codes", lambda: dense.dictionary(g.person, "id"))


def friend_csr(g: Graph) -> csr.Csr:
    """Friendships in both directions between known persons, in dense codes, as offsets and slots; built once for a graph."""

    def build() -> csr.Csr:
        coded = dense.encode_edges(edges_of(g, True), person_codes(g))
        return csr.from_sorted(rel.dense_index(coded, ["src", "dst"], "place"), "place", g.person.count())

    return g.kept("friend slots", build)


def friends_by_slots(g: Graph, person: int) -> DataFrame:
    """(k, friend_id): a person's friends in the order of ids, counted from 0, by the offsets of the person's code."""
    codes = person_codes(g)
    code = codes.by_key.where(F.col("key") == person).select("code").first()
    found = friend_csr(g).neighbours(-1 if code is None else code["code"])
    begin = found.agg(F.min("position")).first()[0] or 0
    return codes.decode(found, "dst").select((F.col("position") - begin).alias("k"), F.col("dst").alias("friend_id"))


def kth_friend(g: Graph, person: int, k: int) -> DataFrame:
    """(friend_id, degree): a person's k-th friend, counted from 0, and the number of friends."""
    code = person_codes(g).by_key.where(F.col("key") == person).select("code").first()
    node, index = -1 if code is None else code["code"], friend_csr(g)
    return person_codes(g).decode(index.kth(node, k), "dst").select(F.col("dst").alias("friend_id"), F.lit(index.degree(node)).cast("long").alias("degree"))


def named_candidates(g: Graph, person: int, first_name: str, undirected: bool = True, hops: int = 3) -> DataFrame:
    """People of a first name within some hops, with their distance."""
    near = walk.bfs(edges_of(g, undirected), one(g, person), hops).where("distance > 0").select("id", "distance")
    return near.join(g.person.where(F.col("first_name") == first_name), "id")


def friends_by_name(g: Graph, person: int, first_name: str, undirected: bool = True, hops: int = 3, limit: int = 20) -> DataFrame:
    """IC1: people of a first name within some hops, by distance, last name, id; with city, emails, languages, and the
    universities and companies as sorted text lists."""
    named = named_candidates(g, person, first_name, undirected, hops)
    first = rel.held(rel.top_k(named, limit, ["distance", "last_name", "id"], "rank"))  # at most ``limit`` rows from here on
    ids = F.broadcast(first.select(F.col("id").alias("person_id")))

    def listed(table: DataFrame, value, name: str) -> DataFrame:
        return table.join(ids, "person_id", "left_semi").groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set(value)), ";").alias(name)).withColumnRenamed("person_id", "id")

    place = g.place.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"))
    org = g.organisation.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")).join(g.org_located, "org_id", "left").join(place, "place_id", "left")

    def jobs(table: DataFrame, year: str, name: str) -> DataFrame:
        known = table.join(ids, "person_id", "left_semi").join(org, "org_id")
        return listed(known, F.concat_ws(":", "org_name", F.col(year).cast("string"), "place_name"), name)

    city = g.located.join(ids, "person_id", "left_semi").join(place, "place_id", "left").select(F.col("person_id").alias("id"), F.col("place_name").alias("city"))
    out = first.join(city, "id", "left")
    for extra in (listed(g.email, F.col("email"), "emails"), listed(g.speaks, F.col("language"), "languages"), jobs(g.study_at, "class_year", "universities"), jobs(g.work_at, "work_from", "companies")):
        out = out.join(extra, "id", "left")
    return out.select("rank", "id", "last_name", "distance", "birthday", "creation_date", "gender", "browser_used", "location_ip", "city", *[F.coalesce(c, F.lit("")).alias(c) for c in ("emails", "languages", "universities", "companies")])


def message_candidates(g: Graph, people: DataFrame, before, strict: bool) -> DataFrame:
    """Messages of ``people`` (person_id) up to a time (before it, if ``strict``)."""
    date = F.col("creation_date")
    recent = messages(g).where(date < before if strict else date <= before)
    theirs = creators(g).join(people, "person_id", "left_semi").select(F.col("message_id").alias("id"), "person_id", "type")
    return recent.join(theirs, ["id", "type"])


def _recent(g: Graph, people: DataFrame, before, strict: bool, limit: int) -> DataFrame:
    first = rel.top_k(message_candidates(g, people, before, strict), limit, [F.desc("creation_date"), "id", "type"], "rank")
    who = g.person.select(F.col("id").alias("person_id"), "first_name", "last_name")
    return first.join(who, "person_id").select("rank", "person_id", "first_name", "last_name", F.col("id").alias("message_id"), "creation_date", shown_content().alias("content"), "type")


def direct_friends(g: Graph, person: int) -> DataFrame:
    return friends_unordered(g, person).select(F.col("friend_id").alias("person_id")).distinct()


def recent_messages(g: Graph, person: int, latest, limit: int = 20) -> DataFrame:
    """IC2: newest messages of direct friends, up to and including a time."""
    return _recent(g, direct_friends(g, person), latest, False, limit)


def recent_messages_two_hops(g: Graph, person: int, before, limit: int = 20) -> DataFrame:
    """IC9: newest messages of friends and their friends, before a time; the person's own do not count."""
    return _recent(g, two_hops(g, person), before, True, limit)


def two_hops(g: Graph, person: int) -> DataFrame:
    return walk.bfs(edges_of(g, True), one(g, person), 2).where("distance > 0").select(F.col("id").alias("person_id"))


def set_expand(g: Graph, ids: DataFrame) -> DataFrame:
    """Every message with whether its creator is in ``ids`` (id)."""
    return rel.member_flag(creators(g), "person_id", ids, "id")


def multi_match(g: Graph, ids: list[int]) -> DataFrame:
    """Every message with a flag for each of ten creators."""
    return rel.match_matrix(creators(g), "person_id", ids)
