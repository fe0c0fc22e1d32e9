"""The graph's tables as SQL over the star schema.  The text is portable: only type names differ between engines."""

from __future__ import annotations

BASE_TABLES = ("customer", "orders", "lineitem", "events", "nation", "supplier")
DIALECTS = {"spark": {"text": "STRING", "stamp": "TIMESTAMP_NTZ"}, "duckdb": {"text": "VARCHAR", "stamp": "TIMESTAMP"}}

_JOBS = "SELECT o_custkey AS person_id, l_suppkey AS org_id, CAST(year(min(o_orderdate)) AS BIGINT) AS {} FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_suppkey % 2 = {} GROUP BY o_custkey, l_suppkey"

VIEWS = {
    "person": """SELECT c_custkey AS id, c_mktsegment AS first_name, c_name AS last_name,
        CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
        DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS birthday,
        CAST(DATE '2010-01-01' + CAST(c_custkey * 11 % 1000 AS INTEGER) AS <stamp>) AS creation_date,
        CAST(c_custkey % 223 + 1 AS <text>) || '.' || CAST(c_custkey % 256 AS <text>) || '.' || CAST(c_custkey * 7 % 256 AS <text>) || '.' || CAST(c_custkey * 13 % 256 AS <text>) AS location_ip,
        CASE c_custkey % 3 WHEN 0 THEN 'Firefox' WHEN 1 THEN 'Chrome' ELSE 'Safari' END AS browser_used FROM {customer}""",
    "knows": """SELECT least(a, b) AS p1, greatest(a, b) AS p2, min(dt) AS creation_date FROM (
        SELECT o_custkey AS a, (o_orderkey * 7919 + 13) % (SELECT count(*) FROM {customer}) AS b, o_orderdate AS dt
        FROM {orders} WHERE o_orderkey % 6 = 0) e WHERE a <> b GROUP BY least(a, b), greatest(a, b)""",
    "located": "SELECT c_custkey AS person_id, CAST(c_nationkey AS BIGINT) AS place_id FROM {customer}",
    "place": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM {nation}",
    "speaks": "SELECT DISTINCT user_id AS person_id, event_type AS language FROM {events}",
    "email": """SELECT c_custkey AS person_id, c_name || '@example.com' AS email FROM {customer}
        UNION ALL SELECT c_custkey, c_name || '@example.org' FROM {customer} WHERE c_custkey % 3 = 0""",
    "study_at": _JOBS.format("class_year", 1),
    "work_at": _JOBS.format("work_from", 0),
    "organisation": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'company' ELSE 'university' END AS type, s_name AS name FROM {supplier}",
    "org_located": "SELECT s_suppkey AS org_id, CAST(s_nationkey AS BIGINT) AS place_id FROM {supplier}",
    "comment": "SELECT 1000000000 + event_id AS id, ts AS creation_date, props AS content, '' AS image_file FROM {events}",
    "post": """SELECT o_orderkey AS id, 'img' || CAST(o_orderkey AS <text>) AS image_file, o_orderdate AS creation_date,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS content FROM {orders}""",
    "comment_creator": "SELECT 1000000000 + event_id AS message_id, user_id AS person_id FROM {events}",
    "post_creator": "SELECT o_orderkey AS message_id, o_custkey AS person_id FROM {orders}",
}


def view_sql(name: str, dialect: str) -> str:
    text = VIEWS[name]
    for mark, kind in DIALECTS[dialect].items():
        text = text.replace(f"<{mark}>", kind)
    return text


def with_views(body: str) -> str:
    """DuckDB SQL: ``body`` with the views it names in front of it."""
    parts = []
    for name in VIEWS:
        sql = view_sql(name, "duckdb")
        for table in BASE_TABLES:
            sql = sql.replace(f"{{{table}}}", table)
        parts.append(f"{name} AS ({sql})")
    return "WITH RECURSIVE " + ",\n".join(parts) + body
