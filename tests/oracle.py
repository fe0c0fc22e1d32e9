"""Compare a query with its SQL in DuckDB, row by row."""

import os
from collections import Counter

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value if isinstance(value, (int, str, bool, type(None))) else str(value)


def rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())


def sql_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
