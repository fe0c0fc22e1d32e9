"""A property graph as named DataFrames, read from delimited files, from Parquet, or derived from the star schema."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import free, owned
from .schemas import FILES
from .star import BASE_TABLES, view_sql


@dataclass(eq=False)
class Graph:
    """Tables by name (see ``schemas.FILES``); a table is only planned when it is asked for.

    ``kept`` tables, the indexes that queries look things up in, are staged once for each graph; ``close`` frees them."""

    spark: SparkSession
    make: dict = field(repr=False)
    _made: dict = field(default_factory=dict, repr=False)
    _kept: dict = field(default_factory=dict, repr=False)
    _owned: list = field(default_factory=list, repr=False)

    def __post_init__(self):
        weakref.finalize(self, free, self._owned)

    def kept(self, name: str, build: Callable[[], Any]) -> Any:
        """What ``build`` stages and returns, a table or an index of tables, made at the first call with this name."""
        if name not in self._kept:
            with owned() as mine:
                self._kept[name] = build()
            self._owned += mine
        return self._kept[name]

    def close(self) -> None:
        self._kept.clear()
        free(self._owned)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.make:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.make[name]()
        return self._made[name]


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = "|") -> DataFrame:
    """A header-first delimited file without quoting: columns by position, further ones ignored; rows with too few columns
    or values that do not parse are dropped, and so are rows whose first column is blank."""
    wanted = T.StructType.fromDDL(schema)
    lines = spark.read.option("header", False).text(path)
    cells = F.split("value", "[" + separator + "]", -1)
    rows = lines.withColumn("cells", cells)
    casts = [F.try_element_at("cells", F.lit(i + 1)) for i in range(len(wanted))]
    typed = [c.alias(f.name) if isinstance(f.dataType, T.StringType) else F.expr(f"try_cast(trim(get(cells, {i})) as {f.dataType.simpleString()})").alias(f.name) for i, (c, f) in enumerate(zip(casts, wanted, strict=True))]
    found = rows.where(F.size("cells") >= len(wanted)).select(*typed)
    # the header's id does not parse as a number, so it goes with the malformed rows
    whole = [F.col(f.name).isNotNull() for f in wanted if not isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]
    for test in whole:
        found = found.where(test)
    return found.select(*[f.name for f in wanted if not f.name.startswith("_")])


def load_delimited(spark: SparkSession, folder: str, separator: str = "|") -> Graph:
    """The graph from its delimited files; comments have no image file."""

    def table(name: str):
        file, schema = FILES[name]
        found = read_delimited(spark, f"{folder}/{file}", schema, separator)
        return found.withColumn("image_file", F.lit("")) if name == "comment" else found

    return Graph(spark, {name: lambda name=name: table(name) for name in FILES})


def write_delimited(graph: Graph, folder: str, separator: str = "|") -> None:
    """The tables as delimited files that ``load_delimited`` reads, a folder of them for each; without header lines, as many
    tasks write them.  Nulls become empty, and values must not hold the separator or a line end."""
    for name, (file, schema) in FILES.items():
        table = getattr(graph, name)
        cells = [F.lit("") if c.startswith("_") else F.coalesce(table[c].cast("string"), F.lit("")) for c in T.StructType.fromDDL(schema).names]
        table.select(F.concat_ws(separator, *cells).alias("value")).write.mode("overwrite").text(f"{folder}/{file}")


def load_parquet(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark, {name: lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet") for name in FILES})


def write_parquet(graph: Graph, folder: str) -> None:
    for name in FILES:
        getattr(graph, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def from_star(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph that ``star`` derives from customers, orders, line items, events, nations and suppliers."""

    def table(name: str) -> DataFrame:
        sql = view_sql(name, "spark")
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES if f"{{{t}}}" in sql}
        return spark.sql(sql, **used)

    return Graph(spark, {name: lambda name=name: table(name) for name in FILES})
