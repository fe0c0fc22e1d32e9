"""Dense codes (0, 1, ...) for ids: a dictionary kept bucketed by id and by code, and columns encoded and decoded by it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage_bucketed
from .relational import dense_index


@dataclass
class Dictionary:
    """(key, code) twice: bucketed by key, which encoding joins with, and by code, which decoding does.  A join shuffles the
    table that is encoded and not the dictionary."""

    by_key: DataFrame
    by_code: DataFrame

    def encode(self, df: DataFrame, column: str, name: str | None = None) -> DataFrame:
        """``df`` with the code of ``column`` under ``name`` (in its place, if there is none); rows whose value has no code go."""
        found = df.join(self.by_key.select(F.col("key").alias("__key"), F.col("code").alias("__code")), F.col(column) == F.col("__key")).drop("__key")
        return found.withColumn(name or column, F.col("__code")).drop("__code")

    def decode(self, df: DataFrame, column: str, name: str | None = None) -> DataFrame:
        found = df.join(self.by_code.select(F.col("code").alias("__code"), F.col("key").alias("__key")), F.col(column) == F.col("__code")).drop("__code")
        return found.withColumn(name or column, F.col("__key")).drop("__key")


def by_code(by_key: DataFrame) -> DataFrame:
    return stage_bucketed(by_key.select("key", "code"), "code")


def dictionary(df: DataFrame, column: str) -> Dictionary:
    """The dictionary of the distinct values of a column, nulls left out, coded in their order.  The order is found in ranges
    of the values, so no task sees all of them."""
    values = df.select(F.col(column).alias("key")).where("key is not null").distinct()
    by_key = stage_bucketed(dense_index(values, "key", "code").select("key", F.col("code").cast("long").alias("code")), "key")
    return Dictionary(by_key, by_code(by_key))


def encode_edges(edges: DataFrame, codes: Dictionary, other: Dictionary | None = None) -> DataFrame:
    """(src, dst, ...) in codes, edges with an unknown end left out: a shuffle of the edges for each of the two columns."""
    return (other or codes).encode(codes.encode(edges, "src"), "dst")


def decode_edges(edges: DataFrame, codes: Dictionary, other: Dictionary | None = None) -> DataFrame:
    return (other or codes).decode(codes.decode(edges, "src"), "dst")
