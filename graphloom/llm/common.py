"""Plumbing the text operators share: the shared folder, staged tables, checked broadcasts, and numpy views of Arrow text.

Staged tables are written under ``spark.checkpoint.dir`` (the folder the cluster shares), so a lost executor costs a
re-read and never a lost result.  Only a session whose master is ``local[...]`` may run without that setting.
"""

from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage as write_staged
from ..staging import staged_path  # noqa: F401

SLICE_BYTES = 1 << 20
#: Spark's setting that deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_writing, _lock = {"writers": 0, "before": None}, threading.Lock()


def stage(df: DataFrame) -> DataFrame:
    """A staged table; the shuffle files that writing it took are deleted with it.  The setting for that is put back when the
    last of the threads that write is done."""
    spark = df.sparkSession
    with _lock:
        if not _writing["writers"]:
            _writing["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writing["writers"] += 1
    try:
        return write_staged(df)
    finally:
        with _lock:
            _writing["writers"] -= 1
            if not _writing["writers"]:
                before = _writing["before"]
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def small(df: DataFrame, bound: int, weight: Column | None = None) -> DataFrame:
    """Broadcast ``df`` only when it has at most ``bound`` rows, and ``weight``, where rows differ in size, sums to no more;
    beyond that it stays an ordinary (shuffled) join side."""
    rows, total = df.limit(bound + 1).agg(F.count("*"), F.coalesce(F.sum(weight if weight is not None else F.lit(0)), F.lit(0))).first()
    return F.broadcast(df) if rows <= bound and total <= bound else df


def ascii_lower(col):
    """A-Z lower-cased and nothing else; texts of ASCII alone, where that is what ``lower`` does, take its faster way."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def ascii_lower_sql(col: str) -> str:
    return f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def fold(id_col, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (rows + 1, from 0) of a string column, null as empty; no copy where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches, text: str = "text", most: int = SLICE_BYTES):
    """Cut record batches so that a slice holds about ``most`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_view(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross texts: starts, ends, and the text each belongs to."""
    if not mask.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(mask.size, bool)
    first[0], first[1:] = True, ~mask[:-1]
    inner = offsets[(offsets > 0) & (offsets < mask.size)]
    first[inner] = True
    last = np.empty(mask.size, bool)
    last[-1], last[:-1] = True, ~mask[1:]
    last[inner - 1] = True
    starts = np.flatnonzero(first & mask)
    ends = np.flatnonzero(last & mask) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... length[0] of them, then those of the next."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


#: Odd multipliers of the 64-bit hashes below.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SALTS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C06FAF4D023E3AB)]
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans ascending, not empty)."""
    global _powers
    if not starts.size:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    most = int(lengths.max())
    with np.errstate(over="ignore"):
        if _powers.size < most:
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(most, 4096), BASE, np.uint64)]))
        begins = np.cumsum(lengths) - lengths
        inner = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(begins, lengths)
        bytes_ = raw[np.repeat(starts, lengths) + inner].astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(bytes_ * _powers[inner], begins) + lengths.astype(np.uint64) * SALTS[0])


def byte_table(words: str) -> np.ndarray:
    """Look-up table over bytes; ``words`` is 'space' (all but white space) or 'alnum' (digits, letters, all non-ASCII)."""
    table = np.ones(256, bool)
    if words == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x30] = table[0x3A:0x41] = table[0x5B:0x61] = table[0x7B:0x80] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


