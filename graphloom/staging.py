"""Tables staged in the folder the cluster shares (``spark.checkpoint.dir``): they cut lineage and outlive lost executors.

``with scope():`` frees what was staged inside it; ``release()`` frees all.  A result must be written or collected before the
tables it reads are freed."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bucketed tables need a catalog entry; theirs are in a database of their own.
DATABASE = "graphloom_staged"
#: Rows to a bucket of a table that is bucketed by its size.
BUCKET_ROWS = 250_000
log = logging.getLogger(__name__)
_staged: list[tuple[SparkSession, str, str | None]] = []
_sized: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset on a ``local[...]`` master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged_path(spark: SparkSession, table: str | None = None) -> str:
    """A new folder name in the shared folder, which ``release`` will delete."""
    path = f"{shared_dir(spark)}/graphloom-staged/{uuid.uuid4().hex}"
    _staged.append((spark, path, table))
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = staged_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Like ``stage``, bucketed and sorted by ``key``: later joins on it do not shuffle this side again, and filters on it
    read only their buckets."""
    spark = df.sparkSession
    name = f"{DATABASE}.t{uuid.uuid4().hex}"
    path = staged_path(spark, name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def stage_sized(df: DataFrame, key: str) -> DataFrame:
    """``stage_bucketed`` in as many buckets as the rows ask for, and one for each core at least: what reads the table many times
    pays for its rows and not for tasks.  ``buckets`` tells how many."""
    spark = df.sparkSession
    with owned() as first:
        kept = stage(df)
    buckets = max(spark.sparkContext.defaultParallelism, -(-kept.count() // BUCKET_ROWS))
    table = stage_bucketed(kept, key, buckets)
    free(first)
    _sized[table] = buckets
    return table


def buckets(df: DataFrame) -> int:
    """The number of buckets of a table of ``stage_sized``, else that of ``stage_bucketed``."""
    return _sized.get(df) or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Grown:
    """A staged table that grows by appended rows, bucketed by ``key`` and divided into folders by ``part``: a join on the key
    does not shuffle it, and a filter on the part reads only its folders."""

    def __init__(self, spark: SparkSession, key: str, part: str, buckets: int | None = None):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
        self.spark, self.key, self.part, self.name = spark, key, part, f"{DATABASE}.t{uuid.uuid4().hex}"
        self.path, self.buckets = staged_path(spark, self.name), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").partitionBy(self.part).bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)


def free(entries: list) -> None:
    """Delete the staged tables in ``entries``, the newest first; one that cannot be deleted is logged and left behind."""
    while entries:
        spark, path, name = entries.pop()
        if spark.sparkContext._jsc is None:  # the session is gone; its folder belongs to whoever set it
            continue
        try:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception as error:
            log.warning("staged table %s was not deleted: %s", path, error)


def adopt(entries: list) -> None:
    """Undo ``owned``: the tables in ``entries`` are freed by what is around the caller again."""
    _staged.extend(entries)
    entries.clear()


@contextmanager
def owned():
    """Everything staged inside becomes the caller's, in the list this yields, and is freed by neither ``scope`` nor ``release``
    around it; ``free`` frees it."""
    before, mine = len(_staged), []
    try:
        yield mine
    finally:
        mine += _staged[before:]
        del _staged[before:]


@contextmanager
def scope():
    """Frees what is staged inside when left."""
    with owned() as mine:
        yield
    free(mine)


def release() -> None:
    """Delete every staged table that nobody owns."""
    free(_staged)


atexit.register(release)
