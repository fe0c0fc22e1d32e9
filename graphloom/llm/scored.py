"""What the two text classifiers share: the bounded training sample, and scoring a table batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, sliced, small, stage, text_view

#: Bound on the labelled texts a classifier is fitted on; above it, a hash of the id picks about that many.
MAX_TRAIN = 20_000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int = MAX_TRAIN) -> DataFrame:
    """Staged (text, label 0/1, part 0..3) of at most about ``most`` labelled texts outside the held-out fold.

    Several labels of one id are averaged (a half counts as 1); null ids and labels are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), mod) != held))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("text"))
    joined = texts.join(small(known.select(F.col("doc_id").alias("__id"), "label"), 2 * most), "__id")
    return stage(joined.select("text", "label", F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(4)).cast("int").alias("part")))


def featured(sample: DataFrame, features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix, labels and parts of a staged training sample (bounded by its size, so it fits the driver)."""

    def run(batches):
        for batch in sliced(batches):
            x = features(*text_view(batch.column("text")))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, np.float32))])
            yield pa.RecordBatch.from_arrays([flat.cast(pa.binary()), batch.column("label"), batch.column("part")], ["x", "label", "part"])

    rows = sample.mapInArrow(run, "x binary, label int, part int").toArrow().sort_by([("part", "ascending"), ("label", "ascending"), ("x", "ascending")])
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, width)
    return x, rows["label"].to_numpy().astype(float), rows["part"].to_numpy()


def score_rows(docs: DataFrame, score, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row and its score."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    source = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches):
        for batch in sliced(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score(*text_view(batch.column("__text"))), pa.float64())], [*keep, "score"])

    return source.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, score, keep) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score satisfies ``keep`` (a vectorised test)."""

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array(keep(score(*text_view(batch.column("text")))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
