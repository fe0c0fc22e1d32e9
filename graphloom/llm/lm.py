"""Language-model scores of whole texts: unigram counts of the whole corpus, and a gated recurrent network (see ``gru``).

Counts of all training tokens are aggregated by Spark.  The network knows an end token, the ``WORDS`` most frequent words,
and one token for all rarer ones, whose share among the rare follows from their counts, so its probabilities too are over all
words (words never seen in training count as one more rare word).  It is begun on the driver with a bounded sample and then
trained on every training text: each task goes on from the same network over its own texts, and the networks are averaged by
tokens, in two levels, so that one of them reaches the driver.

Scoring reads a text once, with the state carried from window to window through the whole text.  Counts of the ``HEAD`` most
frequent words travel with the task (bounded in number and length); those of other words are joined, and no text is shuffled.

Defined results: null and empty texts are one end token; without training texts nothing is known, all counts are 0, and the
network stays as it begins; repeated rows each get the same scores; a null id counts as an empty text for the fold; very long
words are joined like rare ones; an empty table gives no rows.  Further columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import sliced, spans, stage, text_view

#: Words of the network, its classes, and words whose counts travel with tasks (of at most ``LONG_WORD`` bytes).
WORDS, CLASSES, HEAD, LONG_WORD = 1022, 32, 65_536, 64
#: Texts, of at most so many bytes, that the network is begun with; passes over them, and the two rates of training.
BEGUN_WITH, BEGUN_BYTES, PASSES, RATES = 1_000, 16_384, 4, (0.01, 0.002)
#: Tasks, at most, that add up the networks of all others.
GATHER = 64
#: Bytes of text of a slice of training, and of counting and scoring.
TRAIN_BYTES, SCORE_BYTES = 4 << 20, 4 << 20
#: Steps of a power of two into which counts are sorted when the most frequent words are looked for.
GRAIN = 16
END, RARE = 0, 1


def tokens(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, lower-cased in A-Z, and how many each text has."""
    raw, offsets = text_view(column)
    is_word = (raw != 0x20) & ((raw - np.uint8(9)) > 4)  # all but a blank and the five bytes from 9 on
    starts, ends, text = spans(is_word, offsets)
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = raw[is_word]
    letters += ((letters - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(letters))
    return words.dictionary_encode(), np.bincount(text, minlength=len(column)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(term, n): how often each word occurs; the empty term counts the texts' ends."""

    def run(batches):
        for batch in sliced(batches, "text", SCORE_BYTES):
            words, _ = tokens(batch.column("text"))
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([""])]), pa.array(np.append(n, len(batch)).astype(np.int64))], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """A trained model: ``counts`` is the staged (term, n) of all training words."""

    counts: DataFrame
    total: int
    kinds: int
    head: pa.Array
    head_counts: np.ndarray
    rare_total: int
    bounds: np.ndarray
    net: dict[str, np.ndarray]


def _ids(words: pa.DictionaryArray, head: pa.Array) -> np.ndarray:
    """Places of the words in the head, -1 for others."""
    known = pc.index_in(words.dictionary.cast(pa.string()), value_set=head)
    return known.fill_null(-1).to_numpy().astype(np.int32)[words.indices.to_numpy()]


def _network_ids(places: np.ndarray, words: int) -> np.ndarray:
    return np.where((places >= 0) & (places < words), places + 2, RARE).astype(np.int32)


def _head(counts: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """At most ``HEAD`` most frequent words, by falling count, and their counts; of equally frequent ones all or none."""
    level = F.floor(F.log2("n") * GRAIN)
    short = counts.where((F.col("term") != "") & (F.octet_length("term") <= LONG_WORD))
    upto, least = 0, None
    for row in short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 64 * GRAIN rows
        upto += row["count"]
        if upto > HEAD:
            break
        least = row["level"]
    if least is None:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    found = short.where(level >= least).toArrow().sort_by([("n", "descending"), ("term", "ascending")])
    return found["term"].combine_chunks().cast(pa.string()), found["n"].to_numpy().astype(np.int64)


def train(docs: DataFrame, learn: Column) -> Model:
    """A model of the rows of ``docs`` (text) for which ``learn`` holds."""
    texts = docs.where(learn).select("text")
    counts = stage(word_counts(texts))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head, head_counts = _head(counts)
    words = min(WORDS, len(head))
    rare = total - ends - int(head_counts[:words].sum())
    weights = np.concatenate([[ends, rare], head_counts[:words]]).astype(float)
    bounds = gru.class_bounds(weights, 2, CLASSES)
    model = Model(counts, total, kinds, head, head_counts, rare + kinds - words - (1 if ends else 0) + 1, bounds, gru.fresh(weights, bounds))
    if total:
        model.net = _begun(texts, model, words)
        model.net = _averaged(texts, model, words)
    return model


def _begun(texts: DataFrame, model: Model, words: int) -> dict[str, np.ndarray]:
    """The network after some passes over a bounded sample of texts, chosen by a hash."""
    head, n = model.head.slice(0, words), int(model.counts.where("term = ''").first()["n"])

    def run(batches):
        for batch in sliced(batches):
            found, lengths = tokens(batch.column("text"))
            ids = _network_ids(_ids(found, head), words)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["ids"])

    short = texts.where(F.octet_length("text") <= BEGUN_BYTES).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1, BEGUN_WITH / n)))
    table = short.limit(2 * BEGUN_WITH).mapInArrow(run, "ids array<int>").toArrow()
    ids = sorted(table["ids"].to_pylist())
    trainer = gru.Trainer(model.net, model.bounds, RATES[0])
    flat, lengths = np.array([x for one in ids for x in one], np.int32), np.array([len(one) for one in ids], np.int64)
    for _ in range(PASSES if len(ids) else 0):
        trainer.texts(flat, lengths, gru.TOGETHER // 8)
    return trainer.net


def _averaged(texts: DataFrame, model: Model, words: int) -> dict[str, np.ndarray]:
    """The mean, by tokens, of the networks that tasks have trained on their own texts, each from ``model.net``."""
    head, net, bounds = model.head.slice(0, words), model.net, model.bounds

    def run(batches):
        trainer = gru.Trainer(net, bounds, RATES[1])
        for batch in sliced(batches, "text", TRAIN_BYTES):
            found, lengths = tokens(batch.column("text"))
            trainer.texts(_network_ids(_ids(found, head), words), lengths)
        if trainer.tokens:
            yield _sums(TaskContext.get().partitionId(), trainer.tokens, gru.packed(trainer.net).astype(np.float64) * trainer.tokens)

    def add(batches):
        tokens_, whole = 0, None
        for batch in batches:
            for n, raw in zip(batch.column("tokens").to_pylist(), batch.column("net"), strict=True):
                part = np.frombuffer(raw.as_buffer(), np.float64)
                tokens_, whole = tokens_ + n, part.copy() if whole is None else whole + part
        if whole is not None:
            yield _sums(0, tokens_, whole)

    schema = "part long, tokens long, net binary"
    parts = stage(texts.mapInArrow(run, schema))
    few = min(GATHER, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = stage(parts.repartition(few, "part").mapInArrow(add, schema))
    row = some.coalesce(1).mapInArrow(add, schema).first()  # the sums of at most GATHER tasks
    return gru.unpacked(np.frombuffer(row["net"], np.float64) / row["tokens"], net)


def _sums(part: int, tokens_: int, net: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens_], pa.int64()), pa.array([net.tobytes()], pa.binary())], ["part", "tokens", "net"])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (text), n_tokens, n_known, base_score and score (log10)."""
    head, head_counts, net, bounds = model.head, model.head_counts, model.net, model.bounds
    words, rare_total = net["inputs"].shape[1] - 2, model.rare_total
    ends = int(model.total > 0) and int(model.counts.where("term = ''").first()["n"])

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        logs = np.concatenate([np.log10(head_counts + 1.0), [0.0]])  # the last is that of -1
        for batch in sliced(batches, "__text", SCORE_BYTES):
            found, lengths = tokens(batch.column("__text"))
            places = _ids(found, head)
            text = np.repeat(np.arange(len(batch)), lengths)
            ids = _network_ids(places, words)
            by_text = lambda values, text=text, n=len(batch): np.bincount(text, values, n)
            rest = np.flatnonzero(places < 0)
            kinds = max(1, len(found.dictionary))
            once, times = np.unique(text[rest] * kinds + found.indices.to_numpy()[rest], return_counts=True)
            at = np.concatenate([[0], np.cumsum(np.bincount(once // kinds, minlength=len(batch)))]).astype(np.int32)
            cells = pa.StructArray.from_arrays([found.dictionary.take(pa.array(once % kinds)).cast(pa.string()), pa.array(times.astype(np.int64))], ["term", "n"])
            columns = {
                "__row": pa.array(row + np.arange(len(batch), dtype=np.int64)), "n_tokens": pa.array(lengths + 1),
                "__known": pa.array(by_text(places >= 0).astype(np.int64) + int(ends > 0)),
                "__base": pa.array(by_text(logs[places]) + np.log10(ends + 1.0)),
                # of a rare word the network gives the probability of being rare; its share among the rare follows here
                "__model": pa.array(gru.log_likelihood(net, bounds, ids, lengths) / np.log(10) + by_text(np.where(ids == RARE, logs[places] - np.log10(rare_total), 0.0))),
                "__rest": pa.ListArray.from_arrays(pa.array(at), cells),
            }
            row += len(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns.values()], [*keep, *columns])

    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep), "__row long, n_tokens long, __known long, __base double, __model double, __rest array<struct<term:string,n:long>>"])
    read = stage(source.mapInArrow(run, schema))
    rest = read.select("__row", F.explode("__rest").alias("w")).select("__row", "w.term", "w.n")
    counted = rest.join(model.counts.withColumnRenamed("n", "__c"), "term")
    more = counted.groupBy("__row").agg(F.sum(F.col("n") * F.log10(F.col("__c") + 1.0)).alias("__log"), F.sum("n").alias("__more"))
    # words that training has not seen have a count of 0, whose logarithm adds nothing
    both = read.drop("__rest").join(more, "__row", "left")
    log = F.coalesce("__log", F.lit(0.0))
    slots = float(np.log10(model.total + model.kinds + 1))
    return both.select(*keep, "n_tokens", (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"), (F.col("__base") + log - F.col("n_tokens") * slots).alias("base_score"), (F.col("__model") + log).alias("score"))
