"""Benchmark decontamination by a distributed positional inverted index.  DataFrame functions only.

The index stores a posting (term, document, position) for every training token whose term occurs in the benchmark, and a row
for each document with its number of words; it is written to the shared folder.  An item's windows are phrases of ``n``
consecutive words.  A phrase's two rarest terms, by their postings over the whole corpus, are looked up; their lists, adjusted
by the terms' offsets in the phrase, are intersected; and the places left are compared word by word with the document.  Terms
are hashed in the index, which can only add places to compare.

Work follows the postings of the rarest terms: a passage that a third of the documents hold costs a place for each of its
occurrences.  Places are rows.  Documents with places are split once more, into rows of words that gather in blocks of
``BLOCK`` words, and places meet the block they begin in; so no row holds all places of a document, however many, and no text
is split again for a place.  Texts stay
where they are read: the keys of documents with places come to them, as long as these are at most ``SMALL`` rows, and only
blocks with places may be shuffled; beyond that documents and keys meet in a shuffle.  The same holds for the benchmark's
vocabulary and look-ups.

Defined results: null and empty texts have no words and no hits; items without words have no windows; an item of fewer
than ``n`` words is one window; repeated rows each get the same answer; a null item id marks words as hit but is not listed
or counted among the items; an empty benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import dense_index
from ..staging import free, owned
from .common import ascii_lower, small, stage

#: Everything that is no word character, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SMALL = 500_000
#: Words of a block.
BLOCK = 128
#: What stands for a term in the rows that count a document's words, at position -1 - words.
NO_TERM = 0


def words(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def phrases(items: DataFrame, n: int) -> DataFrame:
    """Distinct windows: phrase (words joined by a blank), terms, length, and the item ids (as sorted strings)."""
    listed = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    cut = listed.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set("item").alias("items")).select(F.array_join("terms", " ").alias("phrase"), "terms", F.size("terms").alias("length"), "items")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged postings (term, __id, __hash, pos) of the tokens of ``docs`` whose term is in ``vocabulary`` (term), and for every
    row of ``docs`` one of NO_TERM with the position -1 - (number of words)."""
    # the words are bound once, so that a text is split once; before them stands their number, behind a NUL that no word has
    counted = F.transform(F.array(words(F.col(text_col))), lambda w: F.concat(F.array(F.concat(F.lit("\0"), F.size(w).cast("string"))), w))
    # the hash stands below the explode, or it would be computed for every word
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash"), F.get(counted, F.lit(0)).alias("__words"))
    cells = keyed.select("__id", "__hash", F.posexplode("__words").alias("at", "word"))
    number = F.when(F.col("at") == 0, F.substring("word", 2, 20).try_cast("int"))
    tokens = cells.select(F.when(F.col("at") > 0, F.xxhash64("word")).otherwise(F.lit(NO_TERM).cast("long")).alias("term"), "__id", "__hash", F.coalesce(-1 - number, F.col("at") - 1).alias("pos"))
    known = vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit(NO_TERM).cast("long").alias("term"))).distinct()
    # a word whose hash is NO_TERM by chance is a posting only if it is in the vocabulary; that it is kept does no harm
    return stage(tokens.join(small(known, SMALL), "term", "left_semi"))


def word_counts(index: DataFrame) -> DataFrame:
    """(__id, __hash, n_words) of every row of the indexed documents."""
    return index.where((F.col("term") == NO_TERM) & (F.col("pos") < 0)).select("__id", "__hash", (-1 - F.col("pos")).cast("long").alias("n_words"))


def lookups(wanted: DataFrame, index: DataFrame, most: int = 2) -> DataFrame:
    """For each phrase its ``most`` rarest terms: phrase number, term, offset, needed (how many lists must agree).

    A phrase with a term that has no posting occurs nowhere and is left out."""
    counts = small(stage(index.where("pos >= 0").groupBy("term").count()), SMALL)  # no more rows than the benchmark has terms
    spelled = wanted.select("number", "length", F.posexplode("terms").alias("offset", "word")).withColumn("term", F.xxhash64("word"))
    rarest = Window.partitionBy("number").orderBy("count", "offset")
    known = spelled.join(counts, "term").withColumn("known", F.count("*").over(Window.partitionBy("number"))).where(F.col("known") == F.col("length"))
    return known.withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= most).select("number", "term", "offset", F.least("length", F.lit(most)).alias("needed"))


@dataclass
class Occurrences:
    """``hits``: staged (__id, __hash, start, length, number), a row for each occurrence of a window, by document id and hash of
    the text, start counted in words from 0; ``windows``: staged (number, phrase, terms, length, items); ``index``."""

    hits: DataFrame
    windows: DataFrame
    index: DataFrame


def occurrences(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> Occurrences:
    wanted = stage(dense_index(phrases(items, n), "phrase", "number"))
    vocabulary = wanted.select(F.explode("terms").alias("word")).select(F.xxhash64("word").alias("term")).distinct()
    index = build_index(docs, vocabulary, id_col, text_col)
    asked = stage(lookups(wanted, index))
    places = (
        index.where("pos >= 0").join(small(asked, SMALL), "term")
        .select("__id", "__hash", (F.col("pos") - F.col("offset")).alias("start"), "number", "needed").where("start >= 0")
        .groupBy("__id", "__hash", "start", "number", "needed").agg(F.count("*").alias("lists"))
        .where(F.col("lists") >= F.col("needed"))
    )
    # repeated rows (same id and text) store their postings repeatedly, hence >= above and one place here
    spelled = places.join(small(wanted.select("number", "phrase", "length"), SMALL, F.col("length")), "number")
    listed = stage(spelled.groupBy("__id", "__hash", F.expr(f"start div {BLOCK}").alias("__block")).agg(F.collect_list(F.struct("start", "length", "number", "phrase")).alias("__places")))
    keys = listed.select("__id", "__hash", "__block")
    # documents with places are looked at again, and of them the blocks with places
    texts = _matched(with_hash(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text"), keys.select("__id", "__hash").distinct(), "left_semi")
    # a word is in the block of its place, and the first ones of a block are in the block before too, whose windows reach them
    cells = texts.select("__id", "__hash", F.posexplode(words(F.col("__text"))).alias("at", "word"))
    of = F.array_distinct(F.array(*[F.expr(f"cast(greatest(at - {d}, 0) div {BLOCK} as long)") for d in (0, n - 1)]))
    blocks = _matched(cells.select("__id", "__hash", "at", "word", F.explode(of).alias("__block")), keys, "left_semi", on="__block")
    some = blocks.groupBy("__id", "__hash", "__block").agg(F.array_sort(F.collect_set(F.struct("at", "word"))).alias("__cells"))
    both = _matched(some, listed, "inner", F.size("__places"), on="__block").withColumn("__words", F.transform("__cells", lambda c: c["word"]))
    right = F.filter("__places", lambda p: F.array_join(F.slice("__words", (p["start"] - F.col("__block") * BLOCK).cast("int") + 1, p["length"]), " ") == p["phrase"])
    found = both.select("__id", "__hash", F.explode(right).alias("p")).select("__id", "__hash", F.col("p.start").cast("int").alias("start"), "p.length", "p.number").distinct()
    return Occurrences(stage(found), wanted, index)


def with_hash(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def _matched(docs: DataFrame, found: DataFrame, how: str, weight: Column | None = None, on: str | None = None) -> DataFrame:
    """``docs`` (with __id, __hash, and ``on``) joined with rows of ``found``, which come to the documents while they are few
    (and, where they differ in size, of little weight)."""
    keys = ["__id", "__hash", *([on] if on else [])]
    other = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    if how in ("left_semi", "left_anti"):
        other = other.select(*[f"_{k}" for k in keys])
    test = F.col("__id").eqNullSafe(F.col("___id"))
    for k in keys[1:]:
        test = test & (F.col(k) == F.col(f"_{k}"))
    return docs.join(small(other, SMALL, weight), test, how).drop(*[f"_{k}" for k in keys])


def covered(hits: DataFrame) -> DataFrame:
    """(__id, __hash, n_hit): how many word positions the occurrences of each document cover."""
    before = Window.partitionBy("__id", "__hash").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    seen = F.coalesce(F.max(end).over(before), F.lit(0))
    new = hits.select("__id", "__hash", F.greatest(end - F.greatest(F.col("start"), seen), F.lit(0)).alias("new"))
    return new.groupBy("__id", "__hash").agg(F.sum("new").cast("long").alias("n_hit"))


def listed_items(found: Occurrences) -> DataFrame:
    """(__id, __hash, items): the ids of the items with occurring windows, as strings, sorted."""
    named = found.windows.select("number", F.explode("items").alias("item"))
    ids = found.hits.select("__id", "__hash", "number").distinct().join(small(named, SMALL), "number").select("__id", "__hash", "item").distinct()
    return ids.groupBy("__id", "__hash").agg(F.array_sort(F.collect_list("item")).alias("items"))


def counts(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: its id, n_words, n_hit (words in occurrences), and items (ids of the items with occurring
    windows, sorted as strings)."""
    found = occurrences(docs, items, n, id_col, text_col)
    none = F.array().cast("array<string>")
    ids = listed_items(found).select("__id", "__hash", "items", F.lit(0).cast("long").alias("n_hit"))
    # one row for each document that is hit, its items put to its words by a union and not by a join
    both = ids.unionByName(covered(found.hits).select("__id", "__hash", F.lit(None).cast("array<string>").alias("items"), "n_hit"))
    digest = stage(both.groupBy("__id", "__hash").agg(F.first("items", ignorenulls=True).alias("items"), F.sum("n_hit").alias("n_hit")))
    weight = F.coalesce(F.size("items"), F.lit(0)) + 1
    return _matched(word_counts(found.index), digest, "left", weight).select(F.col("__id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def find(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of every row of ``docs`` with ``__found``: a struct of ``n_words`` and ``hits``, an array of (start, length,
    items) for each occurrence (empty without one).  For documents whose occurrences fit a row; ``occurrences`` has rows."""
    found = occurrences(docs, items, n, id_col, text_col)
    hits = found.hits.join(small(found.windows.select("number", "items"), SMALL, F.size("items")), "number")
    listed = stage(hits.groupBy("__id", "__hash").agg(F.array_sort(F.collect_list(F.struct("start", "length", "items"))).alias("hits")))
    names = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    joined = _matched(with_hash(keyed, "__text"), listed, "left", F.expr("aggregate(hits, 0, (n, h) -> n + 1 + size(h.items))"))
    none = F.array().cast("array<struct<start:int,length:int,items:array<string>>>")
    return joined.select(*[F.col("__row")[c].alias(c) for c in names], F.struct(F.size(words(F.col("__text"))).alias("n_words"), F.coalesce("hits", none).alias("hits")).alias("__found"))


def clean(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs``, columns as they are, in which no window of a benchmark item occurs."""
    with owned() as passing:
        hits = occurrences(docs, items, n).hits
    found = stage(hits.select("__id", "__hash").distinct())
    free(passing)
    names = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    return _matched(with_hash(keyed, "__text"), found, "left_anti").select(*[F.col("__row")[c].alias(c) for c in names])


def near(docs: DataFrame, items: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proximity matches: (id, item_id, pos) where every distinct term of an item stands at most ``within`` words from an
    occurrence, at ``pos``, of its rarest term.  Null and empty texts and items match nothing."""
    terms = items.select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).select("item_id", F.xxhash64("word").alias("term")).distinct()
    index = build_index(docs, terms.select("term").distinct(), id_col, text_col)
    index = index.where("pos >= 0")
    counted = terms.join(index.groupBy("term").count(), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    by_item = Window.partitionBy("item_id")
    ranked = stage(counted.withColumn("rank", F.row_number().over(by_item.orderBy("count", "term"))).withColumn("size", F.count("*").over(by_item)))
    anchors = index.join(ranked.where("rank = 1").select("item_id", "term", "size"), "term").select("item_id", "size", "__id", "__hash", F.col("pos").alias("at"))
    span = 2 * within + 1
    cells = anchors.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.floor((F.col("at") + d) / span) for d in (-within, within)]))))
    others = index.join(ranked.select("item_id", "term"), "term").select("item_id", "term", "__id", "__hash", "pos", F.floor(F.col("pos") / span).alias("cell"))
    meet = cells.join(others, ["item_id", "__id", "__hash", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    full = meet.groupBy("item_id", "__id", "__hash", "at", "size").agg(F.count_distinct("term").alias("terms")).where("terms = size")
    return full.select(F.col("__id").alias(id_col), "item_id", F.col("at").alias("pos")).distinct()
