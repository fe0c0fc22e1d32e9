"""Audit of how far the sources of a language diverge in their words, exactly, by a heavy-light split.

Every group (lang, source) gives each term that its language keeps a share p in billionths; two groups diverge by the sum of
floor((p - q)^2 / q) over all kept terms.  Terms that many groups have are heavy: their shares fill dense numpy tiles, some
terms by two blocks of groups each.  Terms that few groups have are light: nearly all groups give them the share of a term
they lack, so a pair's sum over them is that of lacking all, corrected by each group's own counts (as many corrections as a
group has different counts) and, from sparse posting lists, by the terms that both have.  The partial sums are whole numbers
and add up exactly.

Counting meets in aggregations with partial sums before each shuffle, so a source with a third of all rows is a larger
vocabulary and no hot task.  A tile holds ``TILE_TERMS`` terms of two blocks of ``BLOCK`` groups; a posting list of a light
term is shorter than a part of the number of groups of its language.

Defined results: null text, lang and source count as empty; a group without terms takes part with the share of a term it
lacks; repeated rows count repeatedly; a language with a single source has no pairs, one without kept terms has pairs of
value 0; an empty table gives no rows.  Further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_table, sliced, small, spans, stage, text_view

#: A kept term is in so many documents of its language.
LEAST_DOCS = 3
#: Shares are in parts of this.
UNIT = 1_000_000_000
#: A term is heavy if it is in one of so many groups of its language.
HEAVY_IN = 4
#: Terms and groups (on either side) of a dense tile, and numbers that a step over posting lists holds.
TILE_TERMS, BLOCK, STEP = 512, 64, 1 << 20
SLICE_BYTES = 4 << 20
SMALL = 500_000

LETTERS = byte_table("alnum")
LETTERS[0x30:0x3A] = False


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = text_view(batch.column("__text"))
    starts, ends, doc = spans(LETTERS[raw], offsets)
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    groups, of = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)), pa.py_buffer(LOWER[raw[LETTERS[raw]]])).dictionary_encode()
    kinds = max(1, len(words.dictionary))
    # a document's words once each, then those of each group
    once, times = np.unique(doc * kinds + words.indices.to_numpy(), return_counts=True)
    keys, at = np.unique(of[once // kinds] * kinds + once % kinds, return_inverse=True)
    n, docs = np.zeros(len(keys), np.int64), np.bincount(at, minlength=len(keys))
    np.add.at(n, at, times)
    # and a row without a term for each group, so that groups without terms are known
    group = np.concatenate([groups[keys // kinds], groups])
    term = pa.concat_arrays([words.dictionary.take(pa.array(keys % kinds)).cast(pa.string()), pa.nulls(len(groups), pa.string())])
    none = np.zeros(len(groups), np.int64)
    columns = [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))), term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]).astype(np.int64))]
    return pa.RecordBatch.from_arrays([columns[0].cast(pa.string()), columns[1].cast(pa.string()), *columns[2:]], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row with a null term and
    zeros for each group."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))

    def run(batches):
        for batch in sliced(batches, "__text", SLICE_BYTES):
            yield _counted(batch)

    counted = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").alias("__text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share_sql(count: str, total: str, kinds: str) -> str:
    """1 + floor(UNIT * (count + 1) / (total + kinds)) of three columns; in decimals where the product exceeds a long."""
    wide = f"cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div cast({total} + {kinds} as decimal(20,0))"
    return f"1 + case when {count} < {2**63 // UNIT - 2} then {UNIT} * ({count} + 1) div ({total} + {kinds}) else {wide} end"


def excess(p, q):
    """floor((p - q)^2 / q) of arrays of whole numbers."""
    d = p - q
    d *= d
    return d // q


def _paired(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of equal (a, b) added up; the zeros go."""
    keys = a.astype(np.int64) << 32 | b
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)
    sums = np.add.reduceat(value[order], first) if keys.size else value
    return keys[first] >> 32, keys[first] & 0xFFFFFFFF, sums


SUMS = "lang string, a long, b long, value long"


def _batch(lang: str, a, b, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), *(pa.array(np.ascontiguousarray(x, np.int64)) for x in (a, b, value))], ["lang", "a", "b", "value"])


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums over a tile's terms for all ordered pairs of a group of its first block and one of its second.

    Rows without a term say which groups there are, with the share of a term they lack.  The tile of a language's light terms
    has, for each group, its different shares and how many terms have them, and the number of light terms in all."""
    lang, chunk, left, right = (x.as_py() for x in key)
    g, p, weight = (table[c].to_numpy().astype(np.int64) for c in ("g", "p", "weight"))
    of_group = table["base"].to_numpy(zero_copy_only=False)
    groups, order = np.unique(g[of_group], return_index=True)
    base, at = p[of_group][order], np.searchsorted(groups, g)
    a, b = (np.flatnonzero(groups // BLOCK == x) for x in (left, right))
    sums = np.zeros((len(groups), len(groups)), np.int64)
    if chunk >= 0:
        terms = table["term"].combine_chunks().filter(pa.array(~of_group)).dictionary_encode()
        shares = np.repeat(base[None, :], len(terms.dictionary), axis=0)
        shares[terms.indices.to_numpy(), at[~of_group]] = p[~of_group]
        for i in a:
            sums[i, b] = excess(shares[:, [i]], shares[:, b]).sum(axis=0)
            sums[b, i] = excess(shares[:, b], shares[:, [i]]).sum(axis=0)
    else:
        sums[np.ix_(a, b)] = weight[of_group][0] * excess(base[a][:, None], base[b][None, :])
        sums[np.ix_(b, a)] = weight[of_group][0] * excess(base[b][:, None], base[a][None, :])
        mine = {x: np.flatnonzero(~of_group & (at == x)) for x in {*a, *b}}
        for x, y in ((a, b), (b, a)):
            for i in x:  # those that group i has and the others lack
                rows = mine[i]
                sums[i, y] += (weight[rows, None] * (excess(p[rows][:, None], base[y][None, :]) - excess(base[[i]], base[y])[None, :])).sum(axis=0)
                sums[y, i] += (weight[rows, None] * (excess(base[y][None, :], p[rows][:, None]) - excess(base[y], base[[i]])[None, :])).sum(axis=0)
            if left == right:
                break
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(groups)), np.arange(len(groups)), indexing="ij"))
    of = lambda x, y: np.isin(x, a) & np.isin(y, b)
    wanted = (of(i, j) | of(j, i)) & (i != j)
    return pa.Table.from_batches([_batch(lang, groups[i[wanted]], groups[j[wanted]], sums[i[wanted], j[wanted]])])


def _postings(batches):
    """For every posting list (lang, list of g, p, base), what pairs of groups that both have its term differ by from the sum
    of one having it and of the other having it."""
    for batch in batches:
        lists = batch.column("listed")
        cells = lists.flatten()
        g, p, base = (cells.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        langs = batch.column("lang").dictionary_encode()
        kind = langs.indices.to_numpy().astype(np.int64) << 32 | np.diff(ends)
        for one in np.unique(kind):
            k, rows = int(one & 0xFFFFFFFF), np.flatnonzero(kind == one)
            lang = langs.dictionary[int(one >> 32)].as_py()
            for at in range(0, len(rows), max(1, STEP // k**2)):
                cut = ends[rows[at : at + max(1, STEP // k**2)]][:, None] + np.arange(k)
                for i in range(0, k, wide := max(1, STEP // cut.size)):
                    x, y = cut[:, i : i + wide, None], cut[:, None, :]
                    value = excess(p[x], p[y]) - excess(p[x], base[y]) - excess(base[x], p[y]) + excess(base[x], base[y])
                    a, b = np.broadcast_arrays(g[x], g[y])
                    apart = a != b
                    yield _batch(lang, *_paired(a[apart], b[apart], value[apart]))


class Audit:
    """The staged counts of a table and what follows from them: ``pairs`` and ``terms``."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        by_term = Window.partitionBy("lang", "term")
        counted = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(by_term), "lang_n": F.sum("n").over(by_term), "groups": F.count("*").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1})
        counts = stage(counted.where(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).drop("in_docs", "docs"))
        named = F.col("term").isNotNull()
        sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        # a language's number of groups is that of its rows without a term
        many = counts.groupBy("lang").agg(F.sum((~named).cast("long")).alias("sources"), F.sum("n").alias("lang_total"), F.sum((named & F.col("first")).cast("long")).alias("kinds"))
        many = small(stage(many), SMALL)
        heavy = (F.col("groups") * HEAVY_IN >= F.col("sources")) & named
        split = counts.where("first").join(many, "lang").groupBy("lang").agg(F.sum(heavy.cast("long")).alias("heavy_kinds"))
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        #: (lang, source, g, base, ...): each group with its number and the share of a term it lacks.
        self.groups = stage(
            sizes.join(many, "lang").join(small(split, SMALL), "lang").withColumn("g", number.cast("long")).withColumn("none", F.lit(0).cast("long"))
            .withColumn("base", F.expr(f"case when kinds = 0 then 1 else {share_sql('none', 'total', 'kinds')} end")).drop("none")
        )
        shares = counts.where(named).join(small(self.groups, SMALL), ["lang", "source"])
        #: (lang, source, term, g, p, q, ...): each group's terms with their share in it and in its language.
        self.shares = shares.withColumns({"p": F.expr(share_sql("n", "total", "kinds")), "q": F.expr(share_sql("lang_n", "lang_total", "kinds")), "heavy": F.col("groups") * HEAVY_IN >= F.col("sources")})

    def terms(self, most: int = 200) -> DataFrame:
        """(lang, source, item, value, rank): the ``most`` terms of each group that exceed their share in the language most."""
        more = self.shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
        ranked = more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
        return ranked.where(F.col("rank") <= most)

    def sums(self) -> DataFrame:
        """(lang, a, b, value): for each ordered pair of groups, by number, their divergence over all kept terms of the language."""
        blocks = f"cast((sources + {BLOCK - 1}) div {BLOCK} as int)"
        tiles = f"explode(transform(sequence(0, {blocks} - 1), x -> struct(least(x, cast(g div {BLOCK} as int)) as `left`, greatest(x, cast(g div {BLOCK} as int)) as `right`)))"
        chunks = f"cast((heavy_kinds + {TILE_TERMS - 1}) div {TILE_TERMS} as int)"
        chunk = F.expr(f"cast(pmod(xxhash64(term), {chunks}) as int)")
        nothing, one = F.lit(None).cast("string"), F.lit(1).cast("long")
        heavy = self.shares.where("heavy").select("lang", chunk.alias("chunk"), "g", "p", one.alias("weight"), "term", F.lit(False).alias("base"), F.expr(tiles).alias("tile"))
        own = self.groups.withColumn("chunk", F.explode(F.expr(f"sequence(-1, {chunks} - 1)"))).select("lang", "chunk", "g", F.col("base").alias("p"), (F.col("kinds") - F.col("heavy_kinds")).alias("weight"), nothing.alias("term"), F.lit(True).alias("base"), F.expr(tiles).alias("tile"))
        light = self.shares.where("not heavy")
        different = light.groupBy("lang", "g", "p", "sources").agg(F.count("*").alias("weight")).select("lang", F.lit(-1).alias("chunk"), "g", "p", "weight", nothing.alias("term"), F.lit(False).alias("base"), F.expr(tiles).alias("tile"))
        rows = heavy.unionByName(own).unionByName(different).select("lang", "chunk", "tile.left", "tile.right", "g", "p", "weight", "term", "base")
        dense = rows.groupBy("lang", "chunk", "left", "right").applyInArrow(_tile, SUMS)
        lists = light.where("groups > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "base")).alias("listed")).select("lang", "listed")
        sparse = lists.mapInArrow(_postings, SUMS)
        return dense.unionByName(sparse).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): every group's other sources of its language, by divergence."""
        names = self.groups.select("lang", F.col("g"), "source")
        named = self.sums().join(small(names.withColumnRenamed("g", "a"), SMALL), ["lang", "a"]).join(small(names.withColumnsRenamed({"g": "b", "source": "item"}), SMALL), ["lang", "b"])
        return named.select("lang", "source", "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): ``Audit.pairs`` as part ``pair`` and ``Audit.terms`` as part ``term``."""
    found = Audit(docs, least_docs)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return found.pairs().withColumn("part", F.lit("pair")).select(columns).union(found.terms(most_terms).withColumn("part", F.lit("term")).select(columns))
