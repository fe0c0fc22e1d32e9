"""Licence scans: a trained paragraph classifier.  DataFrame and ML-pipeline functions only.

A paragraph (a line) becomes hashed counts of its words and word pairs; multinomial logistic regression gives it a licence
family or "unknown".  The classifier is trained here: for the families on notices put together from the names, phrasings and
passages of ``notices``, with varied holders and surroundings; for "unknown" on sentences that merely speak of licences and
rights, on notices of licences of no family, and on the paragraphs of the whole corpus that have a key and name no licence.

Keys are words and word pairs of the templates, chosen so that what has none of them reaches no template by half: such a
paragraph gives no row whatever the classifier says, so the classifier neither learns from it nor is asked.  All others, of all
documents, are learnt from (three in four, by a hash) or held back (one in four), and all are judged.

"Unknown" is calibrated twice, on paragraphs that nothing is trained on.  The probability of being no unknown must reach the
``cut`` that one in a thousand of the paragraphs held back would pass besides having a template that confirms them.  The probability of the family itself must reach
the ``floor`` that one in twenty notices of licences that training never saw would pass (sentences with licence words among
them).  A prediction counts when a template of its family confirms it: at least half of the template's words and word pairs
stand in the paragraph; names of one or two words confirm only beside a word of ``notices.BESIDE``.

A notice may be wrapped.  A paragraph that is not clearly unknown is judged again together with the next one;
the two are a notice if the next is none by itself, and the first is none or less like its template.

The scan is one narrow pass over whole texts; nothing is shuffled.  Texts and then paragraphs without a key are left out by a
regular expression before any word is cut.  The few paragraphs that are not clearly unknown are staged.

Defined results: null and empty texts and blank paragraphs give no rows; repeated rows each give their rows; a paragraph
gives at most one row, a wrapped notice one for the paragraph it begins in; equally similar templates count once; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import notices
from .common import stage

UNKNOWN = "unknown"
#: Paragraphs with such words may be notices, and so are no examples of "unknown"; the scan does not ask for them.
CUES = r"(?i)licen[sc]|copyright|©|creative commons|rights reserved|reproduced|redistribut|public domain|spdx|gpl|\bbsd\b|\bmpl\b|apache|mozilla|\bcc0\b|\bcc[ -]by"
FEATURES = 1 << 14
#: Words that are no keys while others, or pairs of words, will do.
COMMON = {"the", "of", "by", "in", "to", "and", "this", "with", "may", "you", "for", "not", "be", "or", "is", "it", "from", "without", "under", "all", "any", "other", "are", "that", "free", "work", "will", "same", "mit", "de", "les", "tous", "alle", "los"}
#: A paragraph less likely than this to be a notice is not joined with the next one.
LIKELY = 0.1
#: The cut is never lower than this.
LEAST_CUT = 0.4
#: The share of a template that confirms a prediction.
CONFIRM = 0.5
#: The floor on a family's probability lies between these.
FLOORS = 0.5, 0.9


def paragraphs(text):
    return F.split(text, r"[\r\n]+")


def tokens(paragraph):
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), "")


def pairs(words):
    return F.when(F.size(words) < 2, words).otherwise(F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def terms(words):
    return F.concat(words, pairs(words))


def _template_keys(words: list[str], confirm: float) -> set[str]:
    """Words and word pairs of a template without which less than ``confirm`` of its terms can stand in a paragraph: rare-looking
    words, the longest first, then pairs, then other words."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    left, found, least = {*words, *pairs}, set(), confirm * len({*words, *pairs})
    plain = {w for w in words if w.isalpha() and len(w) > 1 and w not in COMMON}
    for key in [*sorted(plain, key=lambda w: (-len(w), w)), *sorted(pairs, key=lambda p: (-len(p), p)), *sorted({*words} - plain, key=lambda w: (-len(w), w))]:
        if len(left) < least:
            break
        if key in left:
            found.add(key)
            left = {t for t in left if t != key and key not in t.split(" ")}
    return found


def _any_of(terms: set[str]) -> str:
    """A regular expression for one of the words or word pairs, in lower case."""
    by_letter: dict[str, list[str]] = {}
    for term in sorted(terms):
        by_letter.setdefault(term[0], []).append(r"[^\p{L}\p{N}]+".join(map(re.escape, term.split(" ")))[1:])
    return r"(?:^|[^a-z0-9])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_letter.items()) + r")(?![\p{L}\p{N}])"


def keyed(text: Column, confirm: float = CONFIRM) -> Column:
    """Whether ``text`` has a key: false only where no template can reach ``confirm`` in it (see ``similarity``)."""
    if confirm <= 0:
        return text.isNotNull()
    long, short = set(), set()
    for family in notices.TEMPLATES.values():
        for template in family:
            words = [w for w in re.split(r"[\W_]+", template.lower()) if w]
            (short if len({*words, *zip(words, words[1:], strict=False)}) <= 3 else long).update(_template_keys(words, confirm))
    low = F.lower(text)
    # nearly all texts fail the first test; short templates only count beside another word of a notice
    return low.rlike(_any_of(long | short)) & (low.rlike(_any_of(long)) | low.rlike(_any_of({*notices.BESIDE})))


def near(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that have a key, staged: to train on them or to scan them gives what all of ``docs`` give."""
    return stage(docs.where(keyed(F.col(text_col))))


@dataclass
class Model:
    families: list[str]
    regression: LogisticRegressionModel
    cut: float
    floor: float


def _probabilities(rows: DataFrame, words: str, regression: LogisticRegressionModel, out: str) -> DataFrame:
    """``rows`` with ``out``: the probabilities of all classes for the words in column ``words``."""
    hashed = HashingTF(inputCol="__terms", outputCol="__vector", numFeatures=FEATURES).transform(rows.withColumn("__terms", terms(F.col(words))))
    regression.setFeaturesCol("__vector").setProbabilityCol("__p")
    return regression.transform(hashed).withColumn(out, vector_to_array("__p")).drop("__terms", "__vector", "__p")


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Fit on the made-up notices and on all paragraphs of ``docs`` that have a key and no cue."""
    spark = docs.sparkSession
    families = [UNKNOWN, *notices.FAMILIES]
    # groups: 0 the corpus, 1 sentences and notices that are made up for "unknown", 2 the families
    known = spark.createDataFrame([(float(families.index(f)), text, False, 2) for f, text in notices.examples()] + [(0.0, text, False, 1) for text in [*notices.mentions(), *notices.others()]], "label double, paragraph string, held boolean, made int")
    own = docs.where(keyed(F.col(text_col))).select(F.explode(paragraphs(F.col(text_col))).alias("paragraph"))
    own = own.where(keyed(F.col("paragraph")) & ~F.col("paragraph").rlike(CUES)).distinct()
    other = own.select(F.lit(0.0).alias("label"), "paragraph", (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 3).alias("held"), F.lit(0).alias("made"))
    rows = stage(known.unionByName(other).select("label", "held", "made", tokens(F.col("paragraph")).alias("words")))
    fitted = rows.where("not held")
    sizes = {(r["label"], r["made"]): r["count"] for r in fitted.groupBy("label", "made").count().collect()}
    # every family weighs the same, "unknown" five times as much: half for the corpus, however large it is, half for the made-up
    half = 2.5 if (0.0, 0) in sizes else 5.0
    shares = {group: (half if group[0] == 0 else 1.0) * 1000.0 / size for group, size in sizes.items()}
    weight = F.element_at(F.create_map(*[F.lit(x) for (label, made), share in shares.items() for x in (label * 3 + made, share)]), F.col("label") * 3 + F.col("made"))
    vectors = HashingTF(inputCol="terms", outputCol="vector", numFeatures=FEATURES).transform(fitted.select("label", weight.alias("weight"), terms(F.col("words")).alias("terms")))
    regression = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", family="multinomial", maxIter=60, regParam=3e-4, standardization=False, rawPredictionCol="", predictionCol="").fit(vectors)
    held = _probabilities(rows.where("held").select("words"), "words", regression, "p")
    # what no template confirms does not pass anyway
    best = F.slice("p", F.lit(2), F.lit(len(families)))
    family = F.element_at(F.array(*map(F.lit, families[1:])), F.array_position(best, F.array_max(best)).cast("int"))
    passing = F.when(similarity(family, F.col("words"), templates(spark)) >= CONFIRM, 1 - F.col("p")[0]).otherwise(0.0)
    cut = held.agg(F.percentile_approx(passing, 0.999, 10_000)).first()[0]
    cut = max(LEAST_CUT, cut or 0.0)
    strange = spark.createDataFrame([(text,) for text in notices.calibration()], "paragraph string").select(tokens(F.col("paragraph")).alias("words"))
    # the likeliest family's probability, where the paragraph passes as no unknown at all
    likeliest = F.when(1 - F.col("p")[0] >= cut, F.array_max(best)).otherwise(0.0)
    floor = _probabilities(strange, "words", regression, "p").agg(F.percentile_approx(likeliest, 0.95, 10_000)).first()[0]
    return Model(families, regression, cut, min(max(FLOORS[0], floor), FLOORS[1]))


def templates(spark: SparkSession) -> Column:
    """The words and word pairs of each template by family, as one literal (they are a few constants)."""
    rows = [(family, text) for family, texts in notices.TEMPLATES.items() for text in texts]
    found: dict[str, list] = {}
    for row in spark.createDataFrame(rows, "family string, text string").select("family", F.array_distinct(terms(tokens(F.col("text")))).alias("terms")).collect():
        found.setdefault(row["family"], []).append(row["terms"])
    return F.from_json(F.lit(json.dumps(found)), "map<string,array<array<string>>>")


def similarity(family: Column, words: Column, known: Column) -> Column:
    """The largest share of the distinct words and word pairs of a template of ``family`` that ``words`` has; templates of one
    or two words (three terms at most) only count beside another word of a notice."""
    own, beside = F.array_distinct(terms(words)), F.arrays_overlap(words, F.array(*map(F.lit, notices.BESIDE)))
    share = lambda template: F.size(F.array_intersect(own, template)) / F.size(template)
    return F.array_max(F.transform(F.element_at(known, family), lambda template: F.when((F.size(template) > 3) | beside, share(template)).otherwise(0.0)))


def scan(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", confirm: float = CONFIRM) -> DataFrame:
    """A row for each licence notice: the ``keep`` columns, paragraph (from 0), family, probability, similarity.

    ``similarity`` is that to the nearest template of the family; at least ``confirm``."""
    kept = [f"__k{i}" for i in range(len(keep))]
    cut_up = docs.where(keyed(F.col(text_col), confirm)).select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], paragraphs(F.col(text_col)).alias("__cut"))
    with_next = F.zip_with("__cut", F.slice("__cut", F.lit(2), F.greatest(F.size("__cut") - 1, F.lit(0))), lambda own, after: F.struct(own.alias("own"), after.alias("next")))
    source = cut_up.select(*kept, F.posexplode(with_next).alias("__at", "__lines"))
    source = source.where(keyed(F.concat_ws("\n", "__lines.own", "__lines.next"), confirm))
    lines = source.select(*kept, "__at", "__lines.next", tokens(F.col("__lines.own")).alias("__own")).where(F.size("__own") > 0)
    # staged here and below: a few rows from here on, and what was computed for them is not computed again for each use
    judged = stage(_probabilities(lines, "__own", model.regression, "__p_own").where(1 - F.col("__p_own")[0] >= min(LIKELY, model.cut)))
    wrapped = judged.withColumn("__next", F.coalesce(tokens(F.col("next")), F.array().cast("array<string>"))).withColumn("__both", F.concat("__own", "__next"))
    for words in ("next", "both"):
        wrapped = _probabilities(wrapped, f"__{words}", model.regression, f"__p_{words}")
    wrapped = stage(wrapped)

    def likeliest(words: str) -> Column:
        p = F.col(f"__p_{words}")
        return F.struct(F.element_at(F.array(*map(F.lit, model.families)), F.array_position(p, F.array_max(p)).cast("int")).alias("family"), F.array_max(p).alias("probability"), (1 - p[0]).alias("known"))

    def verdict(words: str) -> Column:
        best = F.col(f"__best_{words}")
        like = similarity(best["family"], F.col(f"__{words}"), known)
        sure = (best["family"] != UNKNOWN) & (best["known"] >= model.cut) & (best["probability"] >= model.floor) & (F.size(f"__{words}") > 0)
        return F.when(sure, F.struct(best["family"].alias("family"), best["probability"].alias("probability"), like.alias("similarity")))

    three, known = ("own", "next", "both"), templates(docs.sparkSession)
    best = wrapped.select(*kept, "__at", *[f"__{w}" for w in three], *[likeliest(w).alias(f"__best_{w}") for w in three])
    tried = best.select(*kept, "__at", *[verdict(w).alias(f"__{w}") for w in three])
    passed = [F.when(F.col(f"__{w}")["similarity"] >= confirm, F.col(f"__{w}")).alias(f"__{w}") for w in three]
    joined = F.col("__both").isNotNull() & F.col("__next").isNull() & (F.col("__own").isNull() | (F.col("__both.similarity") > F.col("__own.similarity")))
    found = tried.select(*kept, "__at", *passed).select(*kept, "__at", F.when(joined, F.col("__both")).otherwise(F.col("__own")).alias("__found")).where("__found is not null")
    return found.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], F.col("__at").cast("long").alias("paragraph"), "__found.family", "__found.probability", "__found.similarity")
