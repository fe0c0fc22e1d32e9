"""URL filtering by association rules: FP-growth mines token combinations of URLs that go with a label, confidence and
support prune the rules, and the rest match URLs through an inverted index.  DataFrame functions only.

A URL's tokens are its host labels, the words of labels that consist of several, and the segments of its path.  Every
distinct URL of the labelled part is a transaction and also holds the item of its label, if it has one; confidence is
measured against all of them, and must beat the label's share among them beyond chance.  Labels are the caller's; ``page_label`` gives one by a page's content.

Explicit (host, path) rules come first.  They are a short list written by people (at most ``RULES``), so they stand in the
plan as literals.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and the default verdict; repeated rows
are judged alike, each giving a row; equal rules go to the higher support, then the smaller tokens; an empty table gives no
rows, and no labels give no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, stage

RULES = 10_000
INDEX_ROWS = 200_000
#: URLs for each partition of the miner.
URLS_EACH = 100_000
#: Share of symbols above which a page counts as junk.
JUNK = 0.03


def host_of(url):
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules: list[tuple[str, str]]):
    """The longest of ``rules`` ("host/path", verdict) that fits, as a struct of rule and verdict, or null.

    A rule fits its host and all subdomains of it, if the path starts with the rule's path."""
    if len(rules) > RULES:
        raise ValueError(f"at most {RULES} explicit rules")
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fitting = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def tokens_of(host, path):
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(labels, lambda x: x.rlike(r"[^\p{L}\p{N}]"))
    words = F.filter(F.flatten(F.transform(parts, lambda x: F.split(x, r"[^\p{L}\p{N}]+"))), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("host:"), x)), F.transform(words, lambda x: F.concat(F.lit("word:"), x)), F.transform(segments, lambda x: F.concat(F.lit("path:"), x))))


def page_label(html):
    """What a page's text says of it: "block" where symbols and shouting make up more than ``JUNK`` of it, else "allow"; null
    without text."""
    text = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " "))
    marks = F.length(text) - F.length(F.translate(text, "#$%&*|!", ""))
    return F.when(F.length(text) > 0, F.when(marks > JUNK * F.length(text), F.lit("block")).otherwise(F.lit("allow")))


#: What ``mine`` returns.
RULE = "tokens array<string>, verdict string, confidence double, support double, lift double, sure double, key string"


def lower_bound(share, n, z: float):
    """Wilson's lower bound of a probability of which ``n`` trials gave ``share``, at ``z`` standard deviations."""
    square = z * z
    return (share + square / (2 * n) - z * F.sqrt((share * (1 - share) + square / (4 * n)) / n)) / (1 + square / n)


def mine(urls: DataFrame, min_support: float, min_confidence: float, most_tokens: int = 3, least_urls: int = 2, z: float = 3.0) -> DataFrame:
    """Staged rules (``RULE``) from ``urls`` (url, tokens, label; label null if unknown).  ``key`` is a rule's rarest token.

    A rule must say more than its verdict's share of all URLs does: the lower bound of its confidence (``sure``, Wilson's at
    ``z`` standard deviations) must lie above that share.  ``lift`` is confidence over share.

    ``min_support`` is the least share of the URLs, ``least_urls`` their least number; tokens below are dropped before mining,
    so that transactions stay short.  A rule is redundant, and goes, if fewer of its tokens give the same verdict with as
    much confidence."""
    spark = urls.sparkSession
    distinct = stage(urls.groupBy("url").agg(F.first("tokens").alias("tokens"), F.max("label").alias("label")))
    n = distinct.count()
    least = max(2, least_urls, int(min_support * n))
    if n < least:
        return spark.createDataFrame([], RULE)
    # only tokens frequent among labelled URLs can be in a rule: the others are dropped by a join with the frequent ones
    counted = distinct.where(F.col("label").isNotNull()).select(F.explode("tokens").alias("token")).groupBy("token").count()
    frequent = stage(counted.where(F.col("count") >= least))
    kept = stage(
        distinct.select("url", "label", F.explode("tokens").alias("token")).join(small(frequent.select("token"), INDEX_ROWS), "token")
        .groupBy("url").agg(F.collect_set("token").alias("tokens"), F.max("label").alias("label"))
        .select(F.when(F.col("label").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array(F.concat(F.lit("="), "label")))).alias("items"))
    )
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // URLS_EACH)
    model = FPGrowth(itemsCol="items", minSupport=least / n * 0.999, minConfidence=min_confidence, numPartitions=partitions).fit(kept)
    found = stage(
        model.associationRules.where(F.startswith(F.element_at("consequent", 1), F.lit("=")) & F.forall("antecedent", lambda x: ~F.startswith(x, F.lit("="))) & (F.size("antecedent") <= most_tokens))
        .select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 2, 1 << 20).alias("verdict"), "confidence", "support")
    )
    base = distinct.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("verdict")).agg((F.count("*") / F.lit(n)).alias("share"))
    had = F.greatest(F.round(F.col("support") * n / F.col("confidence")), F.lit(1.0))
    found = stage(
        found.join(F.broadcast(base), "verdict").withColumn("sure", lower_bound(F.col("confidence"), had, z)).where(F.col("sure") > F.col("share"))
        .select("tokens", "verdict", "confidence", "support", (F.col("confidence") / F.col("share")).alias("lift"), "sure")
    )
    # the subsets of at most three tokens of a rule are few: each rule looks its own up
    single = F.transform("tokens", lambda x: F.array(x))
    pairs = F.flatten(F.transform("tokens", lambda x: F.transform(F.filter("tokens", lambda y: y > x), lambda y: F.array(x, y))))
    fewer = found.select("tokens", "verdict", "confidence", F.explode(F.filter(F.concat(single, pairs), lambda s: F.size(s) < F.size("tokens"))).alias("part"))
    given = found.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("known"))
    redundant = fewer.join(given, ["part", "verdict"]).where(F.col("known") >= F.col("confidence")).select("tokens", "verdict").distinct()
    pruned = found.join(redundant, ["tokens", "verdict"], "left_anti")
    rarest = pruned.select("tokens", F.explode("tokens").alias("token")).distinct().join(frequent, "token").groupBy("tokens").agg(F.min_by("token", F.struct("count", "token")).alias("key"))
    return stage(pruned.join(rarest, "tokens").select(*[c.split()[0] for c in RULE.split(", ")]))


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, keep: list, default: str = "allow") -> DataFrame:
    """``keep`` columns of every row of ``pages`` with host, path, rule, verdict and mined.

    The rules' index is keyed by the rarest token of each rule; a page's tokens look it up, and a rule holds if the page has
    all of its tokens.  The best rule by the lower bound of its confidence, support, tokens gives the verdict where no explicit rule fits; ``mined``
    names its tokens."""
    page = pages.select(*[c.alias(f"__k{i}") for i, c in enumerate(keep)], F.col("url").alias("__url"), F.monotonically_increasing_id().alias("__row"))
    page = page.withColumn("__host", host_of(F.col("__url"))).withColumn("__path", path_of(F.col("__url")))
    page = page.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))
    kept = [f"__k{i}" for i in range(len(keep))]
    fits = page.where(F.col("__rule").isNotNull()).select(*kept, "__host", "__path", F.col("__rule.rule").alias("__r"), F.col("__rule.verdict").alias("__v"), F.lit(None).cast("string").alias("__m"))
    index = mined.select(F.col("key").alias("__token"), F.col("tokens").alias("__all"), F.struct("sure", "support", "tokens", "verdict").alias("__best"))
    rest = page.where(F.col("__rule").isNull()).withColumn("__tokens", tokens_of(F.col("__host"), F.col("__path")))
    tried = (
        rest.withColumn("__token", F.explode_outer("__tokens")).join(small(index, INDEX_ROWS), "__token", "left")
        .withColumn("__best", F.when(F.size(F.array_except("__all", "__tokens")) == 0, F.col("__best")))
        .groupBy("__row").agg(*[F.first(c).alias(c) for c in [*kept, "__host", "__path"]], F.max("__best").alias("__best"))
        .select(*kept, "__host", "__path", F.lit(None).cast("string").alias("__r"), F.coalesce("__best.verdict", F.lit(default)).alias("__v"), F.array_join("__best.tokens", " + ").alias("__m"))
    )
    out = fits.unionByName(tried)
    names = pages.select(*keep).columns
    return out.select(*[F.col(k).alias(n) for k, n in zip(kept, names, strict=True)], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__r").alias("rule"), F.col("__v").alias("verdict"), F.col("__m").alias("mined"))
