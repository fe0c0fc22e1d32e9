"""The thin ``opN_<name>`` queries over the operators of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, decontaminate, divergence, licences, lm, merkle, ngram_join, pieces, quality, tokenfile, topk, toxicity, urls
from .common import ascii_lower, ascii_lower_sql, fold, read, staged_path

#: The explicit URL rules.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Host words of a small hand-made block list; URLs with them are labelled "block" for the miner.
URL_SEEDS = ["casino", "bets", "pills", "spam", "ads", "adult"]
#: The added conversation.
HARD_ID, HARD_TEXT = -7, "\\### Assistant: </turn> ok"
#: What a leaf of the manifest hashes, in this order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    found = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels), ["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels), ["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), n=4, num=85, den=100)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = decontaminate.counts(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_column(docs, ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = staged_path(spark)
    tokenfile.write(read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.digests(spark, path)


def url_labels(pages: DataFrame) -> DataFrame:
    """(url, tokens, label) of the part of ``pages`` to learn from: crc32(url) mod 4 is not 0.

    A host with a word of the block list is labelled "block", other pages by their content; the explicit rules, which decide
    their pages themselves, say nothing of others."""
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    seeded = F.when(F.arrays_overlap(F.split(host, r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, URL_SEEDS))), F.lit("block"))
    return pages.where(F.col("url").isNotNull() & (fold(F.col("url"), 4) != 0)).select("url", urls.tokens_of(host, path).alias("tokens"), F.coalesce(seeded, urls.page_label(F.col("html"))).alias("label"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    mined = urls.mine(url_labels(pages), min_support=0.001, min_confidence=0.85, least_urls=5)
    return urls.judge(pages.select("page_id", "url"), URL_RULES, mined, [F.col("page_id")])


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = licences.near(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return licences.scan(docs, licences.train(docs), ["doc_id"])


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(1).select(F.lit(HARD_ID).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(HARD_TEXT).alias("text"))
    return chat.digests(chat.expand(turns.unionByName(hard)))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    model = lm.train(docs, ~held)
    found = lm.score(docs, model, ["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*LEAF)
    text = F.when(fold(F.col("doc_id"), 3) == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    rows = merkle.manifest(docs, LEAF, "lang", "doc_id", altered=F.struct(*LEAF[:-1], text.alias("text")))
    folded = merkle.fold(F.col("other_leaf"), F.col("steps"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


WORDS_SQL = f"regexp_extract_all({ascii_lower_sql("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
     b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
             FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
     lens AS (SELECT DISTINCT l FROM win),
     grams AS (SELECT r, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS t
               FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
     hit AS (SELECT g.r, g.i, g.l, win.item_id FROM grams g JOIN win ON g.l = win.l AND g.t = win.t),
     pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
     its AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, pos.n IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

NGRAM_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ascii_lower_sql("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     g AS MATERIALIZED (SELECT DISTINCT r, doc_id, hash(array_to_string(list_slice(w, i, i + least(len(w), 4) - 1), ' '), least(len(w), 4)) AS g
           FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
     n AS MATERIALIZED (SELECT r, doc_id, count(*) AS n FROM g GROUP BY r, doc_id),
     p AS (SELECT a.r AS x, b.r AS y, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
     l AS MATERIALIZED (SELECT DISTINCT m.doc_id AS x, o.doc_id AS y FROM p JOIN n m ON p.x = m.r JOIN n o ON p.y = o.r WHERE 100 * s >= 85 * (m.n + o.n - s)),
     c AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT l.y, c.c FROM c JOIN l ON l.x = c.id WHERE c.c < l.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT id, min(c) AS c FROM c GROUP BY id) m ON m.id = d.doc_id
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

CHAT_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES ({HARD_ID}, 0, 'user', '{HARD_TEXT}'), ({HARD_ID}, 1, 'assistant', '{HARD_TEXT}'))),
     e AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS apart, length(role) + length(text) + 16
                  + length(role || text) - length(replace(replace(replace(role || text, chr(92), ''), '<', ''), '>', '')) AS n FROM t),
     w AS (SELECT *, sum(n) OVER o AS upto, row_number() OVER (PARTITION BY conv_id, apart ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
           FROM e WINDOW o AS (PARTITION BY conv_id, apart ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id, apart
"""


_SHARE = "1 + 1000000000 * ({} + 1) // ({} + {})"
DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {ascii_lower_sql("coalesce(text, '')")} AS text FROM documents),
     w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
     kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
     c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
     langs AS (SELECT lang, sum(n)::BIGINT AS total, count(*) AS kinds FROM kept GROUP BY lang),
     g AS MATERIALIZED (SELECT g.lang, g.source, coalesce(s.total, 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) s USING (lang, source)),
     p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format('coalesce(c.n, 0)', 'g.total', 'l.kinds')} AS p
           FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     every AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
     terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM (SELECT p.*, {_SHARE.format('k.n', 'l.total', 'l.kinds')} AS q FROM p JOIN kept k USING (lang, term) JOIN langs l USING (lang)) x WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM every
UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms QUALIFY rank <= 200
"""


def _spelled(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, coalesce('=' || lang, '-') AS tree, {ascii_lower_sql('text')} AS small,
            list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: CASE WHEN c = '' THEN []::BIGINT[] ELSE list_prepend(unicode(c)::BIGINT, list_resize([]::BIGINT[], 8, -1)) END))),
                lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END) AS crc FROM documents),
     e AS (SELECT r, doc_id, tree, {_spelled('doc_id')} || {_spelled('source')} || {_spelled('lang')} || {_spelled('n_chars')} AS head, text, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN small ELSE text END AS other FROM d),
     leaves AS (SELECT r, doc_id, tree, sha256(head || {_spelled('text')}) AS leaf, sha256(head || {_spelled('other')}) AS changed FROM e),
     l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
     lv AS (SELECT tree, 0 AS k, place, size, leaf AS h FROM l
            UNION ALL SELECT tree, k + 1, place // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM lv WHERE size > 1 GROUP BY tree, k, place // 8, size),
     subs AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM lv WHERE size = 1),
     tv AS (SELECT 0 AS k, place, size, h FROM subs
            UNION ALL SELECT k + 1, place // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM tv WHERE size > 1 GROUP BY k, place // 8, size),
     runs AS MATERIALIZED (SELECT tree, k, place // 8 AS up, list(h ORDER BY place) AS hs FROM lv WHERE size > 1 GROUP BY ALL),
     truns AS MATERIALIZED (SELECT k, place // 8 AS up, list(h ORDER BY place) AS hs FROM tv WHERE size > 1 GROUP BY ALL),
     p AS (SELECT r, tree, 0 AS k, place, size, changed AS f, '' AS proof FROM l
           UNION ALL SELECT r, tree, k + 1, place // 8, (size + 7) // 8, sha256(before || f || after), proof || before || after
           FROM (SELECT p.*, array_to_string(hs[:place % 8], '') AS before, array_to_string(hs[place % 8 + 2:], '') AS after FROM p JOIN runs USING (tree, k) WHERE p.size > 1 AND runs.up = p.place // 8)),
     t AS (SELECT r, 0 AS k, subs.place, subs.size, f, proof, subs.h AS subroot FROM p JOIN subs USING (tree) WHERE p.size = 1
           UNION ALL SELECT r, k + 1, place // 8, (size + 7) // 8, sha256(before || f || after), proof || before || after, subroot
           FROM (SELECT t.*, array_to_string(hs[:place % 8], '') AS before, array_to_string(hs[place % 8 + 2:], '') AS after FROM t JOIN truns USING (k) WHERE t.size > 1 AND truns.up = t.place // 8))
SELECT doc_id, leaf, subroot, tv.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = tv.h AS verified
FROM t JOIN l USING (r), tv WHERE t.size = 1 AND tv.size = 1
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_ngram_join, op3_decontamination, op4_sentencepiece, op5_token_files, op6_url_filters, op7_toxicity, op8_licence_scan, op9_exact_topk, op10_chat_formatting, op11_lm_scores, op12_source_divergence, op13_merkle_manifest)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": NGRAM_SQL, "op3_decontamination": DECONTAMINATION_SQL, "op9_exact_topk": TOPK_SQL, "op10_chat_formatting": CHAT_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_merkle_manifest": MERKLE_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
