"""From raw documents to token ids: quality, toxicity, near duplicates, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  The first four return documents with
their columns as they came; the last returns doc_id, ids, n_tokens and lossless.  A stage fits its classifier, if it has
one, on labelled documents among its own input.

Defined results: documents with null or empty text are judged like any others and have no ids at the end; a document
without labels is only scored; without any label to learn from, no document counts as toxic; rows that share an id count as one document for near duplicates, and one of them stays; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, ngram_join, pieces, quality, toxicity
from graphloom.llm.common import read, stage
from graphloom.staging import free, owned


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accept(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity of at least 0.8; the smallest id of each component stays."""
    return ngram_join.one_of_each(docs, n=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter one, go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_column(docs, ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("sentencepiece", encode)]

#: SQL cannot express the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others staged on the way is freed once their result is."""
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        with owned() as passing:
            out = step(spark, docs, sf_dir)
        docs = stage(out)
        free(passing)
    return STAGES[-1][1](spark, docs, sf_dir)
