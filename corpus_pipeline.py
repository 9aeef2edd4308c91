"""Corpus cleaning pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their columns, for
the next one; ``run`` writes each stage's result to the shared folder and reads it back.  The last
stage returns the encoded corpus.

1. ``toxicity``: documents scored 0.5 or more by their nearest labelled examples go.
2. ``near_duplicates``: of each group of documents linked by 5-word shingle sets of Jaccard similarity
   0.8 or more the one of the smallest id stays (of rows with that id, the one of the smallest text hash).
3. ``benchmark``: documents that hold a passage of a benchmark item, up to edits, go.
4. ``secrets``: secret spans are replaced by a mark (``n_chars`` follows the text).
5. ``bpe``: documents become token ids and their decoded text.

Every stage judges rows by their own text, so rows without an id, or with one that other texts share, are kept or
rejected like all others, whatever the order of rows.  Null and empty texts stay.  Very long texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensortwin.llm import bpe, decontam, ngram_join, secrets, toxicity
from sensortwin.llm.common import ship, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.representatives(docs, n=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    ship(spark)
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document."""
    coded = bpe.encode(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode),
]
#: Nearest neighbours, edit distance and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
