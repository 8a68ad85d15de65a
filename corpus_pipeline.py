"""A training corpus from ``documents``: toxic documents go, one of each group of near duplicates stays,
documents with benchmark passages go, secrets are redacted, and the rest is packed into sequences.

Each stage works on every row its predecessor kept. Rows with a null or empty text and rows with a null doc_id pass all
filters; exact repeats of a row are one document from the second stage on, rows that share a doc_id but not the text are
documents of their own; an empty table gives no row; columns beside doc_id and text are kept as they are, up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codesieve.llm import decontaminate, near_dedup, packing, secret_scan, shared, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the lexicon is learned from labelled documents outside of the held-out third, at most ``toxicity.MOST_ROWS`` of them."""
    return toxicity.clean(docs, toxicity.learn(docs, shared.table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: five-word shingles, similarity 0.8 or more. A row goes for its own text alone."""
    return near_dedup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can't express these stages; tests hold each of them against a plain version on the rows it gets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.staged(stage(spark, docs, sf_dir), name)
    return docs
