"""A training-data pipeline over documents: five operators, each working on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, exact_dedup, language_id, simhash
from millrace.session import settle_table, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, empty and letterless texts. Each row is judged by itself.

    Repeated rows stay or go together; an empty table gives none.
    """
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays: the one with the most code points, then the smallest doc_id (null last), then the first by all columns as JSON.

    Null counts as empty, and empty texts are equal; of repeated rows one stays; an empty table gives none.
    """
    return exact_dedup.keep_best(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id (null last) stays.

    Null counts as empty; texts without words have fingerprint zero and link like others; repeated
    rows stay or go together; an empty table gives none.
    """
    return simhash.keep_first(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; items of one or two words are no passages.

    Null texts and items hold none; repeated rows stay or go together; an empty table gives none.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of what is left; no ids for null and empty texts, a row for each repeated row."""
    return bpe.encode(docs, TOKENIZER)


STAGES = [
    ("language", identify_language),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("benchmark", drop_benchmark_passages),
    ("tokens", encode),
]

#: Fingerprints, classifiers and byte pairs are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
