"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, contamination, quality, simhash, suffix_dedup
from cohortlens.llm.common import table
from cohortlens.session import pin

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on what is here, scores at least 0.3."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), least=0.3)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id.

    Of rows that share that id the one whose text, then other columns, sort first; a group of null ids
    keeps one row in the same way.
    """
    return simhash.keep_representatives(docs.select(*COLUMNS), shingle=4, distance=4)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the characters whose bytes all lie in strings of 100 bytes that start earlier.

    A character of which a byte is left stays, so that texts remain valid; a document of which nothing is left goes.
    ``n_chars`` is counted anew.
    """
    docs = docs.select(*COLUMNS)
    found = suffix_dedup.remove_repeats(docs, length=100, carry=("lang", "source"), whole_characters=True)
    left = found.select("id", F.col("kept").cast("string").alias("text"), "lang", "source", "n_bytes")
    return left.where("text <> '' OR n_bytes = 0").select(
        F.col("id").alias("doc_id"), "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars")
    )


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return contamination.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_decode(docs, path, outputs=("ids", "n_tokens")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", remove_repeated_strings),
    ("benchmark_decontamination", keep_uncontaminated),
    ("bpe_encoding", tokenize),
]

#: No stage of this pipeline but the last cut can be said in SQL; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
