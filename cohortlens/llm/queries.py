"""The registered queries of the operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    bpe,
    chat,
    contamination,
    edit_fingerprints,
    embedding_dedup,
    hard_negatives,
    licenses,
    quality,
    sharding,
    simhash,
    spelling,
    suffix_dedup,
    warc,
)
from cohortlens.llm.common import table
from cohortlens.session import pin

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@_query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@_query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@_query("op6_bpe_tree_concatenation")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), outputs=("n_tokens", "shown", "decoded")
    )
    return coded.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("shown", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op5_quality_pu_learning")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@_query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query("op7_template_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@_query("op4_balanced_label_propagation")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query("op1_warc_zip_records")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_archives(table(spark, sf_dir, "pages"), warc.new_folder(spark))
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.read_records(warc.read_index(packages), fields)


@_query("op8_perspective_rotation", chat.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@_query("op9_license_digests", licenses.sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("digest").alias("canonical_sha256"), "license_id")


@_query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@_query("op12_edit_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edit_fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return edit_fingerprints.near_copies(pin(found)).withColumnsRenamed({"id": "doc_id", "component": "component_id"})


@_query("op13_hard_negatives")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))
