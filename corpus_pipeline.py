"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
SQL cannot express the SimHash, the forest or the packing, so there is no ORACLE_SQL; tests/llm checks
the stages on planted cases, and each operator against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import common, packing, quality_rules, secret_scan, simhash_dedup, substring_dedup

ORACLE_SQL = None


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with the columns of docs; n_chars follows the text where it is a column."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    packed = common.ship(spark) and docs.select(F.struct(*docs.columns).alias("_doc"))
    rows = packed.select("_doc", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.lang").alias("stratum"), F.col("_doc.text").alias("text"))
    judged = quality_rules.judge(common.cut(quality_rules.with_features(rows).drop("text")), common.table(spark, sf_dir, "labels"))
    return judged.where("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (of repeated rows, each stays)."""
    common.ship(spark)
    groups = simhash_dedup.near_duplicates(docs)
    gone = groups.where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == F.col("_gone"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; a text of which nothing stays goes."""
    common.ship(spark)
    found = substring_dedup.shared_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = docs.join(found.withColumnRenamed("doc", "_doc").withColumnRenamed("starts", "_starts"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    touched = out.where("_starts is not null")
    cleaned = substring_dedup.strip_passages(touched, "text", "_starts").where("text != ''").drop("_starts")
    return _like(out.where("_starts is null").drop("_starts").unionByName(cleaned), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked."""
    return _like(secret_scan.redact(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    common.ship(spark)
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = common.cut(docs) if i < len(STAGES) - 1 else docs
        common.drop(before)  # packing, too, has read all it needs by now
    return docs
