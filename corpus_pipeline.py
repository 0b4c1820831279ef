"""From raw documents to packed training sequences: five stages, each on all its predecessor kept.

1. ``quality``: documents that the quality classifier, trained on all labels, rejects go.
2. ``line_dedup``: a line found in several documents stays in the first; ``n_chars`` follows the text.
3. ``near_duplicates``: of each group of similar documents the one with the smallest id stays.
4. ``decontamination``: documents that hold a passage of a benchmark item go.
5. ``packing``: pieces of token ids with their places in sequences of 2048.

Rows without an id cannot be named in stage 3 and stay; rows equal in id and text are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import decontamination, jaccard_join, line_dedup, packing, quality_model
from plinth.staging import stage

CACHE_PIECES = 80_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.score(docs, trees).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    size = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    stays = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(stays, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
    return named.dropDuplicates(["doc_id", "_text"]).select(*docs.columns).unionAll(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(docs, items).where("n_hit = 0").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A Python worker keeps its table while it serves the other stages, so it is a small one here.
    return packing.pack(docs, cache_pieces=CACHE_PIECES)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", packed),
]

# Trained trees and tokenizers are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
