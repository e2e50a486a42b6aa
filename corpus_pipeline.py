"""From raw documents to packed training sequences, a stage at a time.

Each stage works on all documents that the one before it kept; its result is written as Parquet in
the shared folder and read again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylattice.llm import decontaminate, near_dedup, packing, quality, toxicity
from studylattice.llm.common import small_batches
from studylattice.session import allow_skewed_joins, fresh_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier finds harmless."""
    return toxicity.harmless_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    allow_skewed_joins(spark)
    small_batches(spark)
    return near_dedup.without_duplicates(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontaminate.without_items(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    small_batches(spark)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_harmless),
    ("near_dedup", keep_one_of_each),
    ("decontamination", keep_clean),
    ("packing", pack),
]

# The classifiers and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on the whole documents table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
