"""The corpus pipeline: five stages over the documents, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All stages but the last return the
columns of ``documents``; a stage that changes texts brings n_chars up to date.

A task that reads or writes Parquet holds a whole row group of texts.  Spark's own 128 MB for
each of a machine's tasks, once read and once written, are more than a small heap, so
every stage has the session write row groups of ROW_GROUP bytes, unless it was given a size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import crf, neardup, packing, rules, substring

#: SQL can't express the trained, iterative and tokenising stages.
ORACLE_SQL = None

SHINGLE_WORDS = 5
SIMILARITY = 0.8
REPEAT_WINDOW = 35
SEQUENCE = 2048
#: Bytes of a Parquet row group in the files of stages.
ROW_GROUP = 4 << 20


def small_row_groups(spark: SparkSession) -> None:
    """Parquet that the session writes from now on has row groups of ROW_GROUP bytes, whoever writes it; a size that was set stays."""
    name = "parquet.block.size"
    if spark.conf.get(name, None) is None and spark.sparkContext._jsc.hadoopConfiguration().get(name) is None:
        spark.conf.set(name, str(ROW_GROUP))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed votes of the rules reject go."""
    small_row_groups(spark)
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    small_row_groups(spark)
    model = crf.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id."""
    small_row_groups(spark)
    return neardup.keep_one(docs, words=SHINGLE_WORDS, similarity=SIMILARITY)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; documents stay."""
    small_row_groups(spark)
    done = substring.remove_repeats(docs, window=REPEAT_WINDOW)
    changed = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    small_row_groups(spark)
    return packing.best_fit(docs, "byte_bpe_50k.json", SEQUENCE)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written in the session's shared folder and read again.

    A stage's files go as soon as the next stage is written; those that the result reads stay.
    """
    from quillspark.llm.common import remove_folder, shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        if k:
            remove_folder(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
