"""A training corpus in five stages: toxicity, quality, near-duplicates, benchmark leaks, mix.

Each stage works on all that the one before kept, written as Parquet and read
again, and returns the columns of documents.  The models are fitted on the
labelled rows of the stage's own input.  A stage's table goes as soon as the
next one is written, the last one with the application.

Null texts are ordinary empty texts; rows without an id go through every stage
(near-duplicates keep them all); repeated rows are copies, one of which stays;
an empty table stays empty; further columns of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontaminate, mixing, neardup, quality, toxicity
from colloquy.llm.common import read, remove, scratch


def toxic_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, read(spark, sf_dir, "labels"))


def poor_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, words=5, percent=80)


def leaks_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("toxicity", toxic_gone),
    ("quality", poor_gone),
    ("neardup", one_of_each_group),
    ("decontamination", leaks_gone),
    ("mixing", mixed),
]
#: Models and sketches aren't SQL: each stage is tested against a plain version of its operator instead (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import colloquy

    colloquy.ship(spark)
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
