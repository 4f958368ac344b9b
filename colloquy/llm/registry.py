"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, langid, licenses, lloyd, lmscore, mixing, nearest, neardup, oracles, quality, simhash, toxicity, variants
from .common import fold, read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"), words=3, percent=85)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.fit(documents))
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.groups(read(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings")).drop("cluster_size")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_nearest": op2_nearest,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_lmscore": op7_lmscore,
    "op8_html": op8_html,
    "op9_neardup": op9_neardup,
    "op10_langid": op10_langid,
    "op11_simhash": op11_simhash,
    "op12_variants": op12_variants,
    "op13_clusters": op13_clusters,
}
ORACLE_SQL = {
    "op2_nearest": oracles.nearest(),
    "op5_licenses": oracles.licenses(),
    "op9_neardup": oracles.neardup(),
    "op12_variants": oracles.variants(),
    "op13_clusters": oracles.clusters(),
}
