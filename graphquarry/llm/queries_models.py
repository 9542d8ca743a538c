"""Queries of the operators with fitted models. SQL can't express them: they are tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, site_quality, toxicity
from .common import documents


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return site_quality.classify(docs, site_quality.fit(docs, labels), F.col("source"), F.col("lang"))


QUERIES = {"op4_language_id": op4_language_id, "op5_toxicity": op5_toxicity, "op10_site_quality": op10_site_quality}
ORACLES: dict[str, str] = {}
