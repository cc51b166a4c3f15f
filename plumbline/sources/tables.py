"""The news model's tables from the driver's tables: one place for the mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _published() -> Column:
    return F.timestamp_micros((F.lit(1704067200) + F.col("doc_id") * 60) * 1_000_000)


def news_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw news: title is the inferred headline, content the compacted text."""
    d = table(spark, sf_dir, "documents")
    content = tx.compact(F.col("text"))
    return d.select(
        F.col("doc_id").alias("news_raw_id"), F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("source_id"), "source", tx.headline(content).alias("title_raw"), content.alias("content_raw"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("original_url"),
        _published().alias("published_at"), F.lit("pending").alias("status"),
    )


def news_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of raw news as they are, before titles are inferred."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.unix_micros(_published()).alias("rank"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source").distinct()
    return d.select(F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("source_id"), F.col("source").alias("name"), F.concat(F.lit("https://"), "source", F.lit(".example/")).alias("base_url"), F.lit("web").alias("type"), (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 7 != 3).alias("is_active"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a calibration set: gold from quality, and a fixed score that leans with it."""
    risk = F.round(((F.col("doc_id") * 7919) % 1000) / 2000.0 + (1 - F.col("quality")) * 0.5, 4)
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "true").otherwise("false").alias("gold"), risk.alias("risk"))
