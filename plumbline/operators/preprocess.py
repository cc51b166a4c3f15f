"""Raw news to processed news, and the ingest gates before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx

LEAST_TOKENS = 50


def ingest_outcome(batch: DataFrame, known: DataFrame) -> DataFrame:
    """batch with outcome: incomplete (no title or content), duplicate (source and url known, or earlier in the batch), else saved."""
    d = batch.withColumn("_t", tx.collapse(F.col("title_raw"))).withColumn("_c", tx.collapse(F.col("content_raw")))
    whole = F.col("_t").isNotNull() & F.col("_c").isNotNull()
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("source_id", "original_url", whole).orderBy("news_raw_id")))
    seen = known.select("source_id", "original_url").distinct().withColumn("_known", F.lit(True))
    d = d.join(seen, ["source_id", "original_url"], "left")
    return d.withColumn("outcome", F.when(~whole, "incomplete").when(F.col("_known") | (F.col("_n") > 1), "duplicate").otherwise("saved")).drop("_t", "_c", "_n", "_known")


def preprocess(raw: DataFrame) -> DataFrame:
    """raw news with clean_text, language, token_count, status and raw_status: texts below the least tokens are errors."""
    d = raw.withColumn("clean_text", tx.clean_text(tx.raw_text(F.col("title_raw"), F.col("content_raw"))))
    d = d.withColumn("language", tx.detect_language(F.col("clean_text"))).withColumn("token_count", tx.count_tokens(F.col("clean_text")))
    ok = F.col("token_count") >= LEAST_TOKENS
    return d.withColumn("status", F.when(ok, "ok").otherwise("error")).withColumn("raw_status", F.when(ok, "processed").otherwise("rejected"))


def processable() -> Column:
    return (F.length(F.trim(F.coalesce("clean_text", F.lit("")))) > 0) & (F.col("token_count") >= LEAST_TOKENS)


def merge(old: DataFrame, new: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """Upsert: rows of new replace those of old with equal keys; of several new rows the one with the greatest `latest` wins."""
    if latest:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(latest)))).where("_n = 1").drop("_n")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def seed_sources(known: DataFrame) -> DataFrame:
    """known sources and the default ones whose names they lack."""
    from ..functions.lexicon import DEFAULT_SOURCES

    spark = known.sparkSession
    default = spark.createDataFrame(DEFAULT_SOURCES, "name string, base_url string").withColumn("type", F.lit("web")).withColumn("is_active", F.lit(True))
    return known.unionByName(default.join(known.select("name"), "name", "left_anti"), allowMissingColumns=True)
