"""Summaries: gate, extractive stand-in and reuse, and the merge of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

LEAST_CHARS, SHORT_CHARS = 700, 600


def wants_summary(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= LEAST_CHARS


def lead_summary(text: Column, n: int = 3) -> Column:
    """First sentences of long texts; short ones by their first characters."""
    return F.when(wants_summary(text), F.array_join(F.slice(sentences(text), 1, n), " ")).otherwise(F.substring(text, 1, SHORT_CHARS))


def reuse(existing: DataFrame, made: DataFrame, force: bool = False) -> DataFrame:
    """(news_processed_id, summary_text): an existing summary stays unless it is blank or all are made again."""
    blank = F.coalesce(F.trim("old"), F.lit("")) == ""
    d = made.withColumnRenamed("summary_text", "new").join(existing.select("news_processed_id", F.col("summary_text").alias("old")), "news_processed_id", "full")
    keep = F.lit(False) if force else ~blank
    return d.select("news_processed_id", F.when(keep | F.col("new").isNull(), F.col("old")).otherwise(F.col("new")).alias("summary_text"))


def merge_references(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """candidates (id) with reference: the last of several references for a trimmed id (by row), empty where there is none; flagged outside 50 to 130 words."""
    last = references.select(F.trim("id").alias("k"), "summary", "row").groupBy("k").agg(F.max_by("summary", "row").alias("reference"))
    d = candidates.join(last, F.trim(candidates.id) == last.k, "left").drop("k").withColumn("reference", F.coalesce("reference", F.lit("")))
    words = F.size(F.filter(F.split("reference", r"\s+"), lambda w: w != ""))
    return d.withColumn("words", words).withColumn("in_band", F.col("words").between(50, 130))
