"""File sources and sinks of the dataset tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIMS = "id string, claim_text string, label string, verdict_raw string, url string, source string, date string"


def read_claims_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of JSON lines; only rows labelled true or false."""
    return spark.read.schema(CLAIMS).json(list(paths)).where(F.col("label").isin("true", "false"))


def read_liar_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated rows (id, label, text, ...); short rows and empty texts are left out."""
    d = spark.read.csv(path, sep="\t", schema="id string, label string, claim_text string, source string, url string, verdict_raw string, date string", quote="")
    return d.where(F.length(F.trim(F.coalesce("claim_text", F.lit("")))) > 0)


def read_table(spark: SparkSession, path: str, text: str, least: int = 0, limit: int = 0) -> DataFrame:
    """CSV or JSON lines by suffix, with at least so many characters of text."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"') if path.endswith(".csv") else spark.read.json(path)
    d = d.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= least)
    return d.limit(limit) if limit else d


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path).select(F.trim("value").alias("url"))
    return d.where("url <> '' and not startswith(url, '#')")


def write_claims_tsv(rows: DataFrame, path: str) -> None:
    rows.select("id", "label", "claim_text", "source", "url", "verdict_raw", "date").write.csv(path, sep="\t", mode="overwrite", quote="")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path, mode="overwrite", ignoreNullFields=False)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, mode="overwrite", escape='"')


def best_checkpoint(spark: SparkSession, pattern: str) -> DataFrame:
    """The serving config of greatest validation macro F1, the newest of equals."""
    d = spark.read.option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
    return d.agg(F.max_by(F.struct("path", "model_name"), F.struct("validation_metrics.macro_f1", "at")).alias("b")).select("b.*")
