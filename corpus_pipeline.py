"""A training corpus from `documents`: quality rules, one of each group of near copies, surrogates for personal data, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, mixing, packing, pii, quality
from plumbline.llm.common import cut, read_documents

SHINGLE_WORDS, SIMILARITY = 5, 80


def _apart(docs: DataFrame, added: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs) with the columns of docs; those that the step's own columns clash with have other names in it."""
    own = {c: f"_own_{c}" for c in docs.columns if c in added}
    return step(docs.withColumnsRenamed(own)).select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled rules; thresholds come from this stage's own documents.

    Null, empty and short texts fail the base rule and go; repeated rows are judged alike; documents without a label are judged, too; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _apart(docs, quality.ADDED, lambda d: quality.judge(d, labels).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of documents that share 80% of their five-word shingles.

    Null and empty texts are no copies of others; of equal rows one stays; rows without a doc_id are compared with each other alone; an empty table stays empty."""
    return jaccard_join.one_of_each(docs, SIMILARITY, SHINGLE_WORDS)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data.

    Null and empty texts stay as they are; repeated rows get the same surrogates; an empty table stays empty."""
    return _apart(docs, ("n_entities",), pii.pseudonymise)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in slot order: a document once for each pass over its source, or the part of it that the pass takes.

    Null and empty texts have no words and are in no pass; a null source is a source of its own; equal rows are taken each; an empty table gives an empty mix."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their ids and places, read from packed sequences of 2048 tokens.

    Null and empty texts are their end id alone; equal rows are packed each; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("quality rules", keep_quality), ("n-gram Jaccard join", drop_near_copies), ("PII surrogates", hide_persons), ("mixing", mix_sources), ("packing", pack_sequences)]

#: No SQL says binomial bounds, surrogates or column generation; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
