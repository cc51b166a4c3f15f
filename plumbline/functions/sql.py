"""SQL names for the kernels: temporary functions written in SQL, so that Catalyst sees through them, and views for what gives rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as lx


def _clean(raw: str) -> str:
    for pattern in (r"<[^>]+>", r"(?U)https?://\\S+|www\\.\\S+", r"(?U)[@#]\\w+", r"(?U)[^\\w\\s.,;:!?áéíóúÁÉÍÓÚñÑ-]", r"(?U)\\s+"):
        raw = f"regexp_replace({raw}, '{pattern}', ' ')"
    return f"trim({raw})"


def _present(markers: list[str]) -> str:
    return " + ".join(f"cast(contains(concat(' ', lower(s), ' '), '{m}') as int)" for m in markers)


_FUNCTIONS = {
    "jaccard": ("a array<string>, b array<string>", "double", "case when size(a) = 0 or size(b) = 0 then 0.0 else size(array_intersect(a, b)) / size(array_union(a, b)) end"),
    "overlap": ("a array<string>, b array<string>", "double", "case when size(a) = 0 or size(b) = 0 then 0.0 else size(array_intersect(a, b)) / least(size(array_distinct(a)), size(array_distinct(b))) end"),
    "collapse": ("s string", "string", r"nullif(trim(regexp_replace(s, '(?U)\\s+', ' ')), '')"),
    "count_tokens": ("s string", "int", "size(filter(split(s, ' '), w -> w <> ''))"),
    "clean_text": ("s string", "string", _clean("coalesce(s, '')")),
    "detect_lang": ("s string", "string", f"case when {_present(lx.SPANISH_MARKERS)} >= 2 then 'es' when {_present(lx.ENGLISH_MARKERS)} >= 2 then 'en' when trim(s) <> '' then 'unknown' else 'empty' end"),
    "triage": ("risk double", "string", "case when risk >= 0.75 then 'likely_fake' when risk <= 0.35 then 'likely_real' else 'indeterminate' end"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; returns their names."""
    from ..operators.metrics import lcs_f1

    for name, (args, kind, body) in _FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")

    def rouge(candidate: pd.Series, reference: pd.Series) -> pd.Series:
        tokens = lambda t: re.findall(r"\w+", (t or "").lower())
        return pd.Series([lcs_f1(tokens(a), tokens(b)) for a, b in zip(candidate, reference)], dtype="float64")

    # Arrow batches: a subsequence is no expression of the engine's own
    spark.udf.register("rouge_l", F.pandas_udf(rouge, "double"))
    return [*_FUNCTIONS, "rouge_l"]


def claims_view(spark: SparkSession, articles: str, name: str) -> DataFrame:
    """A temporary view of the claims of a view or table of articles (doc_id, title, body), at most three each."""
    from ..operators.claims import extract_claims

    found = extract_claims(spark.table(articles))
    found.createOrReplaceTempView(name)
    return found
