"""Dataset and evaluation reports: label counts by file, skip reasons, rejects, per-split metrics as JSON and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from . import metrics

#: Why a page makes no claim.
REASONS = ["fetch_error", "missing_claim", "missing_rating", "meta_explainer", "invalid_rating"]


def labels_by_file(rows: DataFrame, path: str = "path") -> DataFrame:
    """total, true and false of labelled rows for each file; other labels count in the total."""
    d = rows.where(F.coalesce("label", F.lit("")) != "")
    n = lambda x: F.count(F.when(F.col("label") == x, 1)).alias(x)
    return d.groupBy(path).agg(F.count(F.lit(1)).alias("total"), n("true"), n("false"))


def skip_reasons(outcomes: DataFrame) -> DataFrame:
    """Rows for each reason, zeros included; kept ones are no reason."""
    grid = outcomes.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    return grid.join(outcomes.groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "reason", "left").na.fill(0, ["n"])


def rejects(outcomes: DataFrame) -> DataFrame:
    """The rejected rows as their file has them: url, reason, details."""
    slug = F.regexp_extract(F.lower("url"), r"([^/?#]*)(?:[?#].*)?$", 1)
    told = F.when(F.col("reason") == "fetch_error", "Failed to fetch HTML").when(F.col("reason") == "missing_claim", "No claim text found").when(F.col("reason") == "meta_explainer", F.concat(F.lit("Meta/explicador page: "), slug))
    told = told.when(F.col("reason") == "missing_rating", F.concat(F.lit("Claim: "), F.substring("claim", 1, 50), F.lit("..."))).otherwise(F.concat(F.lit("Unsupported rating: "), F.coalesce("rating", F.lit(""))))
    return outcomes.where("reason is not null").select("url", "reason", told.alias("details"))


def claims(outcomes: DataFrame) -> DataFrame:
    """The kept rows as claim records, the first of each normal claim text by page."""
    from .datasets import keep_first
    from ..functions.text import normalized

    kept = keep_first(outcomes.where("reason is null"), normalized(F.col("claim")), "page_id")
    return kept.select(F.concat(F.col("publisher"), F.lit("-"), F.col("page_id").cast("string")).alias("id"), F.col("claim").alias("claim_text"), "label", F.col("rating").alias("verdict_raw"), "url", F.col("publisher").alias("source"), "date")


def liar_examples(rows: DataFrame, strategy: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(examples with a 0/1 label and text; skipped labels with their counts) of rows (label, claim_text)."""
    d = rows.withColumn("_l", lb.liar_label(F.col("label"), strategy))
    skipped = d.where("_l is null").groupBy(F.trim("label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return d.where("_l is not null").withColumn("label", F.col("_l")).drop("_l").where(F.trim(F.coalesce("claim_text", F.lit(""))) != ""), skipped


def numbered(rows: DataFrame, split: str, order: str) -> DataFrame:
    """rows with nth from 1 inside each split, counted in ranges of a hash of the order so that no task has a whole split."""
    from pyspark.sql import Window as W

    key = F.substring(order, 1, 2)
    counts = rows.groupBy(split, key.alias("_k")).agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("_b", F.sum("c").over(W.partitionBy(split).orderBy("_k")) - F.col("c")).drop("c")  # at most 256 rows a split
    d = rows.withColumn("_k", key).withColumn("_r", F.row_number().over(W.partitionBy(split, "_k").orderBy(order)))
    return d.join(before, [split, "_k"]).withColumn("nth", F.col("_r") + F.col("_b")).drop("_k", "_r", "_b")


def split_metrics(rows: DataFrame, labels: list[str]) -> DataFrame:
    """For each split of rows (split, gold, pred) and label: support, precision, recall and F1, with the split's examples, accuracy and macro F1."""
    marks = [F.count(F.when(c, 1)).alias(f"{k}{i}") for i, x in enumerate(labels) for k, c in (("t", (F.col("gold") == x) & (F.col("pred") == x)), ("p", F.col("pred") == x), ("g", F.col("gold") == x))]
    d = rows.groupBy("split").agg(F.count(F.lit(1)).alias("examples"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"), *marks)
    ratio, f1 = metrics.ratio, metrics.f1
    per = [(ratio(F.col(f"t{i}"), F.col(f"p{i}")), ratio(F.col(f"t{i}"), F.col(f"g{i}"))) for i in range(len(labels))]
    macro = sum((f1(p, r) for p, r in per), F.lit(0.0)) / len(labels)
    listed = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"g{i}").alias("support"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")) for i, (x, (p, r)) in enumerate(zip(labels, per))])
    return d.select("split", "examples", "accuracy", macro.alias("macro_f1"), F.explode(listed).alias("x")).select("split", "examples", "accuracy", "macro_f1", "x.*")


def evaluation(rows: DataFrame, labels: list[str], setup: dict) -> dict:
    """The evaluation report of rows (split, gold, pred): setup, and for each split its counts, metrics and confusion matrix. It has a row a split and label."""
    out: dict = {"setup": setup, "splits": {}}
    for r in split_metrics(rows, labels).orderBy("split", "label").collect():
        s = out["splits"].setdefault(r["split"], {"num_examples": r["examples"], "accuracy": r["accuracy"], "macro_f1": r["macro_f1"], "label_counts": {}, "classification_report": {}, "confusion_matrix": [[0] * len(labels) for _ in labels]})
        s["label_counts"][r["label"]] = r["support"]
        s["classification_report"][r["label"]] = {k: r[k] for k in ("precision", "recall", "f1", "support")}
    for r in rows.where(F.col("gold").isin(labels) & F.col("pred").isin(labels)).groupBy("split", "gold", "pred").count().collect():  # at most splits x labels x labels rows
        out["splits"][r["split"]]["confusion_matrix"][labels.index(r["gold"])][labels.index(r["pred"])] = r["count"]
    return out


def markdown(report: dict) -> str:
    lines = ["# Evaluation report", "", "## Setup", "", *(f"- {k}: {v}" for k, v in report["setup"].items()), ""]
    for name, s in report["splits"].items():
        lines += [f"## {name.title()} set", "", f"- examples: {s['num_examples']}", f"- label_counts: {s['label_counts']}", f"- macro_f1: {s['macro_f1']:.4f}", f"- accuracy: {s['accuracy']:.4f}", f"- confusion_matrix: {s['confusion_matrix']}", "", "Per-class metrics", ""]
        lines += [f"- {label}: precision={m['precision']:.4f} recall={m['recall']:.4f} f1={m['f1']:.4f} support={m['support']}" for label, m in s["classification_report"].items()] + [""]
    return "\n".join(lines)


def write_report(report: dict, json_path: str | None = None, markdown_path: str | None = None) -> None:
    for path, text in ((json_path, json.dumps(report, indent=2)), (markdown_path, markdown(report))):
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
