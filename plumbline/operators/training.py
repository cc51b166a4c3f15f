"""Around a training run: sample weights, oversampling, early stopping, columns of foreign tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sample_weights(rows: DataFrame, label: str) -> DataFrame:
    """weight = total / rows of the label, from label counts joined back."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    return rows.join(counts, label).join(F.broadcast(total)).withColumn("weight", F.col("_t") / F.col("_c")).drop("_c", "_t")  # one row


def oversample(rows: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """Draws with replacement so that labels come in equal numbers: each row a Poisson number of times by its weight, fixed by the row's hash."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a label
    if not counts:
        return rows
    each = sum(counts.values()) / len(counts)
    out = None
    for i, (name, n) in enumerate(sorted(counts.items(), key=str)):
        part = rows.where(F.col(label).eqNullSafe(F.lit(name))).sample(withReplacement=True, fraction=each / n, seed=seed + i)
        out = part if out is None else out.unionByName(part)
    return out


def early_stop(history: DataFrame, patience: int = 2) -> DataFrame:
    """history (epoch, score): adds best_so_far, since_best and stopped; the best epoch is the first of the greatest score."""
    w = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)  # epochs of one run
    before = F.max("score").over(W.orderBy("epoch").rowsBetween(W.unboundedPreceding, -1))
    d = history.withColumn("better", before.isNull() | (F.col("score") > before))
    d = d.withColumn("best_so_far", F.max("score").over(w)).withColumn("best_epoch", F.max(F.when(F.col("better"), F.col("epoch"))).over(w))
    return d.withColumn("since_best", F.col("epoch") - F.col("best_epoch")).withColumn("stopped", F.max((F.col("since_best") >= patience).cast("int")).over(w) == 1).drop("better")


def guess_column(columns: list[str], preferred: list[str]) -> str | None:
    """An exact name in the order of preference, else the first column that has a preferred name in it."""
    exact = [p for p in preferred if p in columns]
    loose = [c for c in columns if any(p in c.lower() for p in preferred)]
    return next(iter(exact + loose), None)
