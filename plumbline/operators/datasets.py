"""Dataset preparation: dedupe, splits and balance. Shuffles are the order of md5(seed|id), the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .metrics import running_sums


def shuffled(id_: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id_.cast("string")).cast("binary"))


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def stratified_split(rows: DataFrame, train: float = 0.8, validation: float = 0.1, most: float = 0.0, seed: int = 42) -> DataFrame:
    """rows (id, label) with split: by place in the shuffled order within the label; majorities cut to floor(least count * most) where most is above 0."""
    w = W.partitionBy("label").orderBy(shuffled(F.col("id"), seed))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    d = rows.withColumn("r", F.row_number().over(w) - 1).join(counts, "label")
    if most > 0:
        least = counts.agg(F.floor(F.min("n") * most).alias("cap"))
        d = d.join(F.broadcast(least)).withColumn("n", F.least("n", "cap")).where("r < n").drop("cap")  # one row
    first, second = F.floor(F.col("n") * train), F.floor(F.col("n") * validation)
    return d.withColumn("split", F.when(F.col("r") < first, "train").when(F.col("r") < first + second, "validation").otherwise("test")).drop("r", "n")


def plain_split(rows: DataFrame, train: float = 0.8, validation: float = 0.1, seed: int = 42) -> DataFrame:
    return stratified_split(rows.withColumn("label", F.lit("")), train, validation, 0.0, seed).drop("label")


def grouped_split(rows: DataFrame, group: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with split: whole groups in shuffled order go to validation until it has round(rows * share) rows."""
    order = shuffled(F.col(group), seed)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("c")).withColumn("o", order).withColumn("k", F.substring("o", 1, 3))
    total = sizes.agg(F.bround(F.sum("c") * share).alias("target"))
    placed = running_sums(sizes, "k", ["o"], ["c"]).withColumn("before", F.col("c_le") - F.col("c")).join(F.broadcast(total))  # one row
    return rows.join(placed.select(group, F.when(F.col("before") < F.col("target"), "validation").otherwise("train").alias("split")), group)
