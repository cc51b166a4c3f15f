"""Cached reports: a table with the time of each, a time to live, and a greatest size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .preprocess import merge

TTL, SIZE = 3600, 1000


def alive(cache: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    return cache.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros("generated_at") < ttl * 1_000_000)


def lookup(cache: DataFrame, wanted: DataFrame, now: Column, ttl: int = TTL) -> tuple[DataFrame, DataFrame]:
    """Hits (prediction_id, report, generated_at) of wanted ids, and the ids that are missing or too old."""
    young = alive(cache, now, ttl)
    keys = wanted.select("prediction_id").distinct()
    return young.join(keys, "prediction_id", "left_semi"), keys.join(young, "prediction_id", "left_anti")


def put(cache: DataFrame, reports: DataFrame, now: Column, ttl: int = TTL, size: int = SIZE) -> DataFrame:
    """The cache with new reports (prediction_id, report): old entries go, then the oldest beyond the greatest size."""
    made = reports.select("prediction_id", "report", now.alias("generated_at"))
    return merge(alive(cache, now, ttl), made, ["prediction_id"]).orderBy(F.desc("generated_at"), F.desc("prediction_id")).limit(size)


def replay(calls: DataFrame, ttl: int = TTL, size: int = SIZE) -> DataFrame:
    """calls (service, key, at) with hit: whether the service's cache had the key. An entry lives ttl seconds from the miss that made it; beyond `size` the entry that was made first goes.

    A cache is sequential: each service's calls are replayed in order of time, streamed, with at most `size` entries held."""

    seconds = calls.select("service", "key", (F.unix_micros(F.col("at").cast("timestamp")) / 1e6).alias("at"))

    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            hits = []
            for service, key, at in zip(batch["service"], batch["key"], batch["at"]):
                own = held.setdefault(service, {})
                while own and at - next(iter(own.values())) >= ttl:
                    own.pop(next(iter(own)))
                hits.append(key in own)
                if key not in own:
                    if len(own) >= size:
                        own.pop(next(iter(own)))
                    own[key] = at
                if len(held) > 1:  # calls are sorted by service: others are done
                    held = {service: own}
            yield batch.assign(hit=hits)

    return seconds.repartition("service").sortWithinPartitions("service", "at", "key").mapInPandas(partition, "service string, key string, at double, hit boolean")


def stats(replayed: DataFrame) -> DataFrame:
    """hits, misses and the hit rate as a percentage."""
    d = replayed.agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return d.withColumn("hit_rate", F.format_string("%.2f%%", F.when(total > 0, 100.0 * F.col("hits") / total).otherwise(0.0)))
