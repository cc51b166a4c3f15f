"""Runs over stored tables: ingest, preprocessing with logs, clustering, summaries, predictions and publishing, all as table steps."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep, release
from . import analysis, clustering, preprocess, serving, summaries
from .preprocess import merge

READY = ("pending", "failed")
VERSION = "plumbline"


@dataclass(frozen=True)
class Tables:
    """What a run reads, and what it returns after it."""

    news_raw: DataFrame
    news_processed: DataFrame
    cluster_members: DataFrame
    news_clusters: DataFrame
    summaries: DataFrame
    ml_predictions: DataFrame
    news: DataFrame
    processing_logs: DataFrame


def replace_logs(logs: DataFrame, new: DataFrame) -> DataFrame:
    """logs after a stage ran again: earlier ones of the same article and stage go."""
    return logs.join(new.select("news_processed_id", "stage").distinct(), ["news_processed_id", "stage"], "left_anti").unionByName(new, allowMissingColumns=True)


def log(rows: DataFrame, stage: str, status: Column, message: Column, now: Column, version: str = VERSION) -> DataFrame:
    """A log for each row (news_processed_id); long messages and versions are cut as their columns are."""
    return rows.select("news_processed_id", F.lit(stage).alias("stage"), status.alias("status"), F.substring(message, 1, 150).alias("message"), now.alias("created_at"), F.lit(version[:50]).alias("model_version"), F.lit(0).cast("long").alias("execution_time_ms"))


def ingested(sources: DataFrame, items: DataFrame, known: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Raw news of items (source_id, original_url, title_raw, content_raw, author_raw, published_at) of active sources, and the outcomes (source_id, outcome, n): saved, duplicate or incomplete.

    Ids go on after the greatest known one, in order of source and url. A missing address is the source's own; content is one line of text."""
    active = sources.where("is_active").select("source_id", F.col("name").alias("_name"), "base_url")
    d = items.join(F.broadcast(active) if active.limit(10_001).count() <= 10_000 else active, "source_id")
    d = d.withColumn("original_url", F.coalesce("original_url", "base_url")).withColumn("content_raw", preprocess.tx.collapse(F.col("content_raw"))).withColumn("news_raw_id", F.xxhash64("source_id", "original_url", "title_raw", "content_raw"))
    judged = preprocess.ingest_outcome(d, known)
    counts = judged.groupBy("source_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
    saved = judged.where("outcome = 'saved'")
    most = known.agg(F.coalesce(F.max("news_raw_id"), F.lit(0)).alias("_most"))
    keyed = saved.select("source_id", "original_url").withColumn("id", F.struct("source_id", "original_url")).withColumn("rank", F.col("source_id"))
    nth = clustering.ranked(keyed, 1).select("source_id", "original_url", "nth")
    rows = saved.join(nth, ["source_id", "original_url"]).join(F.broadcast(most))  # one row
    out = rows.select(
        (F.col("_most") + F.col("nth")).alias("news_raw_id"), "source_id", F.lit(None).cast("long").alias("log_id"), F.lit("web").alias("platform"), F.substring("_name", 1, 50).alias("source_account"), "original_url",
        "title_raw", "content_raw", "author_raw", "published_at", now.alias("scraped_at"), F.lit("pending").alias("status"),
    )
    return out, counts


def _made(t: Tables, wanted: DataFrame, now: Column) -> DataFrame:
    """Processed rows of the raw rows in wanted (news_raw_id), with raw_status, title_raw and original_url: texts are cleaned once and written, as all later steps read them."""
    raw = t.news_raw.join(wanted.select("news_raw_id").distinct(), "news_raw_id", "left_semi")
    d = preprocess.preprocess(raw.drop("status")).withColumn("news_processed_id", F.col("news_raw_id"))
    made = keep(d.select("news_processed_id", "news_raw_id", "source_id", "clean_text", "language", "token_count", now.alias("processed_at"), "status", "raw_status", "title_raw", "original_url"), "processed")
    release(made.sparkSession)
    return made


def preprocessed(t: Tables, wanted: DataFrame, now: Column) -> Tables:
    """Tables after preprocessing the raw rows in wanted (news_raw_id): processed rows are made or replaced under the raw row's id, raw rows get their status, and each a log."""
    return _with_made(t, _made(t, wanted, now), now)


def _with_made(t: Tables, d: DataFrame, now: Column) -> Tables:
    rows = d.drop("raw_status", "title_raw", "original_url")
    status = d.select("news_raw_id", F.col("raw_status").alias("_s"))
    marked = t.news_raw.join(status, "news_raw_id", "left").withColumn("status", F.coalesce("_s", "status")).select(*t.news_raw.columns)
    ok = F.col("status") == "ok"
    logs = log(rows, "preprocessing", F.when(ok, "success").otherwise("failed"), F.when(ok, F.format_string("Texto limpio con %d tokens.", "token_count")).otherwise(F.format_string("Texto con %d tokens, menos del minimo.", "token_count")), now)
    return replace(t, news_raw=marked, news_processed=merge(t.news_processed, rows, ["news_raw_id"]), processing_logs=replace_logs(t.processing_logs, logs))


def articles(t: Tables, made: DataFrame | None = None) -> DataFrame:
    """Processed articles as clustering takes them, ranked by the time of their processing.

    made: processed rows with title_raw that replace those in t, so that their texts meet no other table."""
    if made is not None and t.news_processed.isEmpty():
        p = made
    else:
        old = t.news_processed if made is None else t.news_processed.join(made.select("news_raw_id"), "news_raw_id", "left_anti")
        p = old.join(t.news_raw.select("news_raw_id", "title_raw"), "news_raw_id")
        p = p if made is None else p.unionByName(made.select(*p.columns))
    return p.where(F.col("status").isin("ok", "processed")).select(F.col("news_processed_id").alias("id"), F.col("title_raw").alias("title"), F.col("clean_text").alias("text"), "source_id", F.unix_micros(F.col("processed_at").cast("timestamp")).alias("rank"))


def clustered(t: Tables, now: Column, tau: float = clustering.THRESHOLD, source_id: int | None = None, cross_source: bool = True, rows: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """Tables after clustering, and the clusters that it touched. rows: what articles() gives of t, where it is known."""
    rows = articles(t) if rows is None else rows
    every, made, logs = clustering.stage(rows, t.cluster_members, t.news_clusters, tau, source_id, cross_source)
    own = clustering.scoped(rows, source_id, cross_source)
    touched = every.join(own.select(F.col("id").alias("news_processed_id")), "news_processed_id", "left_semi").select("cluster_id").distinct()
    logs = logs.select("*", now.alias("created_at"), F.lit(0).cast("long").alias("execution_time_ms"))
    since = t.news_clusters.select("cluster_id", F.col("created_at").alias("_at"))
    made = made.join(since, "cluster_id", "left").withColumn("created_at", F.coalesce("_at", now)).drop("_at")
    few = own.limit(2).count() < 2
    done = made.limit(0) if few else made.join(touched, "cluster_id", "left_semi")
    return replace(t, cluster_members=every, news_clusters=t.news_clusters if few else made.select(*t.news_clusters.columns), processing_logs=t.processing_logs.unionByName(logs, allowMissingColumns=True)), done


def published(t: Tables, reps: DataFrame, now: Column, settings: analysis.AnalysisSettings = analysis.AnalysisSettings(), force_summary: bool = False, heads: DataFrame | None = None) -> Tables:
    """Tables after summaries, predictions and publishing of the representatives (representative_id). Without a veracity model predictions are left out and all is published the same.

    heads: written rows (news_raw_id, title_raw, original_url) of all that can be published, where they are known, so that raw texts aren't read again."""
    reps = reps.where("representative_id is not null").select("representative_id").distinct()
    p = t.news_processed.select(F.col("news_processed_id").alias("representative_id"), "clean_text", "news_raw_id").join(reps, "representative_id", "left_semi")
    made = p.select(F.col("representative_id").alias("news_processed_id"), summaries.lead_summary(F.col("clean_text")).alias("summary_text"))
    kept = summaries.reuse(t.summaries.withColumnRenamed("representative_id", "news_processed_id").join(made.select("news_processed_id"), "news_processed_id", "left_semi"), made, force_summary)
    fresh = kept.select(F.col("news_processed_id").alias("representative_id"), "summary_text", F.lit("lead").alias("model_version"), now.alias("created_at"))
    every_summary = merge(t.summaries, fresh, ["representative_id"])
    every_prediction = t.ml_predictions
    if settings.veracity is not None:
        rows = p.where(F.coalesce("clean_text", F.lit("")) != "").join(t.news_raw.select("news_raw_id", F.col("title_raw").alias("title")), "news_raw_id").select(F.col("representative_id").alias("doc_id"), "title", F.col("clean_text").alias("content"))
        got = analysis.predictions(analysis.analyze(rows, settings), VERSION).withColumn("created_at", now)
        every_prediction = merge(t.ml_predictions, got.select(*t.ml_predictions.columns), ["representative_id"])
    shown = keep(serving.snapshots(reps, t.news_processed, t.news_raw if heads is None else heads, every_summary, every_prediction), "snapshots")
    release(shown.sparkSession)
    return replace(t, summaries=every_summary, ml_predictions=every_prediction, news=serving.publish(t.news, shown, now))


def run(t: Tables, wanted: DataFrame, now: Column, settings: analysis.AnalysisSettings = analysis.AnalysisSettings(), source_id: int | None = None) -> tuple[Tables, DataFrame]:
    """A whole run over raw rows (news_raw_id): tables after it, and its counters: raw_news_count, processed_count, cluster_count, published_count and published_news_ids (in order)."""
    made = _made(t, wanted, now)
    done, touched = clustered(_with_made(t, made, now), now, source_id=source_id, rows=articles(t, made))
    reps = touched.select("representative_id")
    done = published(done, reps, now, settings, heads=made if t.news_processed.isEmpty() else None)
    raw = wanted.select("news_raw_id").distinct().join(t.news_raw.select("news_raw_id"), "news_raw_id", "left_semi")
    ids = done.news.join(reps.distinct(), "representative_id", "left_semi").select("news_id")
    counters = raw.agg(F.count(F.lit(1)).alias("raw_news_count")).withColumn("processed_count", F.col("raw_news_count"))
    counters = counters.join(touched.agg(F.count(F.lit(1)).alias("cluster_count"))).join(ids.agg(F.count(F.lit(1)).alias("published_count")))  # one row each
    return done, counters


def reprocess(t: Tables, raw_id: int, now: Column, settings: analysis.AnalysisSettings = analysis.AnalysisSettings()) -> tuple[Tables, DataFrame]:
    """A run over one raw row that is known: it is processed again, all touched clusters and its own are finished and published."""
    wanted = t.news_raw.where(F.col("news_raw_id") == raw_id).select("news_raw_id")
    if wanted.isEmpty():
        raise ValueError(f"no raw news {raw_id}")
    made = _made(t, wanted, now)
    done, touched = clustered(_with_made(t, made, now), now, rows=articles(t, made))
    own = done.cluster_members.join(wanted.select(F.col("news_raw_id").alias("news_processed_id")), "news_processed_id", "left_semi").select("cluster_id")
    chosen = done.news_clusters.join(touched.select("cluster_id").union(own).distinct(), "cluster_id", "left_semi")
    done = published(done, chosen.select("representative_id"), now, settings)
    ids = done.news.join(chosen.select("representative_id").distinct(), "representative_id", "left_semi")
    counters = chosen.agg(F.count(F.lit(1)).alias("cluster_count")).join(ids.agg(F.count(F.lit(1)).alias("published_count"))).select(F.lit(raw_id).cast("long").alias("raw_news_id"), "cluster_count", "published_count")  # one row each
    return done, counters


def waiting(raw: DataFrame, source_id: int | None = None) -> DataFrame:
    """Raw rows that a run takes without ingest: pending or failed."""
    return clustering.scoped(raw.where(F.col("status").isin(*READY)), source_id, False).select("news_raw_id")
