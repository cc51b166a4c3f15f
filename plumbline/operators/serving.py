"""Published news: publishing, feed, details, similar stories, interactions, sources, and the rows that an API shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import isoformat
from .preprocess import merge

HIGH_RISK = 0.80
NEWS = ("news_id", "representative_id", "source_id", "title", "summary", "original_url", "sentiment_label", "sentiment_score", "fake_score", "published_at")
TYPES = ("web", "social", "twitter")


def snapshots(reps: DataFrame, processed: DataFrame, raw: DataFrame, summaries: DataFrame, predictions: DataFrame) -> DataFrame:
    """What is served of each representative (representative_id): title falls back to the text's first 160 characters, the summary to 800; scores without a prediction are null.

    processed: news_processed_id, news_raw_id, source_id, clean_text; raw: news_raw_id, title_raw, original_url; summaries: representative_id, summary_text;
    predictions: representative_id, sentiment_label, sentiment_score, fake_score. A representative without its processed or raw row is left out."""
    # what the fallbacks take of a text, so that the joins don't move whole texts
    text = F.substring(F.coalesce("clean_text", F.lit("")), 1, 800)
    p = processed.select(F.col("news_processed_id").alias("representative_id"), "news_raw_id", "source_id", text.alias("_text"))
    d = reps.select("representative_id").distinct().join(p, "representative_id").join(raw.select("news_raw_id", "title_raw", "original_url"), "news_raw_id")
    d = d.join(summaries.select("representative_id", "summary_text"), "representative_id", "left")
    d = d.join(predictions.select("representative_id", F.coalesce("sentiment_label", F.lit("unknown")).alias("sentiment_label"), "sentiment_score", "fake_score"), "representative_id", "left")
    return d.select(
        "representative_id", "source_id", F.coalesce(F.nullif("title_raw", F.lit("")), F.substring("_text", 1, 160)).alias("title"),
        F.coalesce("summary_text", "_text").alias("summary"), "original_url", "sentiment_label", "sentiment_score", "fake_score",
    )


def _with_snapshots(news: DataFrame, made: DataFrame) -> DataFrame:
    """All rows of news and made, matched by representative: new snapshots replace what was served, but for scores that a new one lacks."""
    old = news.select(*NEWS).withColumn("_old", F.lit(True))
    new = made.withColumn("_new", F.lit(True))
    d = old.alias("o").join(new.alias("n"), F.col("o.representative_id") == F.col("n.representative_id"), "full")
    first = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    served = lambda c: F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return d.select("news_id", first("representative_id"), *(served(c) for c in ("source_id", "title", "summary", "original_url")), *(first(c) for c in ("sentiment_label", "sentiment_score", "fake_score")), "published_at", F.coalesce("_old", F.lit(False)).alias("_old"), F.coalesce("_new", F.lit(False)).alias("_new"))


def publish(news: DataFrame, made: DataFrame, now: Column) -> DataFrame:
    """news after publishing the snapshots: known representatives keep their news_id, new ones get the next ones by representative; all published now."""
    d = _with_snapshots(news, made)
    most = news.agg(F.coalesce(F.max("news_id"), F.lit(0)).alias("_most"))
    fresh = made.join(news.select("representative_id"), "representative_id", "left_anti").select("representative_id")
    # ranks of the new ones alone: running counts over ranges of ids
    size = 1 << 16
    keyed = fresh.withColumn("_k", F.floor(F.col("representative_id") / size))
    before = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("c")).withColumn("_b", F.sum("c").over(W.orderBy("_k")) - F.col("c")).drop("c")  # one row a range
    ranks = keyed.withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy("representative_id"))).join(before, "_k").select("representative_id", (F.col("_r") + F.col("_b")).alias("_rank"))
    d = d.join(ranks, "representative_id", "left").join(F.broadcast(most))  # one row
    return d.withColumn("news_id", F.coalesce("news_id", F.col("_most") + F.col("_rank"))).withColumn("published_at", F.when(F.col("_new"), now).otherwise(F.col("published_at"))).withColumn("fake_score", F.coalesce("fake_score", F.lit(0.0))).withColumn("sentiment_score", F.coalesce("sentiment_score", F.lit(0.0))).select(*NEWS)


def refresh(news: DataFrame, made: DataFrame) -> DataFrame:
    """news with the snapshots of what is served already; news_id and published_at stay."""
    return _with_snapshots(news, made).where("_old").select(*NEWS)


def unpublish(news: DataFrame, ids: DataFrame) -> DataFrame:
    """news of which those in ids (news_id) are no longer published."""
    gone = ids.select("news_id").distinct().withColumn("_gone", F.lit(True))
    return news.join(gone, "news_id", "left").withColumn("published_at", F.when(F.col("_gone").isNull(), F.col("published_at"))).select(*news.columns)


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col(key) == value).limit(1)


def feed(news: DataFrame, page: int = 1, size: int = 10, source_id: int | None = None, sources: DataFrame | None = None, source_name: str | None = None) -> DataFrame:
    """A page of published news, newest first; of one source by id, or by name from sources (source_id, name)."""
    d = news.where("published_at is not null")
    if source_id is not None:
        d = d.where(F.col("source_id") == source_id)
    elif source_name is not None:
        d = d.join(sources.where(F.col("name") == source_name).select("source_id"), "source_id", "left_semi")
    return d.orderBy(F.desc("published_at"), "news_id").offset(max(page - 1, 0) * size).limit(size)


def similar_published(news: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """Up to `most` other published members of each article's cluster, newest first: (news_id, peer, rank).

    The published members of a cluster are ranked once and the first most + 1 kept, so that a cluster's rows meet these alone, not each other."""
    shown = members.join(news.where("published_at is not null").select("news_id", "published_at"), "news_id")
    top = shown.withColumn("place", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("published_at"), "news_id"))).where(F.col("place") <= most + 1)
    pairs = members.join(top.select("cluster_id", F.col("news_id").alias("peer"), "place"), "cluster_id").where("news_id <> peer")
    own = top.select("news_id", "cluster_id", F.col("place").alias("own"))
    rank = F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)
    d = pairs.join(own, ["news_id", "cluster_id"], "left").withColumn("rank", rank)
    return d.where(F.col("rank") <= most).select("news_id", "peer", F.col("rank").cast("int").alias("rank"))


def details(news: DataFrame, members: DataFrame, clusters: DataFrame, most: int = 5) -> DataFrame:
    """Each article with its similar ones (ids, newest first), the cluster that it represents with its score, and whether its risk is high.

    members: news_processed_id, cluster_id; clusters: cluster_id, representative_id, cluster_score."""
    own = members.join(news.select("news_id", F.col("representative_id").alias("news_processed_id")), "news_processed_id").select("news_id", "cluster_id")
    peers = similar_published(news, own, most).groupBy("news_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "peer"))), lambda x: x.peer).alias("similar"))
    led = clusters.groupBy("representative_id").agg(F.min(F.struct("cluster_id", "cluster_score")).alias("c")).select("representative_id", "c.cluster_id", "c.cluster_score")
    d = news.join(peers, "news_id", "left").join(led, "representative_id", "left")
    return d.withColumn("similar", F.coalesce("similar", F.expr("array()").cast("array<long>"))).withColumn("is_high_risk", F.col("fake_score") >= HIGH_RISK)


# --- interactions and sources ------------------------------------------------------------------------
def latest_reactions(events: DataFrame) -> DataFrame:
    """Last reaction of each user to each article; a removal (0) leaves none."""
    last = events.groupBy("user_id", "news_id").agg(F.max_by("reaction", F.struct("created_at", "event_id")).alias("reaction"))
    return last.where("reaction <> 0")


def record_reactions(reactions: DataFrame, new: DataFrame) -> DataFrame:
    """reactions (user_id, news_id, reaction, created_at) after new ones: the latest of each user and article; zero removes it."""
    return merge(reactions, new.select(*reactions.columns), ["user_id", "news_id"], "created_at").where("reaction <> 0")


def record_events(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Views or clicks with new ones added under the next ids, in order of time."""
    most = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("_most"))
    others = [c for c in known.columns if c != key]
    at = next(c for c in others if c.endswith("_at"))
    day = F.to_date(at)
    before = new.groupBy(day.alias("_d")).agg(F.count(F.lit(1)).alias("c")).withColumn("_b", F.sum("c").over(W.orderBy("_d")) - F.col("c")).drop("c")  # one row a day
    w = W.partitionBy("_d").orderBy(at, *[c for c in others if c != at])
    made = new.withColumn("_d", day).withColumn("_r", F.row_number().over(w)).join(before, "_d").join(F.broadcast(most))  # one row
    return known.unionByName(made.select((F.col("_most") + F.col("_b") + F.col("_r")).alias(key), *others).select(*known.columns))


def engaged(views: DataFrame, seconds: int = 10) -> DataFrame:
    return views.where(F.col("time_spent_sec") >= seconds)


def positive(reactions: DataFrame) -> DataFrame:
    return reactions.where("reaction > 0")


def taken(rows: DataFrame, **values: str) -> DataFrame:
    """Rows that have any of the values in its column."""
    test = F.lit(False)
    for column, value in values.items():
        test = test | (F.col(column) == value)
    return rows.where(test)


def source_outcomes(known: DataFrame, new: DataFrame) -> DataFrame:
    """new sources (name, base_url, type) with outcome: unsupported type, exists (its name is known, or was earlier in the rows by address), else created."""
    d = new.withColumn("type", F.lower("type")).withColumn("_n", F.row_number().over(W.partitionBy("name", F.lower("type").isin(*TYPES)).orderBy("base_url")))
    d = d.join(known.select("name").distinct().withColumn("_known", F.lit(True)), "name", "left")
    return d.withColumn("outcome", F.when(~F.col("type").isin(*TYPES), "unsupported").when(F.col("_known") | (F.col("_n") > 1), "exists").otherwise("created")).select("name", "base_url", "type", "outcome")


def add_sources(known: DataFrame, new: DataFrame) -> DataFrame:
    """known sources (source_id, name, base_url, type, is_active) and those created of new, active, under the next ids by name."""
    most = known.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("_most"))
    made = source_outcomes(known, new).where("outcome = 'created'")
    rank = F.row_number().over(W.orderBy("name"))  # sources are few: one row each
    made = made.withColumn("_r", rank).join(F.broadcast(most)).select((F.col("_most") + F.col("_r")).cast(known.schema["source_id"].dataType).alias("source_id"), "name", "base_url", "type", F.lit(True).alias("is_active"))
    return known.unionByName(made)


# --- rows as an API shows them ---------------------------------------------------------------------
def _shown(rows: DataFrame, **names: str | Column) -> DataFrame:
    return rows.select(*((F.col(x) if isinstance(x, str) else x).alias(k) for k, x in names.items()))


def show_source(d: DataFrame) -> DataFrame:
    return _shown(d, sourceId="source_id", name="name", baseUrl="base_url", type="type", isActive="is_active", createdAt=isoformat(F.col("created_at")))


def show_user(d: DataFrame) -> DataFrame:
    return _shown(d, userId="user_id", username="username", email="email", role="role", createdAt=isoformat(F.col("created_at")))


def show_news(d: DataFrame, sources: DataFrame) -> DataFrame:
    """Published news with the name of its source, null where it has none."""
    d = d.join(sources.select("source_id", F.col("name").alias("_name")), "source_id", "left")
    score = F.col("fake_score").cast("double")
    return _shown(
        d, newsId="news_id", representativeNewsProcessedId="representative_id", sourceId="source_id", sourceName="_name", title="title", summary="summary", originalUrl="original_url",
        sentimentLabel="sentiment_label", sentimentScore=F.col("sentiment_score").cast("double"), fakeScore=score, highRisk=score >= HIGH_RISK, publishedAt=isoformat(F.col("published_at")),
    )


def show_raw(d: DataFrame) -> DataFrame:
    return _shown(
        d, newsRawId="news_raw_id", sourceId="source_id", logId="log_id", platform="platform", sourceAccount="source_account", originalUrl="original_url", titleRaw="title_raw",
        authorRaw="author_raw", publishedAt=isoformat(F.col("published_at")), scrapedAt=isoformat(F.col("scraped_at")), status="status",
    )


def show_prediction(d: DataFrame) -> DataFrame:
    score = F.col("fake_score").cast("double")
    return _shown(
        d, predictionId="prediction_id", representativeNewsProcessedId="representative_id", sentimentLabel="sentiment_label", sentimentScore=F.col("sentiment_score").cast("double"),
        modelVersion="model_version", createdAt=isoformat(F.col("created_at")), fakeScore=score, highRisk=score >= HIGH_RISK,
    )


def show_summary(d: DataFrame) -> DataFrame:
    return _shown(d, summaryId="summary_id", representativeNewsProcessedId="representative_id", summaryText="summary_text", modelVersion="model_version", createdAt=isoformat(F.col("created_at")))


def show_reaction(d: DataFrame) -> DataFrame:
    return _shown(d, reactionId="reaction_id", userId="user_id", newsId="news_id", reaction="reaction", createdAt=isoformat(F.col("created_at")))


def show_view(d: DataFrame) -> DataFrame:
    return _shown(d, viewId="view_id", userId="user_id", newsId="news_id", viewedAt=isoformat(F.col("viewed_at")), timeSpentSec="time_spent_sec")


def show_click(d: DataFrame) -> DataFrame:
    return _shown(d, clickId="click_id", userId="user_id", newsId="news_id", clickedAt=isoformat(F.col("clicked_at")))
