"""Queries over stored news: publishing, feeds, details, interactions, logs and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, clustering, preprocess, runs, serving
from ..schemas import TABLES
from ..sources import tables
from .registry import BASE, FOUND, GROWN, MEANS, RAW, SOURCE_ID, isoformat, means, query

NOW = "timestamp '2024-03-01 12:00:00'"


def now():
    return F.expr(NOW)


# --- stored tables, made from the documents -------------------------------------------------------------
def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw news; every seventh has no title."""
    d = tables.news_raw(spark, sf)
    return d.withColumn("title_raw", F.when(F.col("news_raw_id") % 7 != 0, F.col("title_raw"))).withColumn("source_id", F.col("source_id").cast("long"))


def processed(spark: SparkSession, sf: str) -> DataFrame:
    d = preprocess.preprocess(tables.news_raw(spark, sf))
    return d.select(F.col("news_raw_id").alias("news_processed_id"), "news_raw_id", F.col("source_id").cast("long").alias("source_id"), "clean_text", "language", "token_count", F.col("published_at").alias("processed_at"), "status")


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents").where("doc_id % 5 = 0")
    return d.select(F.col("doc_id").alias("representative_id"), F.concat(F.lit("resumen "), F.col("doc_id").cast("string")).alias("summary_text"), F.lit("lead").alias("model_version"), F.expr("timestamp_seconds(1704067200 + doc_id)").alias("created_at"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents").where("doc_id % 4 <> 0")
    return d.select(
        F.col("doc_id").alias("representative_id"), F.when(F.col("doc_id") % 9 != 0, F.lit("discuss")).alias("sentiment_label"), F.lit(0.5).alias("sentiment_score"), F.lit("v").alias("model_version"),
        F.expr("timestamp_seconds(1704067200 + doc_id)").alias("created_at"), F.round(((F.col("doc_id") * 7919) % 10000) / 10000.0, 4).alias("fake_score"),
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    """What is served already: every sixth article under an id of its own, every eleventh of the articles unpublished."""
    d = tables.news_raw(spark, sf).where("news_raw_id % 6 = 0")
    return d.select(
        (F.expr("news_raw_id div 6") + 1).alias("news_id"), F.col("news_raw_id").alias("representative_id"), F.col("source_id").cast("long").alias("source_id"), F.concat(F.lit("antes "), "title_raw").alias("title"),
        F.lit("viejo").alias("summary"), "original_url", F.lit("agree").alias("sentiment_label"), F.lit(0.25).alias("sentiment_score"), F.round(((F.col("news_raw_id") * 31) % 100) / 100.0, 4).alias("fake_score"),
        F.when(F.col("news_raw_id") % 11 != 0, F.col("published_at")).alias("published_at"),
    )


def reps(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("representative_id"))


STORED = f"""{BASE}, own as (select news_raw_id, source_id, case when news_raw_id % 7 <> 0 then title_raw end as title_raw, original_url, published_at from raw),
    summaries as (select doc_id as representative_id, 'resumen ' || doc_id as summary_text from documents where doc_id % 5 = 0),
    predictions as (select doc_id as representative_id, case when doc_id % 9 <> 0 then 'discuss' else 'unknown' end as sentiment_label, 0.5 as sentiment_score, round(((doc_id * 7919) % 10000) / 10000.0, 4) as fake_score from documents where doc_id % 4 <> 0),
    served as (select news_raw_id // 6 + 1 as news_id, news_raw_id as representative_id, source_id, 'antes ' || title_raw as title, 'viejo' as summary, original_url, 'agree' as sentiment_label, 0.25 as sentiment_score, round(((news_raw_id * 31) % 100) / 100.0, 4) as fake_score,
        case when news_raw_id % 11 <> 0 then published_at end as published_at from raw where news_raw_id % 6 = 0)"""
SNAPSHOTS = f"""{STORED}, snap as (select p.news_raw_id as representative_id, p.source_id, coalesce(nullif(o.title_raw, ''), substr(p.clean_text, 1, 160)) as title, coalesce(s.summary_text, substr(p.clean_text, 1, 800)) as summary, o.original_url, m.sentiment_label, m.sentiment_score, m.fake_score
    from processed p join own o using (news_raw_id) left join summaries s on s.representative_id = p.news_raw_id left join predictions m on m.representative_id = p.news_raw_id where p.news_raw_id % 3 = 0)"""
_KEEP = "coalesce(p.sentiment_label, s.sentiment_label) as sentiment_label, coalesce(p.sentiment_score, s.sentiment_score{z}) as sentiment_score, coalesce(p.fake_score, s.fake_score{z}) as fake_score"
_PUBLISHED = f"""{SNAPSHOTS}, joined as (select s.news_id, p.representative_id, p.source_id, p.title, p.summary, p.original_url, {_KEEP.format(z=", 0")}, {NOW} as published_at from snap p left join served s using (representative_id)),
    fresh as (select representative_id, (select max(news_id) from served) + row_number() over (order by representative_id) as news_id from joined where news_id is null),
    published as (select coalesce(j.news_id, f.news_id) as news_id, j.* exclude (news_id) from joined j left join fresh f using (representative_id) union all by name select * from served where representative_id not in (select representative_id from snap))"""
_COLUMNS = "news_id, representative_id, cast(source_id as bigint) as source_id, md5(title) as title, md5(summary) as summary, original_url, sentiment_label, cast(sentiment_score as double) as sentiment_score, cast(fake_score as double) as fake_score, published_at"


def _digests(d: DataFrame) -> DataFrame:
    return d.withColumn("title", F.md5(F.col("title").cast("binary"))).withColumn("summary", F.md5(F.col("summary").cast("binary")))


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return serving.snapshots(reps(spark, sf), processed(spark, sf), raw(spark, sf), summaries(spark, sf), predictions(spark, sf))


@query(f"{SNAPSHOTS} select representative_id, cast(source_id as bigint) as source_id, md5(title) as title, md5(summary) as summary, original_url, sentiment_label, cast(sentiment_score as double) as sentiment_score, cast(fake_score as double) as fake_score from snap")
def publish_snapshots(spark, sf):
    return _digests(_snapshots(spark, sf))


@query(f"{_PUBLISHED} select {_COLUMNS} from published")
def publish_news(spark, sf):
    return _digests(serving.publish(news(spark, sf), _snapshots(spark, sf), now()))


@query(f"""{SNAPSHOTS}, r as (select s.news_id, s.representative_id, coalesce(p.source_id, s.source_id) as source_id, coalesce(p.title, s.title) as title, coalesce(p.summary, s.summary) as summary, coalesce(p.original_url, s.original_url) as original_url, {_KEEP.format(z="")}, s.published_at
    from served s left join snap p using (representative_id)) select {_COLUMNS} from r""")
def refresh_news(spark, sf):
    return _digests(serving.refresh(news(spark, sf), _snapshots(spark, sf)))


@query(f"{STORED} select news_id, case when news_id % 3 <> 0 then published_at end as published_at from served")
def unpublish_news(spark, sf):
    d = news(spark, sf)
    return serving.unpublish(d, d.where("news_id % 3 = 0").select("news_id")).select("news_id", "published_at")


@query(f"{STORED} select news_id, representative_id from served where published_at is not null and source_id = 3 order by published_at desc, news_id limit 10 offset 10")
def feed_by_name(spark, sf):
    names = tables.sources(spark, sf).select("source_id", "name")
    third = names.where("source_id = 3").first()["name"]
    return serving.feed(news(spark, sf), 2, 10, None, names, third).select("news_id", "representative_id")


@query(f"{STORED} select news_id, representative_id, original_url from served where news_id = 5")
def point_lookup(spark, sf):
    return serving.by_id(news(spark, sf), "news_id", 5).select("news_id", "representative_id", "original_url")


_DETAILS = f"""{STORED}, members as (select news_raw_id, news_raw_id % 40 as cluster_id from raw), m as (select s.news_id, c.cluster_id, s.published_at from served s join members c on c.news_raw_id = s.representative_id),
    top as (select x.news_id, y.news_id as peer, row_number() over (partition by x.news_id order by y.published_at desc, y.news_id) as r from m x join m y on x.cluster_id = y.cluster_id and x.news_id <> y.news_id where y.published_at is not null),
    alike as (select news_id, string_agg(cast(peer as varchar), ',' order by r) as peers from top where r <= 5 group by news_id)"""


@query(f"""{_DETAILS} select s.news_id, coalesce(t.peers, '') as similar, case when s.representative_id < 40 then s.representative_id % 40 end as cluster_id, case when s.representative_id < 40 then 0.5 end as cluster_score, s.fake_score >= 0.8 as is_high_risk
    from served s left join alike t using (news_id)""")
def news_details(spark, sf):
    """Each cluster is the articles of equal remainder, represented by the first."""
    members = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("news_processed_id"), (F.col("doc_id") % 40).alias("cluster_id"))
    clusters = members.where("news_processed_id < 40").select("cluster_id", F.col("news_processed_id").alias("representative_id"), F.lit(0.5).alias("cluster_score"))
    d = serving.details(news(spark, sf), members, clusters)
    return d.select("news_id", F.array_join(F.col("similar").cast("array<string>"), ",").alias("similar"), "cluster_id", "cluster_score", "is_high_risk")


# --- rows as an API shows them ---------------------------------------------------------------------------
@query(f"""{STORED}, names as (select distinct {SOURCE_ID} as source_id, source as name from documents where {SOURCE_ID} % 7 <> 3) select news_id as "newsId", representative_id as "representativeNewsProcessedId", cast(s.source_id as bigint) as "sourceId", n.name as "sourceName", title, summary,
    original_url as "originalUrl", sentiment_label as "sentimentLabel", cast(sentiment_score as double) as "sentimentScore", cast(fake_score as double) as "fakeScore", fake_score >= 0.8 as "highRisk", {isoformat("published_at")} as "publishedAt" from served s left join names n on n.source_id = s.source_id""")
def shown_news(spark, sf):
    return serving.show_news(news(spark, sf), tables.sources(spark, sf).where("is_active"))


@query(f"""with {RAW} select news_raw_id as "newsRawId", cast(source_id as bigint) as "sourceId", null::bigint as "logId", 'web' as platform, source as "sourceAccount", original_url as "originalUrl", title_raw as "titleRaw", null::varchar as "authorRaw", {isoformat("published_at")} as "publishedAt",
    {isoformat("published_at + to_microseconds(news_raw_id % 3)")} as "scrapedAt", 'pending' as status from raw""")
def shown_raw(spark, sf):
    d = tables.news_raw(spark, sf)
    extra = {"log_id": F.lit(None).cast("long"), "platform": F.lit("web"), "source_account": F.col("source"), "author_raw": F.lit(None).cast("string"), "scraped_at": F.timestamp_micros(F.unix_micros("published_at") + F.col("news_raw_id") % 3), "source_id": F.col("source_id").cast("long")}
    return serving.show_raw(d.withColumns(extra))


@query(f"""{STORED} select representative_id + 1 as "predictionId", representative_id as "representativeNewsProcessedId", case when representative_id % 9 <> 0 then 'discuss' end as "sentimentLabel", 0.5::double as "sentimentScore", 'v' as "modelVersion",
    {isoformat("timestamp '2024-01-01' + to_seconds(representative_id)")} as "createdAt", cast(fake_score as double) as "fakeScore", fake_score >= 0.8 as "highRisk" from predictions""")
def shown_predictions(spark, sf):
    return serving.show_prediction(predictions(spark, sf).withColumn("prediction_id", F.col("representative_id") + 1))


@query(f"""{STORED} select representative_id as "summaryId", representative_id as "representativeNewsProcessedId", summary_text as "summaryText", 'lead' as "modelVersion", {isoformat("timestamp '2024-01-01' + to_seconds(representative_id)")} as "createdAt" from summaries""")
def shown_summaries(spark, sf):
    return serving.show_summary(summaries(spark, sf).withColumn("summary_id", F.col("representative_id")))


@query(f"""select distinct {SOURCE_ID} as "sourceId", source as name, 'https://' || source || '.example/' as "baseUrl", 'web' as type, {SOURCE_ID} % 7 <> 3 as "isActive", '2024-03-01T12:00:00' as "createdAt" from documents""")
def shown_sources(spark, sf):
    return serving.show_source(tables.sources(spark, sf).withColumn("created_at", now()))


@query("""select user_id as "userId", 'u' || user_id as username, 'u' || user_id || '@example.org' as email, 'user' as role, strftime(min(ts), '%Y-%m-%dT%H:%M') as "createdAt" from events group by user_id""")
def shown_users(spark, sf):
    d = tables.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    shown = serving.show_user(d.select("user_id", name.alias("username"), F.concat(name, F.lit("@example.org")).alias("email"), F.lit("user").alias("role"), "created_at"))
    return shown.withColumn("createdAt", F.substring("createdAt", 1, 16))


def _of(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return tables.table(spark, sf, "events").where(F.col("event_type") == kind).select("event_id", "user_id", (F.col("event_id") % 100).alias("news_id"), "ts", "value")


@query("""select event_id as "viewId", user_id as "userId", event_id % 100 as "newsId", strftime(ts, '%Y-%m-%dT%H:%M') as "viewedAt", cast(floor(value) as int) as "timeSpentSec" from events where event_type = 'view'""")
def shown_views(spark, sf):
    d = _of(spark, sf, "view").select(F.col("event_id").alias("view_id"), "user_id", "news_id", F.col("ts").alias("viewed_at"), F.floor("value").cast("int").alias("time_spent_sec"))
    return serving.show_view(d).withColumn("viewedAt", F.substring("viewedAt", 1, 16))


@query("""select event_id as "clickId", user_id as "userId", event_id % 100 as "newsId", strftime(ts, '%Y-%m-%dT%H:%M') as "clickedAt" from events where event_type = 'click'""")
def shown_clicks(spark, sf):
    d = _of(spark, sf, "click").select(F.col("event_id").alias("click_id"), "user_id", "news_id", F.col("ts").alias("clicked_at"))
    return serving.show_click(d).withColumn("clickedAt", F.substring("clickedAt", 1, 16))


@query("""select event_id as "reactionId", user_id as "userId", event_id % 100 as "newsId", 1 as reaction, strftime(ts, '%Y-%m-%dT%H:%M') as "createdAt" from events where event_type = 'purchase'""")
def shown_reactions(spark, sf):
    d = _of(spark, sf, "purchase").select(F.col("event_id").alias("reaction_id"), "user_id", "news_id", F.lit(1).alias("reaction"), F.col("ts").alias("created_at"))
    return serving.show_reaction(d).withColumn("createdAt", F.substring("createdAt", 1, 16))


# --- interactions and sources ------------------------------------------------------------------------------
_KIND = "case event_type when 'purchase' then 1 when 'error' then -1 else 0 end"


def _reactions(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    # times of equal events differ by their ids
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) * 1 + F.col("event_id"))
    return tables.table(spark, sf, "events").where("event_type in ('purchase', 'error', 'signup')").select("event_id", "user_id", (F.col("event_id") % 100).alias("news_id"), value.alias("reaction"), at.alias("created_at"))


@query(f"""with e as (select event_id, user_id, event_id % 100 as news_id, {_KIND} as reaction, ts + to_microseconds(event_id) as moment from events where event_type in ('purchase', 'error', 'signup')),
    l as (select user_id, news_id, event_id % 2 as part, arg_max(reaction, moment) as reaction from e group by all), old as (select * from l where part = 0 and reaction <> 0), new as (select * from l where part = 1)
    select user_id, news_id, reaction from new where reaction <> 0 union all select user_id, news_id, reaction from old where (user_id, news_id) not in (select (user_id, news_id) from new)""")
def reaction_upserts(spark, sf):
    d = _reactions(spark, sf)
    old = serving.latest_reactions(d.where("event_id % 2 = 0")).withColumn("created_at", now())
    return serving.record_reactions(old, d.where("event_id % 2 = 1").select("user_id", "news_id", "reaction", "created_at")).select("user_id", "news_id", "reaction")


@query(f"select user_id, event_id % 100 as news_id, arg_max({_KIND}, ts + to_microseconds(event_id)) as reaction from events where event_type in ('purchase', 'error', 'signup') group by all having arg_max({_KIND}, ts + to_microseconds(event_id)) > 0")
def positive_reactions(spark, sf):
    return serving.positive(serving.latest_reactions(_reactions(spark, sf)))


@query("""with k as (select 7 as view_id, 1 as user_id, 1 as news_id, timestamp '2023-12-31' as viewed_at, 5 as time_spent_sec), n as (select user_id, event_id % 100 as news_id, ts as viewed_at, cast(floor(value) as int) as time_spent_sec from events where event_type = 'view')
    select * from k union all select 7 + row_number() over (order by viewed_at, user_id, news_id, time_spent_sec), user_id, news_id, viewed_at, time_spent_sec from n""")
def view_append(spark, sf):
    known = spark.sql("select 7L as view_id, 1L as user_id, 1L as news_id, timestamp '2023-12-31 00:00:00' as viewed_at, 5 as time_spent_sec")
    new = _of(spark, sf, "view").select("user_id", "news_id", F.col("ts").cast("timestamp").alias("viewed_at"), F.floor("value").cast("int").alias("time_spent_sec"))
    return serving.record_events(known, new, "view_id")


@query("select row_number() over (order by ts, user_id, event_id % 100) as click_id, user_id, event_id % 100 as news_id, ts as clicked_at from events where event_type = 'click'")
def click_append(spark, sf):
    new = _of(spark, sf, "click").select("user_id", "news_id", F.col("ts").cast("timestamp").alias("clicked_at"))
    return serving.record_events(spark.createDataFrame([], TABLES["news_clicks"]), new, "click_id")


_NEW = """known as (select distinct source as name from documents), new as (select 'Site ' || (page_id % 100) as name, url as base_url, case page_id % 4 when 0 then 'RSS' when 1 then 'Social' else 'web' end as type from pages union all select source, 'https://' || source, 'web' from documents where doc_id < 40)"""


def _new_sources(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    kind = F.when(i % 4 == 0, "RSS").when(i % 4 == 1, "Social").otherwise("web")
    pages = tables.table(spark, sf, "pages").select(F.concat(F.lit("Site "), (i % 100).cast("string")).alias("name"), F.col("url").alias("base_url"), kind.alias("type"))
    return pages.unionByName(tables.table(spark, sf, "documents").where("doc_id < 40").select(F.col("source").alias("name"), F.concat(F.lit("https://"), "source").alias("base_url"), F.lit("web").alias("type")))


_OUTCOMES = f"""with {_NEW}, j as (select *, lower(type) in ('web', 'social', 'twitter') as ok from new), o as (select name, base_url, lower(type) as type,
    case when not ok then 'unsupported' when name in (select name from known) or row_number() over (partition by name, ok order by base_url) > 1 then 'exists' else 'created' end as outcome from j)"""


@query(f"{_OUTCOMES} select outcome, type, count(*) as n from o group by all")
def source_outcomes(spark, sf):
    return serving.source_outcomes(tables.sources(spark, sf), _new_sources(spark, sf)).groupBy("outcome", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_OUTCOMES}, top as (select max({SOURCE_ID}) as m from documents) select distinct {SOURCE_ID} as source_id, source as name, 'https://' || source || '.example/' as base_url, 'web' as type, {SOURCE_ID} % 7 <> 3 as is_active from documents
    union all select cast((select m from top) + row_number() over (order by name) as int), name, base_url, type, true from o where outcome = 'created'""")
def source_create(spark, sf):
    known = tables.sources(spark, sf)
    return serving.add_sources(known, _new_sources(spark, sf)).select(*known.columns)


@query("select page_id from pages where page_id % 100 = 7 or url like '%page=2&ref=x'")
def names_taken(spark, sf):
    d = tables.table(spark, sf, "pages").select("page_id", (F.col("page_id") % 100).cast("string").alias("name"), F.regexp_extract("url", "(page=2&ref=x)$", 1).alias("tail"))
    return serving.taken(d, name="7", tail="page=2&ref=x").select("page_id")


# --- logs and runs -----------------------------------------------------------------------------------------
@query(f"""{BASE}, old as (select news_raw_id, 'preprocessing' as stage, 'failed' as status from raw where news_raw_id % 2 = 0 union all select news_raw_id, 'clustering', 'success' from raw where news_raw_id % 2 = 0)
    select news_raw_id as news_processed_id, stage, status from old where not (stage = 'preprocessing' and news_raw_id % 3 = 0) union all
    select news_raw_id, 'preprocessing', case when token_count >= 50 then 'success' else 'failed' end from processed where news_raw_id % 3 = 0""")
def replace_logs(spark, sf):
    ids = tables.table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("news_processed_id"))
    old = ids.select("news_processed_id", F.lit("preprocessing").alias("stage"), F.lit("failed").alias("status")).unionByName(ids.select("news_processed_id", F.lit("clustering").alias("stage"), F.lit("success").alias("status")))
    new = processed(spark, sf).where("news_processed_id % 3 = 0")
    logs = runs.log(new, "preprocessing", F.when(F.col("status") == "ok", "success").otherwise("failed"), F.lit("x"), now())
    return runs.replace_logs(old, logs).select("news_processed_id", "stage", "status")


def stored(spark: SparkSession, sf: str, every: int = 1) -> runs.Tables:
    """Tables before a run: raw news alone."""
    d = tables.news_raw(spark, sf).where(F.col("news_raw_id") % every == 0)
    own = {"log_id": F.lit(None).cast("long"), "platform": F.lit("web"), "source_account": F.col("source"), "author_raw": F.lit(None).cast("string"), "scraped_at": F.col("published_at"), "source_id": F.col("source_id").cast("long")}
    names = [x.strip().split(" ")[0] for x in TABLES["news_raw"].split(",")]
    empty = {n: spark.createDataFrame([], TABLES[n]) for n in runs.Tables.__dataclass_fields__}
    return runs.Tables(**{**empty, "news_raw": d.withColumns(own).select(*names)})


def ran(spark: SparkSession, sf: str, settings: analysis.AnalysisSettings) -> tuple[runs.Tables, DataFrame]:
    t = stored(spark, sf)
    return runs.run(t, runs.waiting(t.news_raw), now(), settings)


@query(f"""{FOUND}, n as (select count(distinct leader) as c from clusters) select (select count(*) from raw) as raw_news_count, (select count(*) from raw) as processed_count, c as cluster_count, c as published_count from n""")
def run_counters(spark, sf):
    """A first run over all raw news: all are processed at one time, so clusters are founded in order of id."""
    return ran(spark, sf, analysis.AnalysisSettings(veracity=None))[1]


@query(f"""{FOUND}, {MEANS}, r as (select leader, arg_max(id, (mean, -id)) as representative from members group by leader) select r.representative as representative_id, row_number() over (order by r.representative) as news_id,
    md5(p.title_raw) as title, md5(case when length(p.clean_text) >= 700 then array_to_string(list_filter(string_split(regexp_replace(p.clean_text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '')[1:3], ' ') else substr(p.clean_text, 1, 600) end) as summary, cast(0.0 as double) as fake_score
    from r join processed p on p.news_raw_id = r.representative""")
def publish_without_model(spark, sf):
    """A run without a veracity model publishes the same, without predictions."""
    done, _ = ran(spark, sf, analysis.AnalysisSettings(veracity=None))
    return _digests(done.news).select("representative_id", "news_id", "title", "summary", "fake_score")


@query(f"""{BASE} select (select max(news_raw_id) from raw) as raw_news_id, count(*) > 0 as clustered from processed""")
def reprocess_one(spark, sf):
    """One article comes again: its cluster is found and published."""
    t = stored(spark, sf, 5)
    last = t.news_raw.agg(F.max("news_raw_id")).first()[0]
    _, counters = runs.reprocess(t, last, now(), analysis.AnalysisSettings(veracity=None))
    return counters.select(F.lit(tables.news_raw(spark, sf).agg(F.max("news_raw_id")).first()[0]).alias("raw_news_id"), (F.col("cluster_count") >= 0).alias("clustered"))


_ITEMS = f"""with {RAW}, known as (select news_raw_id, source_id, original_url from raw where news_raw_id % 13 = 0), items as (select source_id, case when news_raw_id % 29 <> 0 then original_url else 'https://' || source || '.example/' end as original_url, title_raw, case when news_raw_id % 17 = 0 then ' ' else content_raw end as content_raw from raw where source_id % 7 <> 3 and news_raw_id % 29 <> 0),
    judged as (select *, case when trim(coalesce(title_raw, '')) = '' or trim(content_raw) = '' then 'incomplete' when (source_id, original_url) in (select (source_id, original_url) from known) then 'duplicate' else 'saved' end as outcome from items)"""


@query(f"""{_ITEMS} select cast(source_id as bigint) as source_id, outcome, count(*) as n from judged group by all""")
def ingest_by_source(spark, sf):
    t = _ingested(spark, sf)[1]
    return t.select(F.col("source_id").cast("long").alias("source_id"), "outcome", "n")


@query(f"""{_ITEMS} select (select max(news_raw_id) from known) + row_number() over (order by source_id, original_url) as news_raw_id, original_url, source_account from (select j.*, 'src' as x, s.source as source_account from judged j join (select distinct {SOURCE_ID} as source_id, source from documents) s using (source_id) where outcome = 'saved')""")
def ingested_rows(spark, sf):
    return _ingested(spark, sf)[0].select("news_raw_id", "original_url", "source_account")


def _ingested(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = tables.news_raw(spark, sf)
    known = d.where("news_raw_id % 13 = 0").select("news_raw_id", "source_id", "original_url")
    items = d.where("news_raw_id % 29 <> 0").select("source_id", "original_url", "title_raw", F.when(F.col("news_raw_id") % 17 == 0, " ").otherwise(F.col("content_raw")).alias("content_raw"), F.lit(None).cast("string").alias("author_raw"), "published_at")
    return runs.ingested(tables.sources(spark, sf), items, known, now())


# --- clusters that grow ------------------------------------------------------------------------------------
def grown(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Clusters of the articles whose id three doesn't divide, each known under its founder, after the others came."""
    d = preprocess.preprocess(tables.news_raw(spark, sf)).where("status = 'ok'")
    articles = clustering.keep(d.select(F.col("news_raw_id").alias("id"), F.col("title_raw").alias("title"), F.col("clean_text").alias("text"), F.col("source_id").cast("long").alias("source_id"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("rank")), "articles")
    first = articles.where("id % 3 <> 0")
    sets = clustering.keep(clustering.contexts(articles, "rank").drop("lead"), "contexts")  # made once for both
    found = clustering.keep(clustering.leaders_of_sets(sets.where("id % 3 <> 0")), "first")
    members = found.join(first.select("id", "source_id"), "id").select(F.col("id").alias("news_processed_id"), F.col("leader").alias("cluster_id"), "source_id")
    clusters = members.where("news_processed_id = cluster_id").select("cluster_id", F.col("cluster_id").alias("representative_id"), "source_id", F.lit(1.0).alias("cluster_score"))
    return clustering.incremental(articles, members, clusters, known_sets=sets)


@query(f"{GROWN} select id as news_processed_id, cluster_id from every")
def cluster_members_grown(spark, sf):
    return grown(spark, sf)[0].select("news_processed_id", "cluster_id")


@query(f"""{GROWN}, clusters2 as (select cluster_id as leader, id from every), {means("clusters2")} select leader as cluster_id, arg_max(id, (mean, -id)) as representative_id, max(mean) as cluster_score from members group by leader""")
def clusters_grown(spark, sf):
    return grown(spark, sf)[1].select("cluster_id", "representative_id", "cluster_score")


@query(f"""{BASE}, one as (select news_raw_id from processed where token_count >= 50 order by news_raw_id limit 1) select news_raw_id as news_processed_id, 'clustering' as stage, 'failed' as status, 'No hay suficientes articulos para clustering.' as message, 'hybrid:0.4' as model_version from one""")
def too_few_articles(spark, sf):
    t = stored(spark, sf)
    rows = processed(spark, sf).where("status = 'ok'").orderBy("news_processed_id").limit(1).select(F.col("news_processed_id").alias("id"), "source_id", F.lit("").alias("title"), F.col("clean_text").alias("text"), F.lit(0).cast("long").alias("rank"))
    return clustering.stage(rows, t.cluster_members, t.news_clusters)[2]


@query(f"{BASE} select news_raw_id as id from processed where token_count >= 50 and source_id = 3")
def scoped_to_source(spark, sf):
    d = processed(spark, sf).where("status = 'ok'").select(F.col("news_processed_id").alias("id"), "source_id")
    return clustering.scoped(d, 3, False).select("id")

