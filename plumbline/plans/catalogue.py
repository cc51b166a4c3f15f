"""All queries by name, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels as lb
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import blocks, claims, clustering, datasets, evidence, metrics, preprocess, scoring, serving, similarity, summaries, training
from ..sources import html, tables
from ..storage import keep, work_folder
from ..streaming import jobs
from . import registry
from .registry import BASE, CONTENT, FOUND, MEANS, NEAR, NEWS, RAW, SETS, SOURCE_ID, Query, query, token_list


def queries() -> dict[str, Query]:
    from . import analyses, kernels, pages, publishing  # noqa: F401

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)


# --- SQL fragments ---------------------------------------------------------------------------------
FOLDED = "lower(strip_accents(text))"
LABELS = "scored as (select doc_id, case when quality = 1 then 'true' else 'false' end as gold, round(((doc_id * 7919) % 1000) / 2000.0 + (1 - quality) * 0.5, 4) as risk from labels)"


def _news(spark: SparkSession, sf: str) -> DataFrame:
    """Published news: every eleventh document is unpublished."""
    d = tables.news_raw(spark, sf)
    return d.select(F.col("news_raw_id").alias("news_id"), "source", "source_id", F.when(F.col("news_raw_id") % 11 != 0, F.col("published_at")).alias("published_at"), F.round(((F.col("news_raw_id") * 7919) % 10000) / 10000.0, 4).alias("fake_score"))


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.preprocess(tables.news_raw(spark, sf))


# --- text and preprocessing --------------------------------------------------------------------------
@query(f"{BASE} select source, language, case when token_count >= 50 then 'ok' else 'error' end as status, count(*) as n, cast(sum(token_count) as bigint) as tokens from processed group by all")
def preprocess_summary(spark, sf):
    d = _processed(spark, sf)
    return d.groupBy("source", "language", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").cast("long").alias("tokens"))


FLAGSHIP = preprocess_summary


@query(f"{BASE} select news_raw_id, cast(length(clean_text) as bigint) as chars, md5(clean_text) as digest from processed")
def clean_text_lengths(spark, sf):
    return _processed(spark, sf).select("news_raw_id", F.length("clean_text").cast("long").alias("chars"), F.md5(F.col("clean_text").cast("binary")).alias("digest"))


@query(f"{BASE} select news_raw_id, cast(token_count as bigint) as tokens from processed")
def token_counts(spark, sf):
    return _processed(spark, sf).select("news_raw_id", F.col("token_count").cast("long").alias("tokens"))


@query(f"{BASE} select news_raw_id, language from processed")
def detect_language(spark, sf):
    return _processed(spark, sf).select("news_raw_id", "language")


@query(f"select doc_id, md5(trim(regexp_replace({FOLDED}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))) as claim_key from documents")
def normalize_claim_key(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.md5(tx.claim_key(F.col("text")).cast("binary")).alias("claim_key"))


@query(f"select doc_id, cast(len(list_filter(string_split(regexp_replace({CONTENT}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '')) as bigint) as sentences from documents")
def sentence_counts(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(f"with {RAW} select news_raw_id, title_raw as headline from raw")
def infer_headline(spark, sf):
    return tables.news_raw(spark, sf).select("news_raw_id", F.col("title_raw").alias("headline"))


_TOKENS = f"list_distinct({token_list('title_raw || chr(32) || content_raw')})"


@query(f"with {RAW} select news_raw_id, cast(len(t) as bigint) as tokens, md5(array_to_string(list_sort(t), ' ')) as digest from (select news_raw_id, {_TOKENS} as t from raw)")
def cluster_tokens(spark, sf):
    t = tx.cluster_tokens(F.concat_ws(" ", "title_raw", "content_raw"))
    return tables.news_raw(spark, sf).select("news_raw_id", t.alias("t")).select("news_raw_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("digest"))


# --- ingest --------------------------------------------------------------------------------------------
_BATCH = f"{RAW}, batch as (select news_raw_id, source_id, original_url, title_raw, case when news_raw_id % 17 = 0 then ' ' else content_raw end as content_raw from raw union all select news_raw_id + 1000000000, source_id, original_url, title_raw, content_raw from raw where news_raw_id % 5 = 0)"
_OUTCOME = "judged as (select *, case when trim(coalesce(title_raw, '')) = '' or trim(content_raw) = '' then 'incomplete' when news_raw_id % 1000000000 % 13 = 0 or row_number() over (partition by source_id, original_url, trim(content_raw) = '' order by news_raw_id) > 1 then 'duplicate' else 'saved' end as outcome from batch)"


def _batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A batch with blank contents and repeats, and what is known already."""
    raw = tables.news_raw(spark, sf)
    cols = ["news_raw_id", "source_id", "original_url", "title_raw", "content_raw"]
    first = raw.withColumn("content_raw", F.when(F.col("news_raw_id") % 17 == 0, " ").otherwise(F.col("content_raw"))).select(*cols)
    again = raw.where("news_raw_id % 5 = 0").withColumn("news_raw_id", F.col("news_raw_id") + 1_000_000_000).select(*cols)
    return first.unionByName(again), raw.where("news_raw_id % 13 = 0")


@query(f"with {_BATCH}, {_OUTCOME} select outcome, count(*) as n from judged group by outcome")
def ingest_outcomes(spark, sf):
    return preprocess.ingest_outcome(*_batch(spark, sf)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_BATCH}, {_OUTCOME} select news_raw_id, source_id, original_url from judged where outcome = 'saved'")
def dedupe_source_url(spark, sf):
    return preprocess.ingest_outcome(*_batch(spark, sf)).where("outcome = 'saved'").select("news_raw_id", "source_id", "original_url")


@query(f"select source_id, name, n from (select {SOURCE_ID} as source_id, source as name, count(*) as n from documents group by all) where source_id % 7 <> 3")
def source_activity(spark, sf):
    counts = tables.news_raw(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return tables.sources(spark, sf).where("is_active").join(counts, "source_id").select("source_id", "name", "n")


# --- similarity and clusters -------------------------------------------------------------------------
def _contexts(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Token sets of the articles that are long enough."""
    return clustering.contexts_of_raw(tables.news_texts(spark, sf), *more)


def _sql_tokens(text: str) -> str:
    return f"list_distinct({token_list(text)})"


@query(f"""{BASE}, {SETS}, t as (select id, unnest(x) as w, len(x) as n from (select id, {_sql_tokens("clean_text")} as x from ok)),
    p as (select a.id as a, b.id as b, count(*) as o, any_value(a.n) as na, any_value(b.n) as nb from t a join t b on a.w = b.w and a.id < b.id group by 1, 2)
    select a, b, round(o / (na + nb - o), 4) as jaccard from p where o / (na + nb - o) >= 0.6""")
def body_jaccard_pairs(spark, sf):
    bodies = keep(_contexts(spark, sf).select("id", F.col("body").alias("s")), "bodies")
    d = blocks.jaccard_pairs(bodies, 0.6).withColumnRenamed("common", "n")
    return d.select("a", "b", (F.col("n") / (F.col("both") - F.col("n"))).alias("j")).where("j >= 0.6").select("a", "b", F.round("j", 4).alias("jaccard"))


@query(f"""{BASE}, {SETS}, t as (select id, unnest(x) as w, len(x) as n from (select id, {_sql_tokens("title_raw")} as x from ok)),
    p as (select a.id as a, b.id as b, count(*) as o, least(any_value(a.n), any_value(b.n)) as n from t a join t b on a.w = b.w and a.id < b.id group by 1, 2)
    select a, b, round(o / n, 4) as overlap from p where o / n >= 0.5""")
def title_overlap_pairs(spark, sf):
    sets = keep(_contexts(spark, sf).select("id", "title"), "titles")
    return similarity.titles(sets, 0.5).select("a", "b", F.round("o", 4).alias("overlap"))


@query(f"{NEAR} select a, b, sim from near")
def hybrid_similarity(spark, sf):
    return clustering.pairs_of_sets(keep(_contexts(spark, sf), "contexts"))


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Leaders of all articles in order of their time, and their token sets."""
    sets = keep(_contexts(spark, sf, "rank"), "contexts")
    return keep(clustering.leaders_of_sets(sets), "leaders"), sets


@query(f"{FOUND} select id, leader, sim from clusters")
def leader_clusters(spark, sf):
    return _clusters(spark, sf)[0]


@query(f"{FOUND}, {MEANS} select leader, arg_max(id, (mean, -id)) as representative, max(mean) as cluster_score, count(*) as size from members group by leader")
def cluster_representatives(spark, sf):
    return clustering.representatives(*_clusters(spark, sf))


@query(f"""{FOUND}, {NEWS}, m as (select c.id as news_id, leader as cluster_id, n.published_at from clusters c join news n on n.news_id = c.id)
    select x.news_id, y.news_id as peer, cast(row_number() over (partition by x.news_id order by y.published_at desc, y.news_id) as int) as rank from m x join m y on x.cluster_id = y.cluster_id and x.news_id <> y.news_id where y.published_at is not null
    qualify row_number() over (partition by x.news_id order by y.published_at desc, y.news_id) <= 5""")
def similar_published(spark, sf):
    members, _ = _clusters(spark, sf)
    return serving.similar_published(_news(spark, sf), members.select(F.col("id").alias("news_id"), F.col("leader").alias("cluster_id")))


# --- joins and feeds -----------------------------------------------------------------------------------
@query(f"{BASE} select p.news_raw_id, r.original_url, p.language from processed p join raw r using (news_raw_id) where p.token_count >= 50")
def join_inner_raw(spark, sf):
    p = _processed(spark, sf).where("status = 'ok'").select("news_raw_id", "language")
    return p.join(tables.news_raw(spark, sf).select("news_raw_id", "original_url"), "news_raw_id").select("news_raw_id", "original_url", "language")


@query(f"with {NEWS}, s as (select distinct {SOURCE_ID} as source_id, source as name from documents where {SOURCE_ID} % 7 <> 3) select news_id, name as source_name from news left join s using (source_id)")
def join_left_source(spark, sf):
    s = tables.sources(spark, sf).where("is_active").select("source_id", F.col("name").alias("source_name"))
    return _news(spark, sf).join(s, "source_id", "left").select("news_id", "source_name")


@query(f"{BASE}, {LABELS}, {NEWS}, s as (select distinct {SOURCE_ID} as source_id, source as name from documents) select p.news_raw_id, s.name, r.title_raw, c.risk, n.published_at from processed p join raw r using (news_raw_id) join s on s.source_id = r.source_id join scored c on c.doc_id = p.news_raw_id left join news n on n.news_id = p.news_raw_id where c.risk between 0.25 and 0.75")
def five_way_export(spark, sf):
    p = _processed(spark, sf).select("news_raw_id", "source_id", "title_raw")
    c = tables.scored_labels(spark, sf).where("risk between 0.25 and 0.75").select(F.col("doc_id").alias("news_raw_id"), "risk")
    n = _news(spark, sf).select(F.col("news_id").alias("news_raw_id"), "published_at")
    return p.join(c, "news_raw_id").join(tables.sources(spark, sf).select("source_id", "name"), "source_id").join(n, "news_raw_id", "left").select("news_raw_id", "name", "title_raw", "risk", "published_at")


@query("select 'labelled' as side, count(*) as n from documents where doc_id in (select doc_id from labels) union all select 'unlabelled', count(*) from documents where doc_id not in (select doc_id from labels)")
def semi_anti(spark, sf):
    d, keys = tables.table(spark, sf, "documents").select("doc_id"), tables.table(spark, sf, "labels").select("doc_id")
    n = F.count(F.lit(1)).alias("n")
    return d.join(keys, "doc_id", "left_semi").agg(n).select(F.lit("labelled").alias("side"), "n").unionByName(d.join(keys, "doc_id", "left_anti").agg(n).select(F.lit("unlabelled").alias("side"), "n"))


@query(f"with {NEWS} select news_id, published_at from news where published_at is not null order by published_at desc, news_id limit 20 offset 20")
def feed_page(spark, sf):
    return serving.feed(_news(spark, sf), 2, 20).select("news_id", "published_at")


@query(f"with {NEWS} select news_id, source_id from news where published_at is not null and source_id = 3 order by published_at desc, news_id limit 10")
def feed_by_source(spark, sf):
    return serving.feed(_news(spark, sf), 1, 10, 3).select("news_id", "source_id")


@query(f"with {NEWS} select news_id, fake_score from news order by fake_score desc, published_at desc nulls last, news_id desc limit 25")
def top_risk(spark, sf):
    return _news(spark, sf).orderBy(F.desc("fake_score"), F.desc_nulls_last("published_at"), F.desc("news_id")).limit(25).select("news_id", "fake_score")


@query(f"with {NEWS} select source_id, count(*) as n, count(*) filter (fake_score >= 0.8) as high_risk, round(avg(fake_score), 6) as mean_score from news where published_at is not null group by source_id")
def risk_by_source(spark, sf):
    return _news(spark, sf).where("published_at is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("fake_score") >= serving.HIGH_RISK, 1)).alias("high_risk"), F.round(F.avg("fake_score"), 6).alias("mean_score"))


# --- set operations --------------------------------------------------------------------------------------
@query("select distinct url from (select url from pages union all select 'https://' || source || '.example/' || doc_id from documents)")
def url_union(spark, sf):
    return tables.table(spark, sf, "pages").select("url").union(tables.news_raw(spark, sf).select("original_url")).distinct()


@query("with t as (select doc_id, list_distinct(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')) as w from documents) select a.doc_id, cast(len(list_intersect(a.w, b.w)) as bigint) as shared, cast(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) as bigint) as united from t a join t b on b.doc_id = a.doc_id + 1")
def token_intersect(spark, sf):
    t = tables.table(spark, sf, "documents").select("doc_id", F.array_distinct(F.split(F.lower(tx.compact(F.col("text"))), " ")).alias("w"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return t.join(b, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"), F.size(F.array_union("w", "v")).cast("long").alias("united"))


@query("select distinct conv_id from conversations except select conv_id from conversations where role = 'system'")
def body_difference(spark, sf):
    c = tables.table(spark, sf, "conversations")
    return c.select("conv_id").distinct().join(c.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti")


# --- labels, splits, metrics ---------------------------------------------------------------------------
@query(f"with {LABELS} select gold as label, count(*) as n from scored group by gold")
def label_counts(spark, sf):
    return tables.scored_labels(spark, sf).groupBy(F.col("gold").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _split_sql(most: str = "n") -> str:
    return f"""{LABELS}, c as (select gold, count(*) as n from scored group by gold), o as (select doc_id as id, s.gold as label, row_number() over (partition by s.gold order by md5('42|' || doc_id)) - 1 as r, {most} as n from scored s join c on s.gold = c.gold),
    split as (select id, label, case when r < floor(n * 0.8) then 'train' when r < floor(n * 0.8) + floor(n * 0.1) then 'validation' else 'test' end as split from o where r < n)"""


_CAP = "least(n, (select cast(floor(min(n) * 1.5) as bigint) from c))"


@query(f"with {_split_sql()} select id, label, split from split")
def stratified_split(spark, sf):
    return datasets.stratified_split(tables.scored_labels(spark, sf).select(F.col("doc_id").alias("id"), F.col("gold").alias("label")))


@query(f"with {_split_sql(_CAP)} select id, label, split from split")
def capped_balance(spark, sf):
    return datasets.stratified_split(tables.scored_labels(spark, sf).select(F.col("doc_id").alias("id"), F.col("gold").alias("label")), most=1.5)


@query(f"with {_split_sql()} select split, label, count(*) as n from split group by rollup (split, label)")
def split_label_rollup(spark, sf):
    return stratified_split(spark, sf).rollup("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("with g as (select conv_id, count(*) as c from conversations group by conv_id), o as (select conv_id, coalesce(sum(c) over (order by md5('42|' || conv_id) rows between unbounded preceding and 1 preceding), 0) as before from g) select case when before < (select round_even(sum(c) * 0.1, 0) from g) then 'validation' else 'train' end as split, count(distinct conv_id) as groups, count(*) as n from conversations join o using (conv_id) group by 1")
def grouped_split(spark, sf):
    d = datasets.grouped_split(tables.table(spark, sf, "conversations"), "conv_id")
    return d.groupBy("split").agg(F.countDistinct("conv_id").alias("groups"), F.count(F.lit(1)).alias("n"))


@query(f"with {LABELS} select gold as label, count(*) as n, round((select count(*) from scored) / (2.0 * greatest(count(*), 1)), 6) as weight from scored group by gold")
def class_weights(spark, sf):
    d = metrics.class_weights(tables.scored_labels(spark, sf).withColumnRenamed("gold", "label"), ["true", "false"])
    return d.select("label", "n", F.round("weight", 6).alias("weight"))


_PRED = f"{LABELS}, p as (select gold, case when risk >= 0.5 then 'false' else 'true' end as pred from scored)"


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return tables.scored_labels(spark, sf).withColumn("pred", F.when(F.col("risk") >= 0.5, "false").otherwise("true"))


@query(f"with {_PRED}, l(x) as (values ('true'), ('false')) select a.x as gold, b.x as pred, count(p.gold) as n from l a cross join l b left join p on p.gold = a.x and p.pred = b.x group by 1, 2")
def confusion_matrix(spark, sf):
    return metrics.confusion(_predicted(spark, sf), ["true", "false"])


_REPORT = f"""{_PRED}, l(label) as (values ('true'), ('false')), s as (select label, (select count(*) from p where gold = label and pred = label) as t, (select count(*) from p where pred = label) as pp, (select count(*) from p where gold = label) as support from l),
    r as (select label, support, case when pp = 0 then 0 else t / pp end as precision, case when support = 0 then 0 else t / support end as recall from s),
    rep as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from r)"""


@query(f"with {_REPORT} select label, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from rep")
def class_report(spark, sf):
    r = metrics.class_report(_predicted(spark, sf), ["true", "false"])
    return r.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"with {_REPORT} select round(avg(f1), 6) as macro_f1, (select round(avg(case when gold = pred then 1.0 else 0 end), 6) from p) as accuracy from rep")
def macro_f1(spark, sf):
    p = _predicted(spark, sf)
    accuracy = p.agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"))
    return metrics.class_report(p, ["true", "false"]).agg(F.round(F.avg("f1"), 6).alias("macro_f1")).join(F.broadcast(accuracy))  # one row


@query(f"with {LABELS} select doc_id, case when risk >= 0.75 then 'likely_fake' when risk <= 0.35 then 'likely_real' else 'indeterminate' end as triage from scored")
def triage_labels(spark, sf):
    return tables.scored_labels(spark, sf).select("doc_id", scoring.triage(F.col("risk")).alias("triage"))


def _triage_sql(low: str, high: str) -> str:
    return f"""count(*) as n, count(*) filter (gold = 'true') as true_total, count(*) filter (gold = 'false') as false_total, count(*) filter (risk <= {low}) as pred_true, count(*) filter (risk > {low} and risk >= {high}) as pred_false,
    count(*) filter (risk <= {low} and gold = 'true') as tp_true, count(*) filter (risk > {low} and risk >= {high} and gold = 'false') as tp_false"""


_RATES = """case when pred_false = 0 then 0 else tp_false / pred_false end as false_precision, case when false_total = 0 then 0 else tp_false / false_total end as false_recall,
    case when pred_true = 0 then 0 else tp_true / pred_true end as true_precision, case when true_total = 0 then 0 else tp_true / true_total end as true_recall"""
_F1 = "(case when false_precision + false_recall = 0 then 0 else 2 * false_precision * false_recall / (false_precision + false_recall) end + case when true_precision + true_recall = 0 then 0 else 2 * true_precision * true_recall / (true_precision + true_recall) end) / 2"
_MET = ["false_precision", "false_recall", "true_precision", "true_recall", "macro_f1", "coverage", "decided_accuracy"]
_MET_SQL = ", ".join(f"round({m}, 6) as {m}" for m in _MET)


def _metric_columns(d: DataFrame, *more: str) -> DataFrame:
    return d.select(*more, "pred_true", "pred_false", "undecided", *[F.round(m, 6).alias(m) for m in _MET])


@query(f"with {LABELS}, c as (select {_triage_sql('0.35', '0.75')} from scored), r as (select *, n - pred_true - pred_false as undecided, {_RATES}, (pred_true + pred_false) / n as coverage, (tp_true + tp_false) / (pred_true + pred_false) as decided_accuracy from c), m as (select *, {_F1} as macro_f1 from r) select pred_true, pred_false, undecided, {_MET_SQL} from m")
def triage_metrics(spark, sf):
    return _metric_columns(metrics.evaluate_triage(tables.scored_labels(spark, sf), 0.35, 0.75))


@query(f"""with {LABELS}, x as (select distinct risk as v from scored union select 0.0 union select 1.0),
    k as (select v, (select count(*) from scored where risk <= v and gold = 'true') as tle, (select count(*) from scored where risk <= v) as le, (select count(*) from scored where risk >= v) as ge, (select count(*) from scored where risk >= v and gold = 'false') as fge from x),
    c as (select a.v as low, b.v as high, (select count(*) from scored) as n, (select count(*) from scored where gold = 'true') as true_total, (select count(*) from scored where gold = 'false') as false_total, a.le as pred_true, b.ge as pred_false, a.tle as tp_true, b.fge as tp_false from k a join k b on a.v < b.v),
    r as (select *, n - pred_true - pred_false as undecided, {_RATES}, (pred_true + pred_false) / n as coverage, case when pred_true + pred_false = 0 then 0 else (tp_true + tp_false) / (pred_true + pred_false) end as decided_accuracy from c), m as (select *, {_F1} as macro_f1 from r)
    select low, high, pred_true, pred_false, undecided, {_MET_SQL} from (select * from m where false_precision >= 0.9 and true_precision >= 0.8 and pred_false > 0 and pred_true > 0 order by round(coverage, 12) desc, round(macro_f1, 12) desc, round(decided_accuracy, 12) desc, round(false_precision + true_precision, 12) desc, low, high limit 1)""")
def fit_thresholds(spark, sf):
    return _metric_columns(metrics.fit_thresholds(tables.scored_labels(spark, sf)), "low", "high")


@query(f"""with {LABELS}, y as (select gold, 1 - risk as p from scored), x as (select distinct p as t from y union select 0.0 union select 1.0 union select 0.5),
    c as (select t, (select count(*) from y where p >= t and gold = 'true') as tp, (select count(*) from y where p >= t and gold = 'false') as fp, (select count(*) from y where p < t and gold = 'true') as fn, (select count(*) from y where p < t and gold = 'false') as tn from x)
    select t as threshold, round(m, 6) as macro_f1 from (select t, (case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end + case when 2 * tn + fp + fn = 0 then 0 else 2 * tn / (2 * tn + fp + fn) end) / 2 as m from c) order by round(m, 12) desc, abs(t - 0.5), t limit 1""")
def best_f1_threshold(spark, sf):
    rows = tables.scored_labels(spark, sf).select("gold", (1 - F.col("risk")).alias("p"))
    return metrics.best_f1_threshold(rows, "p").select("threshold", F.round("macro_f1", 6).alias("macro_f1"))


# --- dataset labels ----------------------------------------------------------------------------------------
@query(f"select min(doc_id) as doc_id, count(*) as copies from documents group by trim(regexp_replace({FOLDED}, '\\s+', ' ', 'g'))")
def dedupe_claims(spark, sf):
    d = tables.table(spark, sf, "documents").withColumn("k", tx.normalized(F.col("text")))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("k")


_values = registry.values


_TITLES = ["Es falso que llueve", "¿Subió? Es verdadero", "Dato impreciso del alcalde", "No, el congreso no votó", "Sin evidencia de ello", "Son falsas las cifras", "El acto fue ayer y no hoy", "Nada", "Parcialmente cierto", "Es ciérta la cifra"]
_FOLD = "trim(regexp_replace(lower(strip_accents(x)), '\\s+', ' ', 'g'))"


@query(f"""select x as title, case when contains(n, 'es falso') or contains(n, 'es falsa') or contains(n, 'false') then 'Falso' when contains(n, 'es verdadero') or contains(n, 'es verdadera') or contains(n, 'es cierto') or contains(n, 'es cierta') or contains(n, 'true') then 'Verdadero'
    when contains(n, 'impreciso') or contains(n, 'imprecisa') or contains(n, 'inexact') then 'Impreciso' when starts_with(n, 'son ') or contains(n, 'son fals') then 'Falso' when starts_with(n, 'no ') or starts_with(n, 'no,') or contains(substr(n, 1, 6), ' no ') then 'Falso'
    when contains(n, 'parcialmente falso') or contains(n, 'parcialmente cierto') then 'Falso' when contains(n, 'sin evidencia') then 'Sin Evidencia' when contains(n, ' no ') and contains(n, 'e') and (contains(n, 'fue') or contains(n, 'es')) then 'Falso' end as verdict from (select x, {_FOLD} as n from (values {_values(_TITLES)}) v(x))""")
def verdict_from_text(spark, sf):
    return spark.createDataFrame([(x,) for x in _TITLES], "title string").select("title", lb.verdict_from_title(F.col("title")).alias("verdict"))


_URLS = ["https://a.pe/x/es-falso-que-a", "https://a.pe/explicador/es-falso", "https://a.pe/no-subio", "https://a.pe/v/alcalde-miente", "https://a.pe/v/es-cierto-que-b", "https://a.pe/v/dato-impreciso-c", "https://a.pe/v/sin-evidencia", "https://a.pe/v/si-fue-ayer", "https://a.pe/v/el-no-de-hoy", "https://a.pe/v/nada"]


@query(f"""select x as url, case when contains(x, '/explicador') or contains(x, '/perucheck-') then null when contains(x, 'es-falso') or contains(x, '-falso-') or contains(x, '-falsa-') or contains(x, 'son-falsas') then 'Falso' when contains(x, 'es-verdadero') or contains(x, 'es-cierto') or contains(x, '-verdadero-') then 'Verdadero'
    when contains(x, 'es-impreciso') or contains(x, '-impreciso-') or contains(x, '-imprecisa-') then 'Impreciso' when contains(x, 'sin-evidencia') then 'Sin Evidencia' when starts_with(l, 'no-') or contains(x, '/no-') then 'Falso' when regexp_matches(l, 'apocrifa|miente|manipulada|no-es-asi|no-es-verdad|inverosimil|incierto|-no-') then 'Falso' when regexp_matches(l, 'si-tiene|si-fue|si-es|es-verdad') then 'Verdadero' end as verdict
    from (select x, regexp_extract(x, '([^/]*)$', 1) as l from (values {_values(_URLS)}) v(x))""")
def verdict_from_url(spark, sf):
    return spark.createDataFrame([(x,) for x in _URLS], "url string").select("url", lb.verdict_from_url(F.col("url")).alias("verdict"))


_RATINGS = ["Verdadero", "FALSO", "Impreciso", "sin evidencia", "Verdad a medias", "Engañoso", "bulo", "incorrect", "not enough info", "supported", "refuted", "1", "0", "true", "", "no", "half true", "cierto", "pants"]


@query(f"""select x as rating, case when contains(n, 'verdadero') or contains(n, 'cierto') then 'true' when contains(n, 'falso') or contains(n, 'impreciso') then 'false' end as perucheck,
    case when contains(n, 'verdad') and contains(n, 'media') then null when contains(n, 'verdadero') or n = 'true' then 'true' when contains(n, 'falso') or contains(n, 'bulo') then 'false' end as newtral, case when contains(n, 'verdadero') then 'true' when contains(n, 'falso') then 'false' end as maldita,
    case when n = '' then null when n = '1' then 'true' when n = '0' then 'false' when regexp_matches(n, 'not enough|nei|unknown|mixture|mixed|partly|half') then null when regexp_matches(n, 'true|support|correct|yes|verdadero|cierto') then 'true' when regexp_matches(n, 'false|refute|no|falso|bulo') then 'false' end as xfact,
    case when lower(trim(x)) in ('true', 'verdadero', 'real', '1') then 'true' when lower(trim(x)) in ('false', 'falso', 'fake', '0') then 'false' end as gold from (select x, {_FOLD} as n from (values {_values(_RATINGS)}) v(x))""")
def rating_labels(spark, sf):
    x = F.col("rating")
    return spark.createDataFrame([(r,) for r in _RATINGS], "rating string").select("rating", lb.perucheck_label(x).alias("perucheck"), lb.newtral_label(x).alias("newtral"), lb.maldita_label(x).alias("maldita"), lb.xfact_label(x).alias("xfact"), lb.gold_label(x).alias("gold"))


@query(f"select x as label, case x when 'half-true' then null when 'mostly-true' then 1 when 'true' then 1 else 0 end as strict, case x when 'half-true' then 1 when 'mostly-true' then 1 when 'true' then 1 else 0 end as relaxed from (values {_values(list(lx.LIAR))}) v(x)")
def liar_map(spark, sf):
    x = F.col("label")
    return spark.createDataFrame([(k,) for k in lx.LIAR], "label string").select("label", lb.liar_label(x).alias("strict"), lb.liar_label(x, "relaxed").alias("relaxed"))


# --- claims and scores -------------------------------------------------------------------------------------
def _claim_articles(spark: SparkSession, sf: str) -> DataFrame:
    return tables.news_raw(spark, sf).select(F.col("news_raw_id").alias("doc_id"), F.col("title_raw").alias("title"), F.col("content_raw").alias("body"))


@query(f"""with {RAW}, s as (select news_raw_id, title_raw as x, 4 as least from raw union all select news_raw_id, unnest(string_split(regexp_replace(content_raw, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))), 6 from raw)
    select news_raw_id as doc_id, count(*) as candidates from s where x <> '' and len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+')) between least and 40 and not regexp_matches(lower(strip_accents(x)), 'leer resumen|creditos:|puedes ver|lee tambien|te puede interesar|mas informacion|ultimas noticias|relacionado:|relacionada:')
    and not regexp_matches(x, '^\\s*[A-Z0-9]{{1,8}}([-/][A-Z0-9]{{1,8}}){{1,4}}\\b') and not regexp_matches(x, '^\\s*\\d{{4,}}\\b') and not regexp_matches(x, '^\\s*[-–—]\\S') group by 1""")
def claim_candidates(spark, sf):
    d = claims.candidates(_claim_articles(spark, sf)).where(claims.usable(claims.ClaimSettings()))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidates"))


def _any(x: str, markers: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{m}')" for m in markers) + ")"


def _starts(x: str, markers: list[str]) -> str:
    return "(" + " or ".join(f"starts_with({x}, '{m}')" for m in markers) + ")"


# no document reports, refutes or judges, so that all claims are sentences with an objective signal
_VERBATIM = f"""with {RAW}, s as (select news_raw_id, 0 as pos, 'title' as origin, title_raw as x, 4 as least from raw union all select news_raw_id, i, 'body', l[i], 6 from (select news_raw_id, l, unnest(range(1, len(l) + 1)) as i from (select news_raw_id, list_filter(string_split(regexp_replace(content_raw, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') as l from raw))),
    u as (select *, lower(strip_accents(x)) as low from s where x <> '' and len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+')) between least and 40 and not regexp_matches(x, '^\\s*[A-Z0-9]{{1,8}}([-/][A-Z0-9]{{1,8}}){{1,4}}\\b') and not regexp_matches(x, '^\\s*\\d{{4,}}\\b') and not regexp_matches(x, '^\\s*[-–—]\\S')),
    t as (select *, trim(regexp_replace(regexp_replace(trim(x, ' :;,."''()[]'), '(?i)^(?:{lx.DISCOURSE_CUT})\\s*,?\\s+', ''), '\\s+', ' ', 'g')) as target from u where not {_any("low", lx.NOISE)}),
    l as (select *, lower(strip_accents(target)) as lt from t),
    v as (select * from l where (regexp_matches(target, '[0-9]') or {_any("lt", lx.OFFICIAL)} or {_any("lt", lx.ACTIONS)}) and not {_any("lt", lx.WEAK_TARGETS)} and not {_starts("lt", lx.CONTEXT_STARTS)}
        and not {_any("' ' || lt || ' '", [f" {m.strip()} " for m in lx.FIRST_PERSON])} and not {_starts("lt", lx.FIRST_PERSON)} and not {_any("lt", lx.OPINION)} and not {_any("lt", lx.LOW_VALUE)} and not ends_with(x, '?') and not {_starts("lt", lx.QUESTIONS)}),
    f as (select * from v qualify row_number() over (partition by news_raw_id, trim(regexp_replace(lt, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) order by pos) = 1),
    n as (select *, row_number() over (partition by news_raw_id order by pos) - 1 as idx from f qualify idx < 30),
    g as (select *, round(case when origin = 'title' then 0.6 else 0 end + case when regexp_matches(x, '[0-9]') then 1.5 else 0 end + case when len(list_filter(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) >= 2 then 0.8 else 0 end + case when {_any("low", lx.CUES)} then 1.0 else 0 end
        + case when list_has_any(string_split_regex(low, '\\s+'), {lx.FACT_VERBS}) then 0.5 else 0 end + case when {_any("low", lx.OFFICIAL)} then 0.5 else 0 end + case when {_any("low", lx.ACTIONS)} then 0.8 else 0 end + case when {_starts("lt", lx.DISCOURSE_STARTS)} then -0.8 else 0 end
        + case when contains(x, ':') and regexp_matches(x, '["“”]') then -0.8 else 0 end, 4)::double as score from n)"""


@query(f"{_VERBATIM}, r as (select *, row_number() over (partition by news_raw_id order by score desc, idx) as rank from g) select news_raw_id as doc_id, rank, x as claim, target, 'verbatim' as mode, target as model_input, score from r where rank <= 3")
def claim_top3(spark, sf):
    return claims.extract_claims(_claim_articles(spark, sf)).drop("quality_reasons")


@query(f"{_VERBATIM} select news_raw_id as doc_id, idx, 'verbatim' as mode, score from g")
def claim_scores(spark, sf):
    return claims.scored_candidates(_claim_articles(spark, sf)).select("doc_id", "idx", "mode", "score")


_PROBS = "probs as (select doc_id, quality, toxic, ((doc_id * 31) % 97) / 97.0 as pf, ((doc_id * 17) % 50) / 101.0 as ag, ((doc_id * 13) % 30) / 103.0 as di, ((doc_id * 7) % 20) / 107.0 as un from labels), full_probs as (select *, 1 - pf as pt, 1 - ag - di - un as dg from probs)"
_SIGNALS = "sig as (select doc_id, quality, (ag + 0.35 * di + 0.05 * un) / greatest(ag + 0.35 * di + 0.05 * un + 0.1 * di + dg, 1) as s, (0.1 * di + dg) / greatest(ag + 0.35 * di + 0.05 * un + 0.1 * di + dg, 1) as r, pf, pt from full_probs)"


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    d = tables.table(spark, sf, "labels").withColumns({"p_false": ((i * 31) % 97) / 97.0, "stance_agree": ((i * 17) % 50) / 101.0, "stance_discuss": ((i * 13) % 30) / 103.0, "stance_unrelated": ((i * 7) % 20) / 107.0})
    d = d.withColumn("p_true", 1 - F.col("p_false")).withColumn("stance_disagree", 1 - F.col("stance_agree") - F.col("stance_discuss") - F.col("stance_unrelated"))
    return scoring.claim_signals(d)


@query(f"with {_PROBS}, {_SIGNALS} select doc_id, round(s, 4) as support_score, round(r, 4) as refute_score, round(pf * s, 4) as fake_risk, round(pt * s + pf * r, 4) as real_support from sig")
def claim_signals(spark, sf):
    return _signals(spark, sf).select("doc_id", "support_score", "refute_score", "fake_risk", "real_support")


@query(f"with {_PROBS}, {_SIGNALS}, a as (select doc_id // 3 as doc_id, (2 * sum(cast(round(round(pf * s, 4) * 10000) as bigint)) + count(*)) // (2 * count(*)) / 10000.0 as m, count(*) as claims from sig group by 1) select doc_id, m as risk, claims, case when m >= 0.5 then 'False' else 'True' end as label from a")
def article_risk(spark, sf):
    d = scoring.article_risk(_signals(spark, sf).withColumn("doc_id", F.expr("doc_id div 3")))
    return d.select("doc_id", "risk", "claims", "label")


@query("select u.conv_id, u.turn, md5(u.text) as headline, md5(a.text) as body from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'")
def stance_pairs(spark, sf):
    c = tables.table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5(F.col("text").cast("binary")).alias("body"))
    return c.where("role = 'user'").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("headline")).join(a, ["conv_id", "turn"])


_ROUGE = """n as (select count(*) as n from benchmark), d as (select doc_id as id, doc_id % n as k, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as t from documents, n), r as (select item_id as k, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as t from benchmark),
    ct as (select id, k, i, t[i] as x, t[i + 1] as y, len(t) as n from (select id, k, t, unnest(range(1, len(t) + 1)) as i from d)), rt as (select k, i, t[i] as x, t[i + 1] as y, len(t) as n from (select k, t, unnest(range(1, len(t) + 1)) as i from r))"""


def _rouge_sql(n: int) -> str:
    gram, last = ("x", "true") if n == 1 else ("x || ' ' || y", "i < n")
    return f"""with {_ROUGE}, c as (select id, k, {gram} as g, count(*) as m from ct where {last} group by all), b as (select k, {gram} as g, count(*) as m from rt where {last} group by all),
    o as (select c.id, sum(least(c.m, b.m)) as o from c join b on b.k = c.k and b.g = c.g group by c.id), s as (select d.id, o.o, greatest(len(d.t) - {n - 1}, 0) as nc, greatest(len(r.t) - {n - 1}, 0) as nr from d join r using (k) left join o on o.id = d.id)
    select id, round(case when coalesce(o, 0) = 0 then 0 else 2 * (o / nc) * (o / nr) / (o / nc + o / nr) end, 6) as f1 from s"""


# the rows of the dynamic program as the bits of one number, a reference has fewer than 120 words
_LCS = f"""with {_ROUGE}, m as (select k, x, sum(1::hugeint << (i - 1)::hugeint)::hugeint as m from rt group by all), l as (select ct.id, list(m.m order by ct.i) as ms from ct join m on m.k = ct.k and m.x = ct.x group by ct.id),
    z as (select d.id, len(d.t) as nc, len(r.t) as nr, (1::hugeint << len(r.t)::hugeint) - 1::hugeint as f, coalesce(ms, []::hugeint[]) as ms from d join r using (k) left join l on l.id = d.id),
    s as (select id, nc, nr, nr - bit_count(list_reduce(list_prepend(f, ms), lambda v, m: (((v + (v & m)) & f) | (v - (v & m))))) as o from z)
    select id, round(case when o = 0 then 0 else 2 * (o / nc) * (o / nr) / (o / nc + o / nr) end, 6) as f1 from s"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("reference"))
    n = b.agg(F.count(F.lit(1)).alias("n"))
    d = tables.table(spark, sf, "documents").join(F.broadcast(n)).select(F.col("doc_id").alias("id"), F.col("text").alias("candidate"), (F.col("doc_id") % F.col("n")).alias("k"))  # one row
    return d.join(b, "k").select("id", "candidate", "reference")


@query(_rouge_sql(1))
def rouge1(spark, sf):
    return metrics.rouge_n(_pairs(spark, sf), 1).select("id", F.round("f1", 6).alias("f1"))


@query(_rouge_sql(2))
def rouge2(spark, sf):
    return metrics.rouge_n(_pairs(spark, sf), 2).select("id", F.round("f1", 6).alias("f1"))


@query(_LCS)
def rougeL(spark, sf):
    return metrics.rouge_l(_pairs(spark, sf)).select("id", F.round("f1", 6).alias("f1"))


@query(f"select case id % 3 when 0 then 'lead' when 1 then 'short' else 'long' end as model, count(*) as n, round(avg(f1), 6) as rouge1 from ({_rouge_sql(1)}) group by 1")
def model_leaderboard(spark, sf):
    model = F.when(F.col("id") % 3 == 0, "lead").when(F.col("id") % 3 == 1, "short").otherwise("long")
    return rouge1(spark, sf).groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("rouge1"))


# --- pages, urls, json -----------------------------------------------------------------------------------
@query("select page_id, count(*) as paragraphs, cast(sum(length(trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))) as bigint) as chars from (select page_id, unnest(regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1)) as x from pages) group by page_id")
def html_paragraphs(spark, sf):
    d = html.paragraphs(tables.table(spark, sf, "pages"))
    return d.groupBy("page_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("select page_id, i - 1 as pos, case when regexp_matches(x, '^https?://') then x else h || case when starts_with(x, '/') then '' else '/' end || x end as url from (select page_id, regexp_extract(url, '^(https?://[^/]+)', 1) as h, unnest(l) as x, generate_subscripts(l, 1) as i from (select page_id, url, regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)[1:10] as l from pages))")
def html_title_links(spark, sf):
    return html.links(tables.table(spark, sf, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "url")


@query("""select page_id, replace(replace(replace(replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&') as headline, null::varchar as claim, null::varchar as rating, null::varchar as date from pages""")
def html_fact_checks(spark, sf):
    return html.fact_checks(tables.table(spark, sf, "pages")).select("page_id", "headline", "claim", "rating", "date")


@query("select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9_+.-]*://([^/?#]*)', 1)), '^www\\.', '') as domain from pages")
def url_domain(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", tx.domain(F.col("url")).alias("domain"))


_SLUGS = ["https://a.pe/x/el-alcalde-de-lima-renuncio-noticia/", "https://a.pe/p/dos-palabras.html", "https://a.pe/p/tres-palabras-aqui.html", "https://a.pe/", "https://a.pe/uno"]


@query(f"""with s as (select x, regexp_replace(regexp_replace(regexp_extract(trim(regexp_extract(x, '://[^/]*(.*)$', 1), '/'), '([^/]*)$', 1), '-noticia/?$', ''), '\\.(html|htm)$', '') as s from (values {_values(_SLUGS)}) v(x)), w as (select x, list_filter(string_split(s, '-'), lambda y: y <> '') as l from s)
    select x as url, case when len(l) >= 3 then array_to_string(list_transform(l, lambda y, i: case when i > 1 and y in ({", ".join(f"'{w}'" for w in lx.SMALL_WORDS)}) then y else upper(y[1]) || lower(y[2:]) end), ' ') end as title from w""")
def slug_title(spark, sf):
    return spark.createDataFrame([(x,) for x in _SLUGS], "url string").select("url", tx.slug_title(F.col("url")).alias("title"))


@query("select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by event_type")
def json_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return tables.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query(f"with {_PROBS}, u as (select doc_id, i, label, p from (select doc_id, unnest([1, 2, 3]) as i, unnest(['agree', 'discuss', 'unrelated']) as label, unnest([ag, di, un]) as p from probs)) select doc_id, string_agg(label, '>' order by p desc, i) as ranking from u group by doc_id")
def ranking_sort(spark, sf):
    r = scoring.ranking({k: F.col(f"stance_{k}") for k in ("agree", "discuss", "unrelated")})
    return _signals(spark, sf).select("doc_id", F.array_join(F.transform(r, lambda x: x.label), ">").alias("ranking"))


@query(f"with {_PROBS} select doc_id, case when quality = 1 then 'claim ' || doc_id else '' end as claim_text, printf('%.4f', pf) as risk, 'agree | discuss' as stances from probs")
def nested_flatten(spark, sf):
    listed = F.when(F.col("quality") == 1, F.array(F.struct(F.concat(F.lit("claim "), F.col("doc_id").cast("string")).alias("text"), F.array(F.lit("agree"), F.lit("discuss")).alias("stances"))))
    d = _signals(spark, sf).withColumn("claims", listed)
    return d.select("doc_id", F.coalesce(F.get("claims", F.lit(0)).text, F.lit("")).alias("claim_text"), F.format_string("%.4f", "p_false").alias("risk"), F.array_join(F.array(F.lit("agree"), F.lit("discuss")), " | ").alias("stances"))


# --- interactions --------------------------------------------------------------------------------------------
def _reactions(spark: SparkSession, sf: str) -> DataFrame:
    reaction = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return tables.table(spark, sf, "events").where("event_type in ('purchase', 'error', 'signup')").select("event_id", "user_id", (F.col("event_id") % 100).alias("news_id"), reaction.alias("reaction"), F.col("ts").alias("created_at"))


@query("select user_id, event_id % 100 as news_id, arg_max(case event_type when 'purchase' then 1 when 'error' then -1 else 0 end, (ts, event_id)) as reaction from events where event_type in ('purchase', 'error', 'signup') group by all having arg_max(case event_type when 'purchase' then 1 when 'error' then -1 else 0 end, (ts, event_id)) <> 0")
def reactions_latest(spark, sf):
    return serving.latest_reactions(_reactions(spark, sf))


@query("select event_id % 100 as news_id, count(*) as views, count(*) filter (floor(value) >= 10) as engaged from events where event_type = 'view' group by 1")
def engaged_views(spark, sf):
    v = tables.table(spark, sf, "events").where("event_type = 'view'").select((F.col("event_id") % 100).alias("news_id"), F.floor("value").alias("time_spent_sec"))
    return v.groupBy("news_id").agg(F.count(F.lit(1)).alias("views"), F.count(F.when(F.col("time_spent_sec") >= 10, 1)).alias("engaged"))


@query("select cast(ts as date) as day, count(*) as clicks, count(distinct user_id) as users from events where event_type = 'click' group by 1")
def click_counts(spark, sf):
    return tables.table(spark, sf, "events").where("event_type = 'click'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("clicks"), F.countDistinct("user_id").alias("users"))


# --- evidence --------------------------------------------------------------------------------------------------
_SOURCES = [("https://www.rpp.pe/a", "x"), ("https://es.wikipedia.org/wiki/A", "RPP"), ("https://blog.example/a", "El Comercio"), ("https://blog.example/b", "otro"), ("", "RPP"), ("https://sub.elcomercio.pe/a?x=1", ""), ("https://notrpp.pe/a", ""), ("https://x.com/a", "Gestión"), ("https://a.pe:8080/b/", "Gestión")]
_OUT_NAMES = "|".join(n for n, _ in lx.OUTLETS.values())
_OUT_DOMAINS = "|".join(d.replace(".", "\\.") for _, d in lx.OUTLETS.values())
_SRC_SQL = ", ".join(f"('{u}', '{n}')" for u, n in _SOURCES)


@query(f"""select u as url, n as source, d <> '' and not regexp_matches(d, '(^|\\.)({"|".join(x.replace(".", chr(92) + ".") for x in lx.BLOCKED_DOMAINS)})$') and (regexp_matches(lower(strip_accents(n)), '{_OUT_NAMES}') or regexp_matches(d, '(^|\\.)({_OUT_DOMAINS})$')) as allowed
    from (select u, n, regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), '^www\\.', '') as d from (values {_SRC_SQL}) v(u, n))""")
def evidence_filter(spark, sf):
    return spark.createDataFrame(_SOURCES, "url string, source string").select("url", "source", evidence.allowed(F.col("url"), F.col("source")).alias("allowed"))


@query(f"""select u as url, n in ('x', '') or d = 'rpp.pe' as listed, d in ('rpp.pe', 'blog.example') as grounded from (select u, n, regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), '^www\\.', '') as d from (values {_SRC_SQL}) v(u, n))""")
def grounded_match(spark, sf):
    others = F.array(F.lit("https://rpp.pe/otra"), F.lit("http://blog.example/b/"))
    d = spark.createDataFrame(_SOURCES, "url string, source string")
    return d.select("url", (F.col("source").isin("x", "") | (tx.domain(F.col("url")) == "rpp.pe")).alias("listed"), evidence.grounded(F.col("url"), others).alias("grounded"))


# --- streams: the jobs run over what is there, and their sinks are read back ----------------------------
_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.read_stream(spark, f"{sf}/events.parquet", _EVENTS)


def _sunk(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a job wrote to its table, with the number of the micro-batch."""
    out = work_folder(spark, name)
    jobs.run_available(stream, jobs.table_sink(f"{out}/table"), f"{out}/checkpoint", mode)
    return spark.read.parquet(f"{out}/table")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def stream_windows(spark, sf):
    rows = _sunk(spark, jobs.window_counts(_stream(spark, sf), "ts"), "windows", "update")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by all")
def stream_dedupe(spark, sf):
    rows = _sunk(spark, jobs.dedupe_stream(_stream(spark, sf), ["user_id", "event_type"], "ts", "60 days"), "dedupe", "append")
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minutes then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def stream_sessions(spark, sf):
    rows = _sunk(spark, jobs.session_counts(_stream(spark, sf), "ts"), "sessions", "complete")
    last = rows.agg(F.max("batch").alias("batch"))  # one row
    return rows.join(F.broadcast(last), "batch").select("user_id", "start", "n")


# --- summaries, training and caches ---------------------------------------------------------------------------
@query(f"with {RAW} select news_raw_id, length(content_raw) >= 700 as wants_summary, case when length(content_raw) >= 700 then array_to_string(list_filter(string_split(regexp_replace(content_raw, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '')[1:3], ' ') else substr(content_raw, 1, 600) end as summary from raw")
def lead_summaries(spark, sf):
    t = F.col("content_raw")
    return tables.news_raw(spark, sf).select("news_raw_id", summaries.wants_summary(t).alias("wants_summary"), summaries.lead_summary(t).alias("summary"))


@query(f"with {LABELS}, c as (select gold, count(*) as n from scored group by gold) select doc_id, round((select count(*) from scored) / n, 6) as weight from scored join c using (gold)")
def sample_weights(spark, sf):
    return training.sample_weights(tables.scored_labels(spark, sf), "gold").select("doc_id", F.round("weight", 6).alias("weight"))


_HISTORY = [(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.6), (5, 0.8)]


@query("with h(epoch, score) as (values (1, 0.5), (2, 0.7), (3, 0.7), (4, 0.6), (5, 0.8)), b as (select *, coalesce(score > max(score) over (order by epoch rows between unbounded preceding and 1 preceding), true) as better from h), c as (select epoch, score, max(score) over w as best_so_far, max(case when better then epoch end) over w as best_epoch from b window w as (order by epoch)) select *, epoch - best_epoch as since_best, max(case when epoch - best_epoch >= 2 then 1 else 0 end) over (order by epoch) = 1 as stopped from c")
def early_stopping(spark, sf):
    return training.early_stop(spark.createDataFrame(_HISTORY, "epoch int, score double"))


@query("select cast(ts - interval 5 hours as date) as day, count(*) as n from events group by 1")
def lima_days(spark, sf):
    return tables.table(spark, sf, "events").groupBy(F.to_date(F.from_utc_timestamp("ts", "America/Lima")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("with o as (select event_id, user_id, ts, epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events) select user_id, count(*) filter (gap is null or gap >= 1800) as sessions, count(*) as n from o group by user_id")
def sessions(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    d = tables.table(spark, sf, "events").select("user_id", gap.alias("gap"))
    return d.groupBy("user_id").agg(F.count(F.when(F.col("gap").isNull() | (F.col("gap") >= 1_800_000_000), 1)).alias("sessions"), F.count(F.lit(1)).alias("n"))


@query("select role, count(*) as n, cast(sum(length(text)) as bigint) as chars from conversations group by role")
def turns_by_role(spark, sf):
    return tables.table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
