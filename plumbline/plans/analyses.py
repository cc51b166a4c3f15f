"""Queries over analysed articles: claims with stances, fallbacks, stored predictions, selection, export and re-analysis.

Articles with known claims are made for each document; scorers go by lengths alone, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, scoring, selection
from ..operators.analysis import AnalysisSettings
from ..sources import tables
from . import publishing
from .registry import RAW, SOURCE_ID, isoformat, query, token_list


class LengthScorer:
    """p_false from the length of the text."""

    def score(self, rows: DataFrame, text: str) -> DataFrame:
        p = F.round(F.length(text) % 97 / 97.0, 4)
        return rows.withColumn("p_false", p).withColumn("p_true", F.round(1 - p, 4))


class LengthStance:
    def score(self, rows: DataFrame, head: str, body: str) -> DataFrame:
        d = rows.withColumns({"stance_agree": F.length(head) % 10 / 21.0, "stance_discuss": F.length(body) % 10 / 43.0, "stance_unrelated": F.lit(0.1)})
        return d.withColumn("stance_disagree", 0.9 - F.col("stance_agree") - F.col("stance_discuss"))


SETTINGS = AnalysisSettings(veracity=LengthScorer(), stance=LengthStance())


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Of every five documents: one with a reported claim, one with a refuted one as well, one without a claim, one that is a title alone, and one without text."""
    i = F.col("doc_id").cast("string")
    told = F.concat(F.lit("El alcalde asegura que la obra numero "), i, F.lit(" cuesta "), i, F.lit(" soles al distrito."))
    denied = F.concat(told, F.lit(" La ministra niega que el hospital "), i, F.lit(" cerro en marzo de 2020."))
    k = F.col("doc_id") % 5
    content = F.when(k == 0, told).when(k == 1, denied).when(k == 2, F.concat(F.lit("Hubo sol en "), i, F.lit(".")))
    title = F.when(k == 3, F.concat(F.lit(" Titulo  corto "), i)).when(k == 4, " ").otherwise(F.concat(F.lit("Nota "), i))
    return tables.table(spark, sf, "documents").select("doc_id", title.alias("title"), content.alias("content"), F.lit(None).cast("string").alias("text"))


_ARTICLES = """with a as (select doc_id, doc_id % 5 as k, 'El alcalde asegura que la obra numero ' || doc_id || ' cuesta ' || doc_id || ' soles al distrito' as told, 'La ministra niega que el hospital ' || doc_id || ' cerro en marzo de 2020' as denied from documents where doc_id % 5 <> 4),
    t as (select doc_id, k, told, denied, case when k = 3 then 'Titulo corto ' || doc_id else 'Nota ' || doc_id end as head, case k when 0 then told || '.' when 1 then told || '. ' || denied || '.' when 2 then 'Hubo sol en ' || doc_id || '.' else 'Titulo corto ' || doc_id end as body from a),
    items as (select doc_id, m, case when starts_with(lower(body), lower(head)) then body else head || '. ' || body end as ctx from (select doc_id, told as m, head, body from t where k in (0, 1) union all select doc_id, denied, head, body from t where k = 1)),
    scored as (select *, round(length(m) % 97 / 97.0, 4) as pf, length(m) % 10 / 21.0::double as ag, length(ctx) % 10 / 43.0::double as di from items),
    sides as (select *, round(1 - pf, 4) as pt, 0.9::double - ag - di as dg from scored),
    sums as (select *, ag + 0.35::double * di + 0.05::double * 0.1::double as s0, 0.1::double * di + dg as r0 from sides), sig as (select *, s0 / greatest(s0 + r0, 1) as s, r0 / greatest(s0 + r0, 1) as r from sums),
    signals as (select doc_id, m, ctx, pf, pt, ag, di, dg, round(s, 4) as support_score, round(r, 4) as refute_score, round(pf * s, 4) as fake_risk, round(pt * s + pf * r, 4) as real_support from sig)"""


def _mean(x: str) -> str:
    return f"(2 * sum(cast(round({x} * 10000) as bigint)) + count(*)) // (2 * count(*)) / 10000.0"


_TRIAGE = "case when risk >= 0.75 then 'likely_fake' when risk <= 0.35 then 'likely_real' else 'indeterminate' end"


def _result(mean: str, real: str, method: str, threshold: float = 0.5) -> str:
    return f"""{_ARTICLES}, means as (select doc_id, {mean} as m, {real} as real_support, count(*) as n from signals group by doc_id),
    r as (select t.doc_id, t.head, t.body, m is not null as claim_based, coalesce(n, 0) as selected, real_support, case when m is null then round(length(body) % 97 / 97.0, 4) else m end as risk from t left join means using (doc_id)),
    o as (select *, case when claim_based then case when risk >= {threshold} then 'False' else 'True' end when round(1 - risk, 4) >= 0.5 then 'True' else 'False' end as label, case when claim_based then '{method}' else 'direct_dedicated_classifier' end as method from r)"""


_SHOWN = f"""doc_id, label, case label when 'False' then 'falso' else 'verdadero' end as display_label, case label when 'False' then 'fake' else 'real' end as bucket, label = 'False' as is_fake, cast(risk as double) as risk, {_TRIAGE} as triage,
    case {_TRIAGE} when 'likely_fake' then 'probable falso' when 'likely_real' then 'probable verdadero' else 'indeterminado' end as triage_display, method, claim_based, cast(real_support as double) as real_support, cast(selected as int) as selected, cast(length(body) as int) as content_length"""


def shown(d: DataFrame) -> DataFrame:
    f = "fake_news."
    return d.select(
        "doc_id", f + "label", f + "display_label", f + "bucket", f + "is_fake", F.col(f + "risk_score").alias("risk"), F.col(f + "triage_label").alias("triage"), f + "triage_display", F.col(f + "aggregation_method").alias("method"),
        f + "claim_based", f + "real_support", (F.col(f + "claims.selected") if "selected" in d.schema["fake_news"].dataType["claims"].dataType.names else F.lit(0)).alias("selected"), F.col("input.content_length").alias("content_length"),
    )


@query(f"{_result(_mean('fake_risk'), _mean('real_support'), 'claim_veracity_x_article_stance')} select {_SHOWN} from o")
def analyze_articles(spark, sf):
    return shown(analysis.analyze(articles(spark, sf), SETTINGS))


@query(f"{_result(_mean('pf'), 'round(1 - ' + _mean('pf') + ', 4)', 'claim_veracity_only')} select {_SHOWN}, 1 as warnings from o")
def analyze_without_stance(spark, sf):
    d = analysis.analyze(articles(spark, sf), AnalysisSettings(veracity=LengthScorer(), stance=None))
    return shown(d).join(d.select("doc_id", F.size("warnings").alias("warnings")), "doc_id")


@query(f"{_ARTICLES}, r as (select doc_id, body, round(length(body) % 97 / 97.0, 4) as risk from t), o as (select *, case when round(1 - risk, 4) >= 0.5 then 'True' else 'False' end as label, 'direct_dedicated_classifier' as method, false as claim_based, null as real_support, null as selected from r) select {_SHOWN} from o")
def analyze_direct(spark, sf):
    return shown(analysis.analyze(articles(spark, sf), AnalysisSettings(veracity=LengthScorer(), use_claims=False)))


@query(f"""{_ARTICLES} select doc_id, m as model_input, cast(support_score as double) as support_score, cast(refute_score as double) as refute_score, cast(fake_risk as double) as fake_risk, cast(real_support as double) as real_support, case when contains(m, 'niega') then 'refutation_projected' else 'reported_claim' end as mode from signals""")
def analysed_claims(spark, sf):
    items = analysis.claim_items(analysis.texts(articles(spark, sf)), SETTINGS)
    return items.select("doc_id", "model_input", "support_score", "refute_score", "fake_risk", "real_support", "mode")


_STANCE = """st as (select doc_id, [0.1::double, length(body) % 10 / 43.0::double, length(head) % 10 / 21.0::double, 0.9::double - length(head) % 10 / 21.0::double - length(body) % 10 / 43.0::double] as p from t),
    best as (select doc_id, p, ['unrelated', 'discuss', 'agree', 'disagree'][list_position(p, list_max(p))] as label from st)"""


@query(f"{_ARTICLES}, {_STANCE} select doc_id, label, case label when 'unrelated' then 'sin relacion' when 'discuss' then 'discusion' when 'agree' then 'a favor' else 'en contra' end as display_label, round(list_max(p), 4) as confidence from best")
def stance_decorated(spark, sf):
    d = analysis.analyze(articles(spark, sf), SETTINGS)
    return d.select("doc_id", "stance.label", "stance.display_label", "stance.confidence")


@query(f"""{_result(_mean('fake_risk'), _mean('real_support'), 'x')}, {_STANCE} select o.doc_id as representative_id, b.label as sentiment_label, round(list_max(b.p), 4) as sentiment_score, cast(risk as double) as fake_score, o.label as fake_label, case o.label when 'False' then 'fake' else 'real' end as fake_bucket from o join best b using (doc_id)""")
def stored_predictions(spark, sf):
    return analysis.predictions(analysis.analyze(articles(spark, sf), SETTINGS), "v").select("representative_id", "sentiment_label", "sentiment_score", "fake_score", "fake_label", "fake_bucket")


@query(f"{_ARTICLES} select doc_id, round(case when k in (0, 1) then 0.25 else round(length(body) % 97 / 97.0, 4) end, 4)::double as risk, case when k in (0, 1) then 'claims' else 'article' end as source from t")
def claim_fallback(spark, sf):
    t = analysis.texts(articles(spark, sf))
    risks = t.where("doc_id % 5 in (0, 1)").select("doc_id", F.lit(0.25).alias("risk"))
    return scoring.with_fallback(t.select("doc_id"), risks, LengthScorer().score(t, "article_text")).select("doc_id", "risk", "source")


@query(f"""with {RAW}, tok as (select news_raw_id as doc_id, list_distinct({token_list('title_raw')}) as h, list_distinct({token_list('content_raw')}) as b from raw), z as (select doc_id, case when len(h) = 0 then 0.0 else len(list_intersect(h, b)) / len(h) end as s from tok),
    e as (select doc_id, [exp(2 - 4 * s), exp(0.5), exp(3 * s), exp(0)] as e from z) select doc_id, round(e[3] / list_sum(e), 4) as agree, round(e[1] / list_sum(e), 4) as unrelated from e""")
def overlap_stance(spark, sf):
    """The stand-in on titles and contents; no document denies anything."""
    d = analysis.OverlapStance().score(tables.news_raw(spark, sf).select(F.col("news_raw_id").alias("doc_id"), "title_raw", "content_raw"), "title_raw", "content_raw")
    return d.select("doc_id", F.col("stance_agree").alias("agree"), F.col("stance_unrelated").alias("unrelated"))


@query(f"with {RAW}, p as (select news_raw_id as doc_id, round(1 / (1 + exp(-(len(regexp_extract_all(title_raw, '[A-Z!?0-9]')) / greatest(length(title_raw), 1) * 20 - 1.5))), 4) as p_false from raw) select doc_id, p_false, case when round(1 - p_false, 4) >= 0.6 then 'True' else 'False' end as label from p")
def predict_titles(spark, sf):
    """The whole text's veracity by the lexical stand-in, with a threshold of 0.6."""
    d = tables.news_raw(spark, sf).select(F.col("news_raw_id").alias("doc_id"), F.col("title_raw").alias("t"))
    return analysis.whole_article(d, AnalysisSettings(decision=0.6), "t").select("doc_id", "p_false", "label")


# --- selection and export --------------------------------------------------------------------------------
_JOINED = f"""{publishing.STORED}, names as (select distinct {SOURCE_ID} as source_id, source as name from documents where {SOURCE_ID} % 7 <> 3),
    joined as (select p.news_raw_id as representative_id, p.source_id, n.name as source_name, p.clean_text, p.published_at as processed_at, o.title_raw, o.original_url, s.news_id, s.published_at from processed p join own o using (news_raw_id) left join names n on n.source_id = p.source_id left join served s on s.representative_id = p.news_raw_id)"""


def _joined(spark: SparkSession, sf: str, need_source: bool = False) -> DataFrame:
    names = tables.sources(spark, sf).where("is_active").select(F.col("source_id").cast("long").alias("source_id"), "name")
    return selection.joined(publishing.processed(spark, sf), publishing.raw(spark, sf), names, publishing.news(spark, sf), need_source)


@query(f"""{_JOINED}, pick as (select 'published' as kind, * from (select representative_id, news_id, source_name from joined where published_at is not null and trim(clean_text) <> '' order by published_at desc, representative_id limit 15) union all
    select 'processed', * from (select representative_id, news_id, source_name from joined where source_id = 4 and trim(clean_text) <> '' order by processed_at desc, representative_id limit 5) union all
    select 'named', representative_id, news_id, source_name from joined where representative_id in (5, 17, 30) and trim(clean_text) <> '' union all select 'news', representative_id, news_id, source_name from joined where news_id in (2, 4) and trim(clean_text) <> '') select * from pick""")
def select_targets(spark, sf):
    d = _joined(spark, sf)
    some = {"published": selection.select_targets(d, limit=15), "processed": selection.select_targets(d, source_id=4, all_processed=True, limit=5), "named": selection.select_targets(d, [5, 17, 30]), "news": selection.select_targets(d, news_ids=[2, 4])}
    out = None
    for kind, rows in some.items():
        part = rows.select(F.lit(kind).alias("kind"), "representative_id", "news_id", "source_name")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""{_JOINED} select cast(j.representative_id as varchar) as representative_id, cast(news_id as varchar) as news_id, source_name, {isoformat("j.published_at")} as published_at, md5(coalesce(title_raw, '')) as title, printf('%.4f', fake_score) as stored_fake_score, sentiment_label as stored_sentiment_label, '' as analysis_risk_score, '' as manual_gold
    from joined j join predictions p on p.representative_id = j.representative_id where source_name is not null and fake_score between 0.2 and 0.9 and j.published_at is not null order by fake_score desc, j.published_at desc, j.representative_id desc limit 20""")
def export_calibration(spark, sf):
    kept = publishing.predictions(spark, sf).withColumn("sentiment_label", F.coalesce("sentiment_label", F.lit("unknown")))
    d = selection.export_rows(selection.calibration_rows(_joined(spark, sf, True), kept, 0.2, 0.9), limit=20)
    return d.select("representative_id", "news_id", "source_name", "published_at", F.md5(F.col("title").cast("binary")).alias("title"), "stored_fake_score", "stored_sentiment_label", "analysis_risk_score", "manual_gold")


_ANALYSED = _result(_mean("fake_risk"), _mean("real_support"), "claim_veracity_x_article_stance")


@query(f"""{_ANALYSED} select cast(doc_id as varchar) as representative_id, printf('%.4f', risk) as analysis_risk_score, {_TRIAGE} as analysis_triage_label, label as analysis_fake_label, 'True' as analysis_claim_based, 'ok' as top_claim_quality, '' as warnings, '' as error from o where claim_based""")
def export_reanalyzed(spark, sf):
    """The export with live analyses: only articles with a claim."""
    a = analysis.analyze(articles(spark, sf), SETTINGS)
    rows = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("representative_id"), F.lit(None).cast("long").alias("news_id"), F.lit(1).cast("long").alias("source_id"), F.lit("s").alias("source_name"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("t").alias("title_raw"), F.lit("u").alias("original_url"), F.lit(0.5).alias("fake_score"), F.lit("l").alias("sentiment_label"))
    return selection.export_rows(rows, a).select("representative_id", "analysis_risk_score", "analysis_triage_label", "analysis_fake_label", "analysis_claim_based", "top_claim_quality", "warnings", "error")


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    """Exported rows: some with a stored article, some with a text of their own, some without either, with notes."""
    i = F.col("doc_id")
    d = tables.table(spark, sf, "documents").select(i.alias("row"), F.when(i % 7 == 0, "x").when(i % 7 == 1, "").otherwise(i.cast("string")).alias("representative_id"), F.when(i % 14 == 0, " ").otherwise("Hubo sol.").alias("title"), F.lit("").alias("top_claim_model_input"))
    return d.withColumns({**{c: F.lit("") for c in selection.ANALYSIS if c != "top_claim_model_input"}, "notes": F.concat(F.lit("nota "), F.col("row").cast("string"))})


@query("""with e as (select doc_id, case when doc_id % 7 in (0, 1) or doc_id % 5 = 4 then case when doc_id % 14 = 0 then 'missing' else 'csv' end else 'db' end as origin from documents),
    x as (select doc_id, origin, case origin when 'csv' then 'Hubo sol.' end as t from e) select doc_id as row, origin, case origin when 'missing' then 'missing_text' else '' end as error, case when origin = 'csv' then printf('%.4f', round(9 % 97 / 97.0, 4)) when origin = 'missing' then '' end as risk, 'nota ' || doc_id as notes from x""")
def reanalyze_rows(spark, sf):
    rows = _exported(spark, sf)
    known = articles(spark, sf).where("doc_id % 5 <> 4").select(F.col("doc_id").alias("representative_id"), F.col("title").alias("title_raw"), F.col("content").alias("clean_text"))
    inputs = selection.reanalysis_inputs(rows, known)
    a = analysis.analyze(inputs.where("origin <> 'missing'").select(F.col("row").alias("doc_id"), "title", "content"), SETTINGS)
    d = selection.update_rows(rows, inputs, a)
    risk = F.when(F.col("origin") != "db", F.col("analysis_risk_score"))
    return d.select("row", "origin", "error", risk.alias("risk"), "notes")


@query("select count(*) filter (doc_id % 5 <> 4) as updated, count(*) filter (doc_id % 5 <> 4 and doc_id % 6 = 0) as refreshed, count(*) filter (doc_id % 5 = 4) as failed from documents")
def recompute_counts(spark, sf):
    i = F.col("doc_id")
    targets = tables.table(spark, sf, "documents").select(i.alias("representative_id"), F.when(i % 6 == 0, i).alias("news_id"))
    return selection.recompute(targets, analysis.analyze(articles(spark, sf), SETTINGS))


@query(f"""{_ANALYSED}, {_STANCE} select o.doc_id as representative_id, b.label as stance, o.label, cast(risk as double) as risk, 0.35 as low, cast(selected as int) as claims from o join best b using (doc_id)""")
def inspection_payload(spark, sf):
    i = F.col("doc_id")
    targets = tables.table(spark, sf, "documents").select(i.alias("representative_id"), i.alias("news_id"), F.lit(1).alias("source_id"), F.lit("s").alias("source_name"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("t").alias("title_raw"))
    d = selection.inspection(targets, analysis.analyze(articles(spark, sf), SETTINGS))
    return d.select("representative_id", F.col("stance.label").alias("stance"), "fake_news.label", F.col("fake_news.risk_score").alias("risk"), F.col("fake_news.triage_thresholds.low").alias("low"), F.size("claims").alias("claims"))


@query(f"{publishing.STORED} select p.news_raw_id as id, md5(p.clean_text) as article, s.summary_text || repeat('.', 20) as reference from processed p join summaries s on s.representative_id = p.news_raw_id where length(p.clean_text) >= 500 order by id limit 30")
def summary_examples(spark, sf):
    s = publishing.summaries(spark, sf).withColumn("summary_text", F.concat("summary_text", F.lit("." * 20)))
    return selection.summary_examples(publishing.processed(spark, sf), s, 500, 30).withColumn("article", F.md5(F.col("article").cast("binary")))


@query(f"{publishing.STORED} select p.news_raw_id as id, coalesce(o.title_raw, '') as title, o.original_url as url, md5(p.clean_text) as article, coalesce(s.summary_text, '') as existing_summary from processed p join own o using (news_raw_id) left join summaries s on s.representative_id = p.news_raw_id where length(p.clean_text) >= 500 order by id limit 40")
def reference_candidates(spark, sf):
    d = selection.reference_candidates(publishing.processed(spark, sf), publishing.raw(spark, sf), publishing.summaries(spark, sf), 500, 40)
    return d.withColumn("article", F.md5(F.col("article").cast("binary")))

