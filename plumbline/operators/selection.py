"""Selecting stored articles and exporting, updating and inspecting their analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_present, isoformat

#: The export's columns, in order.
EXPORT = [
    "representative_id", "news_id", "source_id", "source_name", "published_at", "title", "original_url", "stored_fake_score", "stored_sentiment_label",
    "analysis_risk_score", "analysis_triage_label", "analysis_triage_display", "analysis_fake_label", "analysis_claim_based",
    "top_claim_text", "top_claim_target", "top_claim_model_input", "top_claim_mode", "top_claim_quality", "top_claim_quality_reasons", "top_claim_label", "top_claim_p_false",
    "warnings", "error", "manual_gold", "notes",
]
ANALYSIS = EXPORT[9:24]


def joined(processed: DataFrame, raw: DataFrame, sources: DataFrame, news: DataFrame, need_source: bool = False) -> DataFrame:
    """Processed articles with their raw row, their source (needed, or null) and what is published of them (or null)."""
    p = processed.select(F.col("news_processed_id").alias("representative_id"), "news_raw_id", "source_id", "clean_text", "processed_at")
    d = p.join(raw.select("news_raw_id", "title_raw", "original_url"), "news_raw_id").join(sources.select("source_id", F.col("name").alias("source_name")), "source_id", "inner" if need_source else "left")
    return d.join(news.select("representative_id", "news_id", "published_at"), "representative_id", "left")


def select_targets(d: DataFrame, representative_ids: list[int] | None = None, news_ids: list[int] | None = None, source_id: int | None = None, all_processed: bool = False, limit: int = 100) -> DataFrame:
    """Rows of ``joined``: given representatives, else given news, else published ones (or all), newest first, up to a limit (0: all); of one source if asked for. Blank texts are left out before the limit."""
    named = representative_ids or news_ids
    if representative_ids:
        d = d.where(F.col("representative_id").isin(representative_ids))
    elif news_ids:
        d = d.where(F.col("news_id").isin(news_ids))
    elif not all_processed:
        d = d.where("published_at is not null")
    if source_id is not None:
        d = d.where(F.col("source_id") == source_id)
    d = d.where(F.trim(F.coalesce("clean_text", F.lit(""))) != "")
    if named:
        return d.orderBy("representative_id")
    d = d.orderBy(F.desc_nulls_last("processed_at" if all_processed else "published_at"), "representative_id")
    return d.limit(limit) if limit else d


def calibration_rows(d: DataFrame, predictions: DataFrame, least: float = 0.0, most: float = 1.0, all_processed: bool = False, source_ids: list[int] | None = None) -> DataFrame:
    """Rows of ``joined`` with their stored prediction, inside a closed range of scores; published ones unless all are asked for."""
    d = d.join(predictions.select("representative_id", "fake_score", "sentiment_label"), "representative_id").where(F.col("fake_score").between(least, most) & F.col("clean_text").isNotNull())
    if not all_processed:
        d = d.where("published_at is not null")
    return d.where(F.col("source_id").isin(source_ids)) if source_ids else d


def by_risk(d: DataFrame, limit: int = 0) -> DataFrame:
    d = d.orderBy(F.desc("fake_score"), F.desc_nulls_last("published_at"), F.desc("representative_id"))
    return d.limit(limit) if limit else d



def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def analysis_columns(fake: str = "fake_news", warnings: str = "warnings") -> dict[str, Column]:
    """The export's analysis columns from an analysis: of the claims, the first; missing values are empty."""
    claim = F.get(F.col(f"{fake}.claims.items"), F.lit(0))
    p = F.try_element_at(claim["prediction"]["probabilities"], F.lit("False"))
    number = lambda x: F.when(x.isNull(), "").otherwise(F.format_string("%.4f", x))
    return {
        "analysis_risk_score": number(F.col(f"{fake}.risk_score")), "analysis_triage_label": _text(F.col(f"{fake}.triage_label")), "analysis_triage_display": _text(F.col(f"{fake}.triage_display")),
        "analysis_fake_label": _text(F.col(f"{fake}.label")), "analysis_claim_based": F.when(F.col(fake).isNull(), "").when(F.coalesce(f"{fake}.claim_based", F.lit(False)), "True").otherwise("False"),
        "top_claim_text": _text(claim["text"]), "top_claim_target": _text(claim["stance_target"]), "top_claim_model_input": _text(claim["model_input"]), "top_claim_mode": _text(claim["extraction_mode"]),
        "top_claim_quality": _text(claim["quality"]), "top_claim_quality_reasons": F.coalesce(F.array_join(claim["quality_reasons"], " | "), F.lit("")), "top_claim_label": _text(claim["prediction"]["label"]),
        "top_claim_p_false": number(p), "warnings": F.coalesce(F.array_join(warnings, " | "), F.lit("")), "error": F.lit(""),
    }


def export_rows(d: DataFrame, analysed: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """The export of calibration rows, by risk. With analyses (doc_id, ...), only rows with a claim, filtered before the limit."""
    base = {
        "representative_id": _text(F.col("representative_id")), "news_id": _text(F.col("news_id")), "source_id": _text(F.col("source_id")), "source_name": _text(F.col("source_name")),
        "published_at": F.coalesce(isoformat(F.col("published_at")), F.lit("")), "title": _text(F.col("title_raw")), "original_url": _text(F.col("original_url")),
        "stored_fake_score": F.format_string("%.4f", F.col("fake_score").cast("double")), "stored_sentiment_label": _text(F.col("sentiment_label")), "manual_gold": F.lit(""), "notes": F.lit(""),
    }
    if analysed is None:
        columns = {**base, **{c: F.lit("") for c in ANALYSIS}}
    else:
        a = analysed.select(F.col("doc_id").alias("representative_id"), "fake_news", F.col("warnings").alias("_warnings"))
        d = d.join(a, "representative_id", "left")
        columns = {**base, **analysis_columns(warnings="_warnings")}
        d = d.where(columns["top_claim_model_input"] != "")
    return by_risk(d, limit).select(*(columns[c].alias(c) for c in EXPORT))


def texts_of_rows(rows: DataFrame) -> DataFrame:
    """(row, doc_id, title, content) of exported rows (row, ...) from their own columns: the first that is not blank; a content that equals the title counts once."""
    given = lambda *names: first_present(*(F.col(n) for n in names if n in rows.columns))
    title = given("title", "top_claim_model_input", "top_claim_text", "top_claim_target")
    content = given("content", "clean_text", "body", "top_claim_model_input", "top_claim_text", "top_claim_target")
    return rows.select("row", title.alias("title"), F.when(~content.eqNullSafe(title), content).alias("content"))


def reanalysis_inputs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(row, origin, title, content) of exported rows (row, representative_id, ...): the stored article where it is known, else the row's own text; origin is db, csv or missing."""
    wanted = rows.withColumn("representative_id", F.expr("try_cast(trim(representative_id) as bigint)"))
    stored = known.select("representative_id", F.col("title_raw").alias("_t"), F.col("clean_text").alias("_c"), F.lit(True).alias("_known"))
    own = texts_of_rows(rows)
    d = wanted.select("row", "representative_id").join(stored, "representative_id", "left").join(own, "row")
    origin = F.when(F.col("_known"), "db").when(F.col("title").isNull() & F.col("content").isNull(), "missing").otherwise("csv")
    return d.select("row", origin.alias("origin"), F.when(F.col("_known"), F.col("_t")).otherwise(F.col("title")).alias("title"), F.when(F.col("_known"), F.col("_c")).otherwise(F.col("content")).alias("content"))


def update_rows(rows: DataFrame, inputs: DataFrame, analysed: DataFrame) -> DataFrame:
    """Exported rows with new analysis columns; rows without text keep theirs and get an error, all other columns stay."""
    a = analysed.select(F.col("doc_id").alias("row"), "fake_news", F.col("warnings").alias("_warnings"))
    d = rows.join(inputs.select("row", "origin"), "row").join(a, "row", "left")
    new = analysis_columns(warnings="_warnings")
    missing = F.col("origin") == "missing"
    return d.select("row", "origin", *((F.when(missing, F.lit("missing_text") if c == "error" else F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c)) for c in rows.columns if c != "row"))


def recompute(targets: DataFrame, analysed: DataFrame) -> DataFrame:
    """updated, refreshed and failed of targets (representative_id, news_id): analysed ones are updated, published ones of these refreshed, others failed."""
    d = targets.select("representative_id", "news_id").join(analysed.select(F.col("doc_id").alias("representative_id"), F.lit(True).alias("_done")), "representative_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    return d.agg(n(F.col("_done")).alias("updated"), n(F.col("_done") & F.col("news_id").isNotNull()).alias("refreshed"), n(F.col("_done").isNull()).alias("failed"))


def inspection(targets: DataFrame, analysed: DataFrame) -> DataFrame:
    """What a person looks at: the target, its stance, its veracity and its claims."""
    f = "fake_news"
    d = targets.join(analysed.withColumnRenamed("doc_id", "representative_id"), "representative_id")
    fields = ["label", "display_label", "confidence", "bucket", "is_fake", "decision_threshold", "risk_score", "triage_label", "triage_display", "triage_thresholds", "real_support", "probabilities", "claim_based"]
    claims = F.transform(F.col(f"{f}.claims.items"), lambda c: F.struct(c.text.alias("text"), c.stance_target.alias("stance_target"), c.model_input.alias("model_input"), c.extraction_mode.alias("extraction_mode"), c.quality.alias("quality"), c.quality_reasons.alias("quality_reasons"), c.prediction.label.alias("label"), c.prediction.confidence.alias("confidence"), c.prediction.probabilities.alias("probabilities"), c.article_stance.alias("article_stance"), c.signals.alias("signals")))
    return d.select(
        "representative_id", "news_id", "source_id", "source_name", isoformat(F.col("published_at")).alias("published_at"), F.col("title_raw").alias("title"),
        F.struct(F.col("stance.label").alias("label"), F.col("stance.confidence").alias("confidence")).alias("stance"), F.struct(*(F.col(f"{f}.{c}").alias(c) for c in fields)).alias("fake_news"),
        "warnings", F.coalesce(claims, F.array().cast(f"array<{_claim_type(d)}>")).alias("claims"),
    )


def _claim_type(d: DataFrame) -> str:
    """The type of an inspected claim, from the analysis's own."""
    kinds = {x.name: x.dataType.simpleString() for x in d.schema["fake_news"].dataType["claims"].dataType["items"].dataType.elementType}
    inner = {x.name: x.dataType.simpleString() for x in d.schema["fake_news"].dataType["claims"].dataType["items"].dataType.elementType["prediction"].dataType}
    names = {**{k: kinds[k] for k in ("text", "stance_target", "model_input", "extraction_mode", "quality", "quality_reasons")}, **{k: inner[k] for k in ("label", "confidence", "probabilities")}, **{k: kinds[k] for k in ("article_stance", "signals")}}
    return "struct<" + ", ".join(f"{k}: {v}" for k, v in names.items()) + ">"


# --- scans of stored summaries ---------------------------------------------------------------------
def summary_examples(processed: DataFrame, summaries: DataFrame, least: int, limit: int) -> DataFrame:
    """Articles of at least so many characters with their summaries of at least 20, in order of id."""
    s = summaries.select(F.col("representative_id").alias("id"), F.col("summary_text").alias("reference"))
    d = processed.select(F.col("news_processed_id").alias("id"), F.col("clean_text").alias("article")).join(s, "id")
    return d.where((F.length(F.coalesce("article", F.lit(""))) >= least) & (F.length(F.coalesce("reference", F.lit(""))) >= 20)).orderBy("id").limit(max(limit, 1))


def reference_candidates(processed: DataFrame, raw: DataFrame, summaries: DataFrame, least: int, limit: int) -> DataFrame:
    """Articles for reference summaries: id, title, url, article and the summary that exists, empty where there is none."""
    d = processed.join(raw.select("news_raw_id", "title_raw", "original_url"), "news_raw_id").join(summaries.select(F.col("representative_id").alias("news_processed_id"), "summary_text"), "news_processed_id", "left")
    d = d.where(F.length(F.coalesce("clean_text", F.lit(""))) >= least)
    return d.select(F.col("news_processed_id").alias("id"), _text(F.col("title_raw")).alias("title"), _text(F.col("original_url")).alias("url"), F.col("clean_text").alias("article"), _text(F.col("summary_text")).alias("existing_summary")).orderBy("id").limit(limit)
