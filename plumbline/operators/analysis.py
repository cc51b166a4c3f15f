"""Analysis of articles: veracity of their claims, the article's stance to them, risk, triage, and the nested result.

Scorers are pluggable: a veracity scorer adds p_false and p_true for a text column, a stance scorer the four probabilities for a headline and a body.
All steps are over whole tables: claims are rows, and an article without claims takes the score of its whole text."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import article_context, cluster_tokens, collapse, headline
from . import scoring
from .claims import ClaimSettings, extract_claims
from .scoring import ARTICLE, HIGH, LOW, LexicalScorer, Scorer
from .summaries import lead_summary, wants_summary


class StanceScorer(Protocol):
    """Adds stance_unrelated, stance_discuss, stance_agree and stance_disagree (double) for a headline and a body column."""

    def score(self, rows: DataFrame, head: str, body: str) -> DataFrame: ...


class OverlapStance:
    """A stand-in without weights: the share of the headline's tokens in the body, and denials in the body, through a softmax."""

    def score(self, rows: DataFrame, head: str, body: str) -> DataFrame:
        d = rows.withColumn("_h", cluster_tokens(F.col(head))).withColumn("_b", cluster_tokens(F.col(body)))
        share = F.when(F.size("_h") == 0, 0.0).otherwise(F.size(F.array_intersect("_h", "_b")) / F.size("_h"))
        denied = F.col(body).rlike(r"(?iU)\b(?:falso|falsa|niega|desmiente|desmintio|no es cierto)\b").cast("double")
        d = d.withColumn("_s", share).withColumn("_d", denied)
        logits = F.array(2 - 4 * F.col("_s"), F.lit(0.5), 3 * F.col("_s") - 2 * F.col("_d"), 3 * F.col("_s") * F.col("_d"))
        d = d.withColumn("_p", scoring.softmax(logits))
        return d.withColumns({f"stance_{k}": F.round(F.get("_p", F.lit(i)), 4) for i, k in enumerate(lx.STANCES)}).drop("_h", "_b", "_s", "_d", "_p")


@dataclass(frozen=True)
class AnalysisSettings:
    """Which steps run, and the thresholds. A scorer that is None is a model that isn't ready."""

    veracity: Scorer | None = LexicalScorer()
    stance: StanceScorer | None = OverlapStance()
    use_claims: bool = True
    with_summary: bool = False
    force_summary: bool = False
    claims: ClaimSettings = ClaimSettings()
    decision: float = 0.5
    article: float = ARTICLE
    low: float = LOW
    high: float = HIGH
    stance_error: str = "El clasificador de stance no esta listo."


class ModelNotReady(RuntimeError):
    pass


def texts(rows: DataFrame) -> DataFrame:
    """rows (doc_id, title, content, text) with headline, body, article_text and whole (title, or null): blank fields count as missing, and one of them is needed."""
    has = lambda c: collapse(F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    d = rows.select("doc_id", has("title").alias("title"), F.coalesce(has("content"), has("text")).alias("_c"))
    d = d.withColumn("article_text", F.coalesce("_c", "title")).where("article_text is not null")
    return d.select("doc_id", "title", F.coalesce("title", headline(F.col("article_text"))).alias("headline"), F.coalesce("_c", "article_text").alias("body"), "article_text")


# --- one prediction ------------------------------------------------------------------------------------
def _lookup(key: Column, names: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in names.items():
        out = out.when(key == k, v)
    return out


def _mapped(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.round(v, 4))])


def _shown_ranking(values: dict[str, Column], display: dict[str, str]) -> Column:
    """Labels by falling probability, with their names."""
    return F.transform(scoring.ranking(values), lambda x: F.struct(x.label.alias("label"), F.round(x.score, 4).alias("score"), _lookup(x.label, display).alias("display")))


def stance_result(d: DataFrame, prefix: str = "stance_") -> Column:
    """label (the first of the greatest), names, confidence, probabilities and ranking."""
    values = {k: F.col(prefix + k) for k in lx.STANCES}
    listed = F.array(*values.values())
    label = F.get(F.array(*map(F.lit, lx.STANCES)), (F.array_position(listed, F.array_max(listed)) - 1).cast("int"))
    return F.struct(
        label.alias("label"), _lookup(label, lx.STANCE_DISPLAY).alias("display_label"), _lookup(label, lx.STANCE_DESCRIPTION).alias("description"),
        F.round(F.array_max(listed), 4).alias("confidence"), _mapped(values).alias("probabilities"), _shown_ranking(values, lx.STANCE_DISPLAY).alias("ranking"),
    )


def veracity_columns(d: DataFrame, p_false: str, p_true: str, label: Column, settings: AnalysisSettings) -> DataFrame:
    """Adds label, names, bucket, is_fake, confidence, probabilities, ranking, risk_score and triage of two probabilities."""
    values = {"False": F.col(p_false), "True": F.col(p_true)}
    d = d.withColumn("label", label)
    risk = F.round(F.col(p_false), 4)
    return d.withColumns({
        "display_label": _lookup(F.col("label"), lx.VERACITY_DISPLAY), "bucket": _lookup(F.col("label"), lx.VERACITY_BUCKET), "is_fake": F.col("label") == "False",
        "confidence": F.round(F.when(F.col("label") == "False", F.col(p_false)).otherwise(F.col(p_true)), 4), "probabilities": _mapped(values), "ranking": _shown_ranking(values, lx.VERACITY_DISPLAY),
        "risk_score": risk, "triage_label": scoring.triage(risk, settings.low, settings.high),
    }).withColumn("triage_display", _lookup(F.col("triage_label"), lx.TRIAGE_DISPLAY))


def whole_article(d: DataFrame, settings: AnalysisSettings, text: str = "article_text") -> DataFrame:
    """The classifier's own decision on a text: True at or above its threshold."""
    scored = settings.veracity.score(d, text)
    return veracity_columns(scored, "p_false", "p_true", F.when(F.col("p_true") >= settings.decision, "True").otherwise("False"), settings)


# --- claims ------------------------------------------------------------------------------------------
def claim_items(t: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """Claims of the articles with veracity, the article's stance to each, and signals; without a stance scorer, risk is the claim's own."""
    found = extract_claims(t.select("doc_id", F.col("headline").alias("title"), "body"), settings.claims)
    found = found.withColumn("model_input", F.coalesce(F.nullif("model_input", F.lit("")), "target"))
    scored = settings.veracity.score(found, "model_input")
    if settings.stance is None:
        return scored.withColumns({"support_score": F.lit(None).cast("double"), "refute_score": F.lit(None).cast("double"), "fake_risk": F.round("p_false", 4), "real_support": F.round(1 - F.col("p_false"), 4)})
    context = t.select("doc_id", article_context(F.col("headline"), F.col("body")).alias("_context"))
    return scoring.claim_signals(settings.stance.score(scored.join(context, "doc_id"), "model_input", "_context").drop("_context"))


def analyze(rows: DataFrame, settings: AnalysisSettings = AnalysisSettings()) -> DataFrame:
    """One row for each article with text: input, fake_news, stance, summary, models and warnings, as the API gives them."""
    if settings.veracity is None:
        raise ModelNotReady("El clasificador de fake news no esta listo.")
    t = texts(rows)
    d = whole_article(t, settings)
    own = ["label", "display_label", "bucket", "is_fake", "confidence", "probabilities", "ranking", "risk_score", "triage_label", "triage_display"]
    stance = None
    if settings.stance is not None:
        d = settings.stance.score(d, "headline", "body")
        stance = stance_result(d)
    if settings.use_claims:
        items = claim_items(t, settings)
        listed = F.struct(
            "rank", F.col("claim").alias("text"), F.col("target").alias("stance_target"), "model_input", F.col("mode").alias("extraction_mode"), F.lit("ok").alias("quality"), "quality_reasons",
            F.struct(F.when(F.col("p_true") >= settings.decision, "True").otherwise("False").alias("label"), F.round(F.greatest("p_false", "p_true"), 4).alias("confidence"), _mapped({"False": F.col("p_false"), "True": F.col("p_true")}).alias("probabilities")).alias("prediction"),
            (stance_result(items) if settings.stance is not None else F.lit(None).cast("struct<label: string>")).alias("article_stance"),
            F.struct("support_score", "refute_score", "fake_risk", "real_support").alias("signals"),
        )
        # one article has at most max_claims of them
        sums = items.groupBy("doc_id").agg(scoring.mean4("fake_risk").alias("_risk"), scoring.mean4("real_support").alias("_real"), F.array_sort(F.collect_list(listed), lambda a, b: a.rank - b.rank).alias("_items"))
        d = d.join(sums, "doc_id", "left").withColumn("_claimed", F.col("_risk").isNotNull()).withColumn("_true", scoring.clamp(1 - F.col("_risk")))
        mine = veracity_columns(d.select("doc_id", "_risk", "_true"), "_risk", "_true", F.when(F.col("_risk") >= settings.article, "False").otherwise("True"), settings)
        d = d.join(mine.select("doc_id", F.struct(*own).alias("_c")), "doc_id").withColumns({k: F.when(F.col("_claimed"), F.col(f"_c.{k}")).otherwise(F.col(k)) for k in own})
        method = F.when(~F.col("_claimed"), "direct_dedicated_classifier").otherwise("claim_veracity_x_article_stance" if settings.stance is not None else "claim_veracity_only")
        real = F.when(F.col("_claimed"), F.col("_real") if settings.stance is not None else F.round(F.col("_true"), 4))
        threshold = F.when(F.col("_claimed"), F.lit(float(settings.article))).otherwise(float(settings.decision))
        claims = F.struct(F.lit("heuristic_v9").alias("strategy"), F.lit(settings.claims.max_claims).alias("max_claims"), F.coalesce(F.size("_items"), F.lit(0)).alias("selected"), F.col("_items").alias("items"), F.when(~F.col("_claimed"), "article_text").alias("fallback"))
    else:
        d = d.withColumn("_claimed", F.lit(False))
        method, real, threshold, claims = F.lit("direct_dedicated_classifier"), F.lit(None).cast("double"), F.lit(float(settings.decision)), F.lit(None).cast("struct<selected: int>")
    fake = F.struct(*own, threshold.alias("decision_threshold"), F.col("_claimed").alias("claim_based"), method.alias("aggregation_method"), real.alias("real_support"), F.struct(F.lit(settings.low).alias("low"), F.lit(settings.high).alias("high")).alias("triage_thresholds"), claims.alias("claims"))
    made = F.when(F.lit(settings.force_summary) | wants_summary(F.col("body")), lead_summary(F.col("body"))) if settings.with_summary else F.lit(None).cast("string")
    warned = settings.use_claims and settings.stance is None and bool(settings.stance_error)
    warnings = F.array(*([F.lit(settings.stance_error + " Se agregaron los claims solo con el clasificador de fake news.")] if warned else [])).cast("array<string>")
    return d.select(
        "doc_id", F.struct("title", F.length("body").alias("content_length"), F.lit(settings.with_summary).alias("summary_requested"), made.isNotNull().alias("summary_generated")).alias("input"),
        fake.alias("fake_news"), (stance if stance is not None else F.lit(None).cast("struct<label: string, confidence: double, probabilities: map<string, double>>")).alias("stance"), made.alias("summary"),
        F.struct(F.lit(settings.use_claims).alias("claims_enabled"), F.lit("heuristic_v9").alias("claim_extractor"), F.lit(type(settings.veracity).__name__).alias("fake_news_classifier"), F.lit(None if settings.stance is None else type(settings.stance).__name__).cast("string").alias("stance_classifier")).alias("models"),
        warnings.alias("warnings"),
    )


def predictions(analysed: DataFrame, model_version: str) -> DataFrame:
    """Stored predictions of analysed articles (doc_id): the stance as sentiment, unrelated where there is none, and the probability of False as fake_score."""
    fake, p = "fake_news", F.col("fake_news.probabilities")
    return analysed.select(
        F.col("doc_id").alias("representative_id"), F.coalesce("stance.label", F.lit("unrelated")).alias("sentiment_label"), F.coalesce("stance.confidence", F.lit(0.0)).alias("sentiment_score"),
        F.lit(model_version).alias("model_version"), F.round(F.coalesce(F.try_element_at(p, F.lit("False")), F.lit(0.0)), 4).alias("fake_score"), F.col(f"{fake}.label").alias("fake_label"), F.col(f"{fake}.bucket").alias("fake_bucket"),
        F.to_json(F.struct(F.col("stance.probabilities").alias("stance"), p.alias("fake_news"), F.col(f"{fake}.risk_score").alias("fake_news_risk"))).alias("raw_probabilities"),
    )
