"""Veracity and stance: pluggable scorers, claim signals, article risk and triage."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx

ARTICLE, LOW, HIGH = 0.5, 0.35, 0.75


class Scorer(Protocol):
    """Adds p_false and p_true (double) for a text column."""

    def score(self, rows: DataFrame, text: str) -> DataFrame: ...


class LexicalScorer:
    """A stand-in without weights: the share of capitals, exclamation marks and digits, squeezed to (0, 1)."""

    def score(self, rows: DataFrame, text: str) -> DataFrame:
        n = F.greatest(F.length(text), F.lit(1))
        sign = F.regexp_count(F.col(text), F.lit(r"[A-Z!?0-9]")) / n
        p = F.round(1 / (1 + F.exp(-(sign * 20 - 1.5))), 4)
        return rows.withColumn("p_false", p).withColumn("p_true", F.round(1 - p, 4))


class ModelScorer:
    """A fitted pyspark.ml pipeline whose probability column holds (false, true)."""

    def __init__(self, model):
        self.model = model

    @classmethod
    def fit(cls, rows: DataFrame, text: str, label: str, features: int = 1 << 16) -> ModelScorer:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

        counts = rows.groupBy(label).count().withColumnRenamed("count", "_c")
        weighted = rows.join(F.broadcast(counts), label).withColumn("weight", F.lit(1.0) / F.col("_c"))  # one row a label
        stages = [RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\W+"), HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol=label, weightCol="weight", maxIter=20)]
        return cls(Pipeline(stages=stages).fit(weighted))

    def score(self, rows: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(rows).withColumn("_p", vector_to_array("probability"))
        return out.withColumn("p_false", F.round(F.get("_p", F.lit(0)), 4)).withColumn("p_true", F.round(F.get("_p", F.lit(1)), 4)).select(*rows.columns, "p_false", "p_true")


def _weighted(prefix: str, weights: dict[str, float]) -> Column:
    return sum((F.col(prefix + k) * w for k, w in weights.items()), F.lit(0.0))


def claim_signals(rows: DataFrame) -> DataFrame:
    """Of p_false, p_true and stance_agree, stance_discuss, stance_unrelated, stance_disagree: support, refute, fake_risk, real_support."""
    s, r = _weighted("stance_", lx.SUPPORT), _weighted("stance_", lx.REFUTE)
    d = rows.withColumn("_d", F.greatest(s + r, F.lit(1.0))).withColumn("_s", s / F.col("_d")).withColumn("_r", r / F.col("_d"))
    out = {"support_score": F.col("_s"), "refute_score": F.col("_r"), "fake_risk": F.col("p_false") * F.col("_s"), "real_support": F.col("p_true") * F.col("_s") + F.col("p_false") * F.col("_r")}
    return d.withColumns({k: F.round(v, 4) for k, v in out.items()}).drop("_d", "_s", "_r")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def mean4(c: str) -> Column:
    """Mean of numbers of four places, to four places: in decimals, so that it doesn't depend on the order of rows."""
    return F.round(clamp(F.round(F.avg(F.col(c).cast("decimal(10,4)")), 4).cast("double")), 4)


def article_risk(signals: DataFrame, threshold: float = ARTICLE) -> DataFrame:
    """Mean of its claims' signals for each doc_id; label False at or above the threshold."""
    g = signals.groupBy("doc_id").agg(mean4("fake_risk").alias("risk"), mean4("real_support").alias("real_support"), F.count(F.lit(1)).alias("claims"))
    return g.withColumn("label", F.when(F.col("risk") >= threshold, "False").otherwise("True"))


def article_risk_without_stance(claims: DataFrame, threshold: float = ARTICLE) -> DataFrame:
    g = claims.groupBy("doc_id").agg(mean4("p_false").alias("risk"), F.count(F.lit(1)).alias("claims"))
    return g.withColumn("real_support", F.round(1 - F.col("risk"), 4)).withColumn("label", F.when(F.col("risk") >= threshold, "False").otherwise("True"))


def with_fallback(articles: DataFrame, risks: DataFrame, whole: DataFrame) -> DataFrame:
    """Articles without claims take the score of their whole text (doc_id, p_false)."""
    d = articles.join(risks, "doc_id", "left").join(whole.select("doc_id", "p_false"), "doc_id", "left")
    return d.withColumn("source", F.when(F.col("risk").isNull(), "article").otherwise("claims")).withColumn("risk", F.coalesce("risk", F.round("p_false", 4))).drop("p_false")


def triage(risk: Column, low: float = LOW, high: float = HIGH) -> Column:
    if not 0 <= low < high <= 1:
        low, high = LOW, HIGH
    return F.when(risk >= high, "likely_fake").when(risk <= low, "likely_real").otherwise("indeterminate")


def ranking(probabilities: dict[str, Column]) -> Column:
    """Labels by falling probability, in the given order where equal."""
    listed = F.array(*[F.struct((-p).alias("neg"), F.lit(i).alias("i"), F.lit(k).alias("label"), p.alias("score")) for i, (k, p) in enumerate(probabilities.items())])
    return F.transform(F.array_sort(listed), lambda x: F.struct(x.label.alias("label"), x.score.alias("score")))


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def focal_loss(p: Column, gamma: float = 2.0) -> Column:
    return F.pow(1 - p, F.lit(gamma)) * -F.log(p)
