"""Check-worthy claims of articles: candidates, projection to a target, gates, score and rank, all as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicon as lx
from ..functions.text import any_of, claim_key, cleanup, compact, folded, has, sentences, starts, word_count


@dataclass(frozen=True)
class ClaimSettings:
    max_claims: int = 3
    min_words: int = 6
    max_words: int = 40
    max_candidates: int = 30


def candidates(articles: DataFrame) -> DataFrame:
    """One row for the title and one for each body sentence: doc_id, origin, pos, text."""
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.array(F.col("title"))).otherwise(F.expr("array()").cast("array<string>"))
    both = F.concat(F.transform(title, lambda t: F.struct(F.lit("title").alias("origin"), t.alias("text"))), F.transform(F.coalesce(sentences(F.col("body")), F.expr("array()").cast("array<string>")), lambda t: F.struct(F.lit("body").alias("origin"), t.alias("text"))))
    rows = articles.select("doc_id", F.posexplode(both).alias("pos", "c")).select("doc_id", "pos", "c.origin", compact(F.col("c.text")).alias("text"))
    return rows.where("text <> ''")


#: Starts of codes, numbers and bullets.
_NO_SENTENCE = r"^\s*(?:[A-Z0-9]{1,8}(?:[-/][A-Z0-9]{1,8}){1,4}\b|\d{4,}\b|[-–—]\S)"


def usable(settings: ClaimSettings) -> Column:
    """No noise, code, number or bullet at the start, and of the right length."""
    text = F.col("text")
    n = word_count(text)
    least = F.when(F.col("origin") == "title", max(3, settings.min_words - 2)).otherwise(max(3, settings.min_words))
    return ~text.rlike(_NO_SENTENCE) & n.between(least, settings.max_words) & ~has(folded(text), lx.NOISE)


def checkable(rows: DataFrame) -> DataFrame:
    """Rows (text) that can be claims at all: something is reported, refuted or judged in them, or they have an objective signal. One pass of one pattern spares the others the cascade."""
    low = folded(F.col("text"))
    told = rf"(?U)^segun |{any_of([*lx.REFUTATION, *lx.REPORTING, *lx.VERDICTS, *lx.VERDICT_CLAIMS])}|\b(?:{'|'.join(lx.FLEXIBLE_VERBS)})\b"
    return rows.where(F.col("text").rlike(r"(?U)\d") | low.rlike(f"{any_of([*lx.OFFICIAL, *lx.ACTIONS])}|{told}"))


def _long_enough(text: Column, words: int) -> Column:
    return F.when(word_count(text) >= words, text)


def _after(text: Column, low: Column, markers: list[str]) -> Column:
    """What follows the first marker, in the list's order, that leaves at least three words."""
    listed = F.array(*map(F.lit, markers))
    found = F.filter(listed, lambda m: low.contains(m))
    rest = F.transform(found, lambda m: cleanup(F.substring(text, F.instr(low, m) + F.length(m), F.lit(1 << 30))))
    return F.when(has(low, markers), F.get(F.filter(rest, lambda t: word_count(t) >= 3), F.lit(0)))


def _tail(text: Column, length: Column) -> Column:
    return F.substring(text, length + 1, F.lit(1 << 30))


def project(rows: DataFrame) -> DataFrame:
    """Adds claim (text), target and mode: the fact check's question, verdict or embedded claim; what is refuted or reported; else the sentence."""
    text = F.col("text")
    prefix = folded(F.trim(F.substring_index(text, ":", 1)))
    d = rows.withColumn("low", folded(text))
    d = d.withColumn("trimmed", F.when(text.contains(":") & prefix.isin(lx.FACTCHECKERS), F.trim(_tail(text, F.instr(text, ":")))).otherwise(text))
    d = d.withColumn("tlow", folded(F.col("trimmed")))
    t, tlow, low = F.col("trimmed"), F.col("tlow"), F.col("low")
    # a question whose answer is a verdict
    at = F.instr(t, "?")
    asked = cleanup(F.trim(F.ltrim(F.trim(F.substring(t, F.lit(1), at - 1)), F.lit("¿"))))
    question = F.when((at > 1) & has(_tail(tlow, at), lx.VERDICTS), _long_enough(asked, 4))
    d = d.withColumn("question", question).withColumn("verdict", _after(t, tlow, lx.VERDICT_CLAIMS))
    # what a false thing would show, else what follows the last "que" after the first verdict
    inner = F.transform(F.filter(F.array(*map(F.lit, lx.EMBEDDED)), lambda m: tlow.contains(m)), lambda m: cleanup(_tail(tlow, F.instr(tlow, m) + F.length(m) - 1)))
    inner = F.get(F.filter(inner, lambda x: word_count(x) >= 4), F.lit(0))
    segment = F.regexp_replace(tlow, f"^.*?(?:{any_of(lx.VERDICTS)})", "")
    last = F.when(segment.contains(" que "), _long_enough(cleanup(F.substring_index(segment, " que ", -1)), 4))
    d = d.withColumn("embedded", F.when(has(tlow, lx.VERDICTS), F.coalesce(inner, last)))
    d = d.withColumn("refuted", _after(text, low, lx.REFUTATION)).withColumn("reported", _after(text, low, lx.REPORTING))
    loose = rf"(?U)^(.*?\b(?:{'|'.join(lx.FLEXIBLE_VERBS)})\b(?:\s+\S+){{0,8}}\s+que\s+)"
    flexible = F.when(low.rlike(rf"(?U)\b(?:{'|'.join(lx.FLEXIBLE_VERBS)})\b") & low.rlike(loose), _long_enough(cleanup(_tail(text, F.length(F.regexp_extract(low, loose, 1)))), 3))
    comma = F.instr(text, ",")
    by_source = F.when(low.startswith("segun ") & (comma > 0) & (comma <= 141), _long_enough(cleanup(_tail(text, comma)), 3))
    d = d.withColumn("flexible", flexible).withColumn("by_source", by_source)
    order = [("question", "factcheck_question"), ("verdict", "factcheck_verdict"), ("embedded", "factcheck_embedded"), ("refuted", "refutation_projected"), ("reported", "reported_claim"), ("flexible", "reported_claim"), ("by_source", "reported_claim")]
    ok = [F.coalesce(F.col(c), F.lit("")) != "" for c, _ in order]
    mode, raw = F.when(ok[0], order[0][1]), F.when(ok[0], F.col(order[0][0]))
    for test, (c, m) in zip(ok[1:], order[1:]):
        mode, raw = mode.when(test, m), raw.when(test, F.col(c))
    d = d.withColumn("mode", mode.otherwise("verbatim")).withColumn("raw_target", raw.otherwise(text))
    d = d.withColumn("target", cleanup(F.col("raw_target")))
    d = d.withColumn("claim", F.when(F.col("mode").startswith("factcheck_"), F.col("raw_target")).otherwise(text))
    return d.drop("trimmed", "tlow", "raw_target", *(c for c, _ in order))


def _objective(low: Column, text: Column) -> Column:
    return text.rlike(r"(?U)\d") | has(low, lx.OFFICIAL) | has(low, lx.ACTIONS)


def judged(rows: DataFrame) -> DataFrame:
    """Adds model_input, quality_reasons and whether the claim can be checked."""
    target, claim, mode = F.col("target"), F.col("claim"), F.col("mode")
    d = rows.withColumn("full", cleanup(claim)).withColumn("ltarget", folded(target)).withColumn("lclaim", folded(claim))
    lt = F.col("ltarget")
    keeps = mode.startswith("factcheck_") | (mode == "verbatim") | starts(folded(F.col("full")), lx.SOURCELESS_STARTS) | (word_count(F.col("full")) < word_count(target))
    d = d.withColumn("model_input", F.when(keeps, target).otherwise(F.col("full"))).withColumn("linput", folded(F.col("model_input")))
    same, context, told = F.col("model_input") == target, starts(lt, lx.CONTEXT_STARTS), mode.isin("reported_claim", "refutation_projected")
    objective = _objective(F.col("linput"), F.col("model_input"))
    actor = has(lt, lx.OFFICIAL) | target.rlike(r"\b[A-Z][a-z]+\b") | target.rlike(r"(?U)\d")
    reasons = [
        (has(lt, lx.WEAK_TARGETS), "low_value_generic_claim"), (context & same, "context_dependent_target"), (context & ~same & ~objective, "context_dependent_without_objective_context"),
        (told & same & context, "under_contextualized_reported_claim"), (told & lt.startswith("se ") & ~actor, "missing_explicit_actor"),
    ]
    d = d.withColumn("quality_reasons", F.array_compact(F.array(*[F.when(test, reason) for test, reason in reasons])))
    padded = F.concat(F.lit(" "), lt, F.lit(" "))
    first = has(padded, [f" {m.strip()} " for m in lx.FIRST_PERSON]) | starts(lt, lx.FIRST_PERSON)
    opinion = has(lt, lx.OPINION)
    asks = (mode != "factcheck_question") & (claim.endswith("?") | starts(lt, lx.QUESTIONS))
    quoted = claim.rlike("[“”\":]")
    bad = (F.size("quality_reasons") > 0) | first | has(lt, lx.LOW_VALUE) | asks | (opinion & (quoted | has(F.col("lclaim"), lx.OPINION_SOURCE) | ~mode.startswith("factcheck_"))) | ((mode == "verbatim") & ~objective)
    return d.withColumn("verifiable", ~bad).drop("full", "lclaim", "linput")


def score() -> Column:
    """Of the candidate's sentence and its target."""
    text, low, lt, mode = F.col("text"), F.col("low"), F.col("ltarget"), F.col("mode")
    # fixed values: the weights
    parts = [
        (F.col("origin") == "title", 0.6), (mode.startswith("factcheck_"), 4.0), (mode.isin("reported_claim", "refutation_projected"), 0.8), (text.rlike(r"(?U)\d"), 1.5),
        (F.regexp_count(text, F.lit(r"\b[A-Z][a-z]+\b")) >= 2, 0.8), (has(low, lx.CUES), 1.0), (F.arrays_overlap(F.split(low, r"(?U)\s+"), F.array(*map(F.lit, lx.FACT_VERBS))), 0.5),
        (has(low, lx.OFFICIAL), 0.5), (has(low, lx.ACTIONS), 0.8), (starts(lt, lx.DISCOURSE_STARTS), -0.8), (has(lt, lx.OPINION), -1.2), (has(lt, lx.LOW_VALUE), -2.0),
        (text.contains(":") & text.rlike("[\"“”]"), -0.8), (text.endswith("?"), -0.5),
    ]
    return F.round(sum((F.when(test, w).otherwise(0.0) for test, w in parts), F.lit(0.0)), 4)


def scored_candidates(articles: DataFrame, settings: ClaimSettings = ClaimSettings()) -> DataFrame:
    """Checkable candidates with score and idx: first of equal keys in an article, then the first `max_candidates` of them."""
    d = project(checkable(candidates(articles)).where(usable(settings)))
    # a sentence of its own without an objective signal is never checked, and has no part in what follows
    d = judged(d.where((F.col("mode") != "verbatim") | _objective(folded(F.col("target")), F.col("target"))))
    d = d.withColumn("score", score()).withColumn("key", claim_key(F.col("target"))).repartition("doc_id")
    # the gate is applied above the window: pushed below it, its condition would hold every expression it rests on, many times over
    first = W.partitionBy("doc_id", "key").orderBy(F.desc("verifiable"), "pos")
    d = d.withColumn("nth", F.row_number().over(first)).where("nth = 1 and verifiable")
    d = d.withColumn("idx", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1)
    return d.where(F.col("idx") < settings.max_candidates).drop("nth", "key", "low", "ltarget")


def extract_claims(articles: DataFrame, settings: ClaimSettings = ClaimSettings()) -> DataFrame:
    """articles (doc_id, title, body) to at most `max_claims` rows each: rank, claim, target, mode, model_input, score."""
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    d = scored_candidates(articles, settings).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= settings.max_claims)
    return d.select("doc_id", "rank", "claim", "target", "mode", "model_input", "quality_reasons", "score")
