"""Evidence reports: source filter, grounding, titles and default conclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import domain, folded, has, looks_english, slug_title, url_key


def _within(d: Column, domains: list[str]) -> Column:
    return d.rlike(r"(?:^|\.)(?:" + "|".join("\\Q" + x + "\\E" for x in domains) + ")$")


def allowed(url: Column, name: Column) -> Column:
    """Not of a blocked domain, and of an outlet by name or domain."""
    d = domain(F.lower(F.trim(url)))
    return (d != "") & ~_within(d, lx.BLOCKED_DOMAINS) & (has(folded(F.trim(F.coalesce(name, F.lit("")))), [n for n, _ in lx.OUTLETS.values()]) | _within(d, [x for _, x in lx.OUTLETS.values()]))


def outlet(url: Column) -> Column:
    """Display name by domain, else the domain."""
    d = domain(url)
    out = None
    for name, (_, x) in lx.OUTLETS.items():
        out = F.when(_within(d, [x]), name) if out is None else out.when(_within(d, [x]), name)
    return out.otherwise(d)


def grounded(url: Column, others: Column) -> Column:
    """Whether any of the urls is the same page or of the same domain."""
    return F.exists(others, lambda o: (url_key(o) == url_key(url)) | (domain(o) == domain(url)))


def normalise_sources(reports: DataFrame) -> DataFrame:
    """reports (id, sources array<struct<url, source, title>>, grounded array<string>): allowed sources, first of each url; of these the grounded ones, or all where none is; with display names and titles."""
    kept = F.filter("sources", lambda s: F.coalesce(allowed(s.url, s.source), F.lit(False)))
    d = reports.withColumn("_s", kept)
    d = d.withColumn("_s", F.filter("_s", lambda s, i: F.array_position(F.transform("_s", lambda x: x.url), s.url) == i + 1))
    d = d.withColumn("_g", F.filter("_s", lambda s: grounded(s.url, F.col("grounded"))))
    chosen = F.when((F.size("grounded") > 0) & (F.size("_g") > 0), F.col("_g")).otherwise(F.col("_s"))
    titled = F.transform(chosen, lambda s: F.struct(s.url.alias("url"), outlet(s.url).alias("source"), F.when(looks_english(s.title), F.coalesce(slug_title(s.url), s.title)).otherwise(s.title).alias("title")))
    return d.withColumn("sources", titled).drop("_s", "_g")


def conclusion(text: Column, sources: Column) -> Column:
    """The given conclusion unless it is empty, insufficient or in the first person, with sources at hand."""
    bad = F.coalesce(F.trim(text), F.lit("")) == ""
    bad = bad | has(folded(text), lx.INSUFFICIENT) | has(folded(text), lx.FORBIDDEN)
    one = F.concat(F.lit("La evidencia periodística disponible se sustenta en un reporte de "), F.get(sources, F.lit(0)).source, F.lit(" relacionado con la afirmación analizada."))
    many = F.concat(F.lit("La información difundida coincide con reportes publicados por varias fuentes periodísticas confiables, entre ellas "), F.array_join(F.transform(F.slice(sources, 1, 3), lambda s: s.source), ", "), F.lit(", que documentan elementos relacionados con la afirmación analizada."))
    return F.when((F.size(sources) == 0) | ~F.coalesce(bad, F.lit(True)), text).when(F.size(sources) == 1, one).otherwise(many)


def salvage_json(text: Column) -> Column:
    """The object in a model's answer: without a code fence, else the widest braces."""
    bare = F.trim(F.regexp_replace(text, r"^\s*```(?:json)?|```\s*$", ""))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull(), bare), F.when(F.try_parse_json(braces).isNotNull(), braces))
