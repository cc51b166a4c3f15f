"""Verdicts and labels: ordered rules over normalised text, as CASE expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import has, normalized


def _rules(text: Column, rules: list[tuple[Column, str | None]]) -> Column:
    out = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    for test, label in rules:
        out = out.when(test, F.lit(label).cast("string"))
    return out


def fold(text: str) -> str:
    """The normal form of rules in Python kernels: lower case, no accents, single spaces."""
    return " ".join("".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower().split())


def _first(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    n = normalized(text)
    return _rules(n, [(has(n, keys), verdict) for verdict, keys in rules])


def verdict_from_title(title: Column) -> Column:
    """Of a fact check's title: denials first, then truth, imprecision, leading negation, lack of evidence."""
    n = normalized(title)
    return _rules(n, [
        (has(n, lx.TITLE_FALSE), "Falso"), (has(n, lx.TITLE_TRUE), "Verdadero"), (has(n, lx.TITLE_IMPRECISE), "Impreciso"), (n.startswith("son ") | has(n, lx.TITLE_PLURAL), "Falso"),
        (n.startswith("no ") | n.startswith("no,") | F.substring(n, 1, 6).contains(" no "), "Falso"),
        (has(n, lx.TITLE_PARTLY), "Falso"), (n.contains("sin evidencia"), "Sin Evidencia"), (n.contains(" no ") & has(n, ["fue", "es"]), "Falso"),
    ])


def verdict_from_url(url: Column) -> Column:
    u = F.lower(url)
    path = F.regexp_extract(u, r"^(?:[a-z][\w+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    return _rules(u, [
        (has(u, lx.URL_OTHER), None), (has(u, lx.URL_FALSE), "Falso"), (has(u, lx.URL_TRUE), "Verdadero"), (has(u, lx.URL_IMPRECISE), "Impreciso"),
        (u.contains("sin-evidencia"), "Sin Evidencia"), (last.startswith("no-") | path.contains("/no-"), "Falso"), (has(last, lx.SLUG_FALSE), "Falso"), (has(last, lx.SLUG_TRUE), "Verdadero"),
    ])


def verdict_from_content(text: Column) -> Column:
    n = normalized(text)
    return _rules(n, [(has(n, ["es falso", "false"]), "Falso"), (has(n, ["es verdadero", "es cierto", "true"]), "Verdadero"), (n.contains("parcialmente falso"), "Parcialmente Falso"), (n.contains("sin evidencia"), "Sin Evidencia"), (n.contains("impreciso"), "Impreciso")])


def verdict(url: Column, title: Column, jsonld: Column, content: Column) -> Column:
    """The first source that tells one."""
    return F.coalesce(verdict_from_url(url), verdict_from_title(title), verdict_from_title(jsonld), verdict_from_content(content))


#: Letters whose upper case is several letters ("SS"), and the one letter that stands for them, else themselves.
_LONG = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
_SINGLE = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _LONG}


def _capital(text: Column) -> Column:
    """The text with its first letter in upper case, one letter for one."""
    first = F.substring(text, 1, 1)
    single = F.translate(first, "".join(_SINGLE), "".join(_SINGLE.values()))
    return F.concat(F.when(F.length(F.upper(first)) > 1, single).otherwise(F.upper(first)), F.substring(text, 2, 1 << 30))


def clean_claim(title: Column) -> Column:
    """A fact check's title without its verdict: the question before one, else what comes before a verdict at the end, else what follows one at the start."""
    t = F.trim(F.regexp_replace(title, r"\?+$", ""))
    low = F.lower(t)
    asked = F.trim(F.regexp_replace(F.trim(F.substring_index(t, "?", 1)), "^¿+", ""))
    answer = F.lower(F.substring(t, F.instr(t, "?") + 1, F.lit(1 << 30)))
    out = F.when(t.contains("?") & has(answer, lx.CLAIM_VERDICTS) & (asked != ""), asked)
    for end in lx.CLAIM_ENDS:
        before = F.trim(F.substring_index(t, end, 1))
        out = out.when(low.contains(end) & (before != ""), before)
    for start in lx.CLAIM_STARTS:
        out = out.when(low.startswith(start), F.trim(F.substring(t, len(start) + 1, 1 << 30)))
    return F.coalesce(_capital(out), t)


def perucheck_label(rating: Column) -> Column:
    n = normalized(rating)
    return _rules(n, [(has(n, ["verdadero", "cierto"]), "true"), (has(n, ["falso", "impreciso"]), "false")])


def newtral_label(rating: Column) -> Column:
    n = normalized(rating)
    return _rules(n, [(n.contains("verdad") & n.contains("media"), None), (n.contains("verdadero") | (n == "true"), "true"), (has(n, ["falso", "bulo"]), "false")])


def newtral_verdict(text: Column) -> Column:
    return _first(text, lx.NEWTRAL_VERDICTS)


def maldita_verdict(text: Column) -> Column:
    return _first(text, lx.MALDITA_VERDICTS)


def maldita_label(rating: Column) -> Column:
    n = normalized(rating)
    return _rules(n, [(n.contains("verdadero"), "true"), (n.contains("falso"), "false")])


def xfact_label(value: Column) -> Column:
    """Parts of words count, so that 'incorrect' is true: kept as the data sets were made."""
    n = normalized(value)
    return _rules(n, [
        (n.rlike(r"^1(\.0+)?$"), "true"), (n.rlike(r"^0(\.0+)?$"), "false"), (n.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), None),
        (has(n, lx.XFACT_SKIPPED), None), (has(n, lx.XFACT_TRUE), "true"), (has(n, lx.XFACT_FALSE), "false"),
    ])


def gold_label(value: Column) -> Column:
    n = F.lower(F.trim(value))
    return F.when(n.isin(lx.GOLD_TRUE), "true").when(n.isin(lx.GOLD_FALSE), "false")


def liar_label(value: Column, strategy: str = "strict") -> Column:
    """1, 0 or null (left out); another label is an error."""
    label = F.lower(F.trim(value))
    known = {k: (1 if v is None and strategy == "relaxed" else v) for k, v in lx.LIAR.items()}
    out = F.when(label.isNull(), F.lit(None).cast("int"))
    for name, v in known.items():
        out = out.when(label == name, F.lit(v).cast("int"))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("int"))
