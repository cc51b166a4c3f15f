"""Text kernels: functions from columns to columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝŸ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCYY"
#: Compatibility forms that decompose to more than a letter with a mark.
_WIDE = {"ﬁ": "fi", "ﬂ": "fl", "ª": "a", "º": "o", "²": "2", "³": "3", "¹": "1", "½": "12", "¼": "14", "¾": "34", "…": "...", "™": "TM", "ĳ": "ij", " ": " "}
EDGES = " :;,.\"'()[]"


def any_of(markers: list[str]) -> str:
    """A regular expression for any of the markers, as plain text."""
    return "|".join("\\Q" + m + "\\E" for m in markers)


def has(text: Column, markers: list[str]) -> Column:
    return text.rlike(any_of(markers))


def starts(text: Column, markers: list[str]) -> Column:
    return text.rlike("^(?:" + any_of(markers) + ")")


def collapse(text: Column) -> Column:
    """White space runs to one space, trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def compact(text: Column) -> Column:
    return F.coalesce(collapse(text), F.lit(""))


def fold(text: Column) -> Column:
    """Letters without their accents (Latin-1 and its neighbours)."""
    return F.translate(text, _ACCENTED, _PLAIN)


def folded(text: Column) -> Column:
    return fold(F.lower(text))


def claim_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(folded(text), r"(?U)\W+", " "))


def normalized(text: Column) -> Column:
    """Lower case, no accents, single spaces."""
    return compact(folded(text))


def clean_text(raw: Column) -> Column:
    """Tags, addresses, handles and characters outside the kept set become spaces, in this order; then single spaces."""
    out = F.coalesce(raw, F.lit(""))
    for pattern in (r"<[^>]+>", r"(?U)https?://\S+|www\.\S+", r"(?U)[@#]\w+", r"(?U)[^\w\s.,;:!?áéíóúÁÉÍÓÚñÑ-]", r"(?U)\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def detect_language(text: Column) -> Column:
    """By how many distinct marker words of a language are present: two of seven, or two of four."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    count = lambda markers: sum((padded.contains(m).cast("int") for m in markers), F.lit(0))
    return F.when(count(lx.SPANISH_MARKERS) >= 2, "es").when(count(lx.ENGLISH_MARKERS) >= 2, "en").when(F.trim(padded) != "", "unknown").otherwise("empty")


def count_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def sentences(text: Column) -> Column:
    """Pieces after a full stop, exclamation or question mark and a space."""
    return F.filter(F.split(compact(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def raw_text(title: Column, content: Column) -> Column:
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(content, F.lit("")))


def headline(text: Column) -> Column:
    first = F.trim(F.substring_index(text, ".", 1))
    return F.when(first != "", F.substring(first, 1, 160)).otherwise(F.substring(text, 1, 160))


def article_context(head: Column, body: Column) -> Column:
    h, b = compact(head), compact(body)
    return F.when(h == "", b).when(F.startswith(F.lower(b), F.lower(h)), b).otherwise(F.trim(F.concat(h, F.lit(". "), b)))


def cluster_normal(text: Column) -> Column:
    """ASCII letters and digits in lower case: accents and other scripts dropped, hyphens inside words closed."""
    out = F.coalesce(text, F.lit(""))
    wide = F.when(out.rlike("[" + "".join(_WIDE) + "]"), _widened(out)).otherwise(out)  # most texts have none
    # letters, digits and hyphens between them stay; what is not ASCII goes, and the rest parts words
    out = F.regexp_replace(F.regexp_replace(F.lower(fold(wide)), r"[^\x00-\x7F]+", ""), r"(?<=\w)-(?=\w)", "")
    return F.trim(F.regexp_replace(out, r"\W+", " "))


def _widened(text: Column) -> Column:
    for wide, plain in _WIDE.items():
        text = F.replace(text, F.lit(wide), F.lit(plain))
    return text


def cluster_tokens(text: Column, limit: int | None = None) -> Column:
    """Distinct tokens in order: no stopwords, and none of one or two letters unless it has a digit."""
    kept = F.array_distinct(F.filter(F.split(cluster_normal(text), " "), lambda w: ((F.length(w) > 2) & ~w.isin(lx.STOPWORDS)) | w.rlike("[0-9]")))
    return F.slice(kept, 1, limit) if limit else kept


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def cleanup(text: Column) -> Column:
    """A claim's target: edges trimmed, a leading connective dropped, single spaces."""
    out = F.btrim(text, F.lit(EDGES))
    out = F.regexp_replace(out, rf"(?iU)^(?:{lx.DISCOURSE_CUT})\s*,?\s+", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def domain(url: Column) -> Column:
    """Network location in lower case without www; a port stays."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """Domain and path without a slash at the end."""
    path = F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#;]*)", 1)
    return F.concat(domain(url), F.rtrim(path, F.lit("/")))


def slug_title(url: Column) -> Column:
    """A title from the last part of a path of at least three words; small words stay small."""
    path = F.btrim(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    slug = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"-noticia/?$", ""), r"\.(html|htm)$", "")
    words = F.filter(F.split(slug, "-"), lambda w: w != "")
    small = F.array(*map(F.lit, lx.SMALL_WORDS))
    shaped = F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))))
    return F.when(F.size(words) >= 3, F.array_join(shaped, " "))


def looks_english(text: Column) -> Column:
    return has(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), lx.ENGLISH_SIGNS)


def parse_time(text: Column) -> Column:
    iso = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return F.coalesce(iso, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def isoformat(time: Column) -> Column:
    """ISO text of a time; fractions of a second only where there are any."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.pmod(F.unix_micros(time.cast("timestamp")), F.lit(1_000_000)) == 0, whole).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def date_part(text: Column) -> Column:
    """The day of an ISO time."""
    return F.substring_index(text, "T", 1)


def first_date(*texts: Column) -> Column:
    """The first text that has one, else the first day (yyyy-mm-dd) inside any."""
    given = F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts[:-1]))
    return F.coalesce(given, F.nullif(F.regexp_extract(texts[-1], r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def safe_float(text: Column) -> Column:
    """A number, or null where the text is none."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$|^[+-]?(?:nan|inf|infinity)$"), t.try_cast("double"))


def coerce_text(parts: Column) -> Column:
    """A list of texts as one, in single spaces; nothing left is null."""
    return collapse(F.concat_ws(" ", parts))


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; what can't be stays."""
    raw = F.encode(F.when(text.rlike(r"^[\x00-\xFF]*$"), text).otherwise(F.lit("")), "ISO-8859-1").cast("string")
    return F.when(has(text, lx.MOJIBAKE) & text.rlike(r"^[\x00-\xFF]*$") & F.is_valid_utf8(raw), raw).otherwise(text)


def first_present(*texts: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts))


_OUTPUT = "struct<output_text: string, output: array<struct<content: array<struct<text: string>>>>>"


def output_text(payload: Column) -> Column:
    """The text of a model's answer (JSON): its own field, else the first text inside its output."""
    d = F.from_json(payload, _OUTPUT)
    inner = F.flatten(F.transform(F.coalesce(d.output, F.expr("array()").cast("array<struct<content: array<struct<text: string>>>>")), lambda x: F.coalesce(x.content.text, F.expr("array()").cast("array<string>"))))
    return F.trim(F.coalesce(F.nullif(d.output_text, F.lit("")), F.get(F.filter(inner, lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(0))))


def summary_is_empty(text: Column, least: int = 20) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")) < least
