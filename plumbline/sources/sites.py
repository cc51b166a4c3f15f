"""Article pages of known sites, fact-check pages of known publishers, and lists of links, from fetched html.

Fetching needs a network and is the caller's: pages come as rows (page_id, url, html). Selectors are data; one kernel reads them over
Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import lexicon as lx
from ..storage import keep
from . import dom

ARTICLE = "page_id long, site string, title string, url string, summary string, content string, published_date string, author string"


@dataclass(frozen=True)
class Site:
    """How an article page of a site is read."""

    name: str
    host: str
    title: str
    summary: str
    #: Selectors of paragraphs: the first that finds any counts.
    content: tuple[str, ...]
    author: str
    #: "day" takes the date part, "whole" the attribute as it is, "" no date from the page.
    date: str
    #: Least characters of content, parts of urls that are no articles, and a notice (selector, words) of pages behind a wall.
    least: int = 0
    skip: tuple[str, ...] = ()
    wall: tuple[str, str] | None = None
    #: Selectors of the article links on the front page: containers and the link in each.
    lists: tuple[tuple[str, str, bool], ...] = ()


#: The sites and their markup.
SITES = {
    "El Comercio": Site(
        "El Comercio", "https://elcomercio.pe", "h1", "h2",
        ("p.sc__font-paragraph, article p.sc__font-paragraph, article div.story-content p, article section p", "article p"), "a.sc__author-nd-a", "day",
        80, ("/ecdata/",), ("div.story-header-headsubscription__text", "Solo para suscriptores"), (("div.story-item", "a.story-item__title", False),),
    ),
    "La Republica": Site(
        "La Republica", "https://larepublica.pe", "h1", "h2", ("div.MainContent_main__body__i6gEa p",), "a.Author_author__redSocial_link__ZcaC8", "whole",
        lists=(("div.extend-link--outside", "a", True), ("div.ListSection_list__section--item__zeP_z", "a.extend-link", False)),
    ),
    "Peru21": Site(
        "Peru21", "https://peru21.pe", "h1", "div.entradilla-full p", ("div.cuerpo-full p", "article p, main p"), "div.firma-s1 div.field__item", "",
        lists=(("div.mt-3", "a", False),),
    ),
    "RPP Noticias": Site(
        "RPP Noticias", "https://rpp.pe", "h1.article__title", "h2", ("div.body p",), "div.article__author div a", "day",
        lists=(("h2.news__title", "a", True), ("div.column-fluid article.news", "a", False)),
    ),
}


#: Parts of addresses, or whole names, that choose a site; the first that fits.
STRATEGIES = [
    ("elcomercio.pe", "El Comercio"), ("rpp.pe", "RPP Noticias"), ("larepublica.pe", "La Republica"), ("peru21.pe", "Peru21"),
    ("el comercio", "El Comercio"), ("rpp noticias", "RPP Noticias"), ("la republica", "La Republica"), ("peru21", "Peru21"),
]


def strategy(name: Column, base_url: Column) -> Column:
    """The site that reads a source, by its address or name; null has the generic links."""
    tests = [(F.coalesce(F.lower(base_url), F.lit("")).contains(key) | F.lower(name).eqNullSafe(key), site) for key, site in STRATEGIES]
    out = F.when(tests[0][0], tests[0][1])
    for test, site in tests[1:]:
        out = out.when(test, site)
    return out


def _clean(text: str) -> str:
    return " ".join(text.split())


def _article(site: Site, url: str, html: str) -> tuple | None:
    url = url if url.startswith("http") else site.host + url
    if any(s in url for s in site.skip):
        return None
    page = dom.parse(html)
    if site.wall:
        notice = page.first(site.wall[0])
        if notice and site.wall[1] in notice.text(" ", True):
            return None
    title = page.first(site.title)
    if title is None:
        return None
    found = next((p for p in map(page.select, site.content) if p), [])
    if site.name == "Peru21":  # paragraphs run together there, without inner blanks
        content = " ".join(x for x in (p.text("", True) for p in found) if x)
    else:
        content = " ".join(x for x in (_clean(p.text()) for p in found) if x)
    if len(content) < site.least:
        return None
    summary, author, time = page.first(site.summary), page.first(site.author), page.find("time") if site.date else None
    at = time.attrs.get("datetime") or None if time else None
    return _clean(title.text()), url, _clean(summary.text()) if summary else None, content, at.split("T")[0] if at and site.date == "day" else at, author.text("", True) if author else None


def articles(pages: DataFrame) -> DataFrame:
    """Articles of rows (page_id, site, url, html); pages without a title, too short or behind a wall give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, name, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "site", "url", "html"))):
                got = _article(SITES[name], url or "", html) if name in SITES else None
                if got:
                    rows.append((page_id, name, *got))
            yield _batch(rows, ARTICLE)

    return pages.select("page_id", "site", "url", "html").mapInArrow(run, ARTICLE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for c, k in zip(columns, kinds)], list(names))


def front_links(pages: DataFrame) -> DataFrame:
    """(page_id, site, pos, url) of the article links on a site's front page (page_id, site, html), in the order of its lists."""
    schema = "page_id long, site string, pos int, url string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, name, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "site", "html"))):
                site = SITES.get(name)
                page, n = dom.parse(html), 0
                for container, link, once in site.lists if site else ():
                    found = page.select(container)
                    for c in found[:1] if once else found:
                        a = c.first(link)
                        href = a.attrs.get("href") if a else None
                        if href and not any(s in href for s in site.skip):
                            rows.append((page_id, name, n, href if href.startswith("http") else site.host + href))
                            n += 1
            yield _batch(rows, schema)

    return pages.select("page_id", "site", "html").mapInArrow(run, schema)


def generic_links(pages: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, pos, url, title, content) of the first links inside articles and headings, resolved against the page's address; the title stands for the content."""
    schema = "page_id long, pos int, url string, title string, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                n = 0
                for a in dom.parse(html).select("article a, h2 a, h3 a")[:most]:
                    title, href = _clean(a.text(" ", True)), a.attrs.get("href")
                    if title and href:
                        rows.append((page_id, n, urljoin(url or "", href), title, title))
                        n += 1
            yield _batch(rows, schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def social_posts(spark: SparkSession) -> DataFrame:
    """The social network's source: no posts, with the columns of raw news."""
    return spark.createDataFrame([], "source_id long, platform string, source_account string, original_url string, title_raw string, content_raw string, author_raw string, published_at timestamp")


# --- fact-check pages ------------------------------------------------------------------------------
def _reviews(x) -> Iterator[dict]:
    for y in x if isinstance(x, list) else [x]:
        if isinstance(y, list):
            yield from _reviews(y)
        elif isinstance(y, dict):
            kind = y.get("@type")
            if "ClaimReview" in (kind if isinstance(kind, list) else [kind]):
                yield y


def _structured(page: dom.Node) -> Iterator:
    for s in page.find_all("script", where=lambda n: n.attrs.get("type") == "application/ld+json"):
        try:
            yield json.loads(s.raw())
        except ValueError:
            continue


def _has_class(part: str) -> Callable[[dom.Node], bool]:
    return lambda n: any(part in c for c in n.classes)


def _meta(page: dom.Node, key: str, value: str) -> str | None:
    n = page.find("meta", where=lambda n: n.attrs.get(key) == value and bool(n.attrs.get("content")))
    return n.attrs["content"] if n else None


def _time(page: dom.Node) -> str | None:
    n = page.find("time")
    return (n.attrs.get("datetime") or n.text("", True) or None) if n else None


def _verdict(text: str, rules) -> str | None:
    plain = lb.fold(text)
    return next((v for v, keys in rules if any(k in plain for k in keys)), None)


def newtral(page: dom.Node, url: str) -> tuple:
    """Claim, rating and date from structured data, else from the fact-check card."""
    for payload in _structured(page):
        review = next(_reviews(payload), None)
        if review:
            rating = review.get("reviewRating") or {}
            rating = (rating.get("alternateName") or rating.get("ratingValue")) if isinstance(rating, dict) else None
            return review.get("claimReviewed"), None if rating is None else str(rating), review.get("datePublished") or review.get("dateCreated")
    card = page.find(where=_has_class("card-factchecks-single")) or page.find(where=_has_class("factchecks-single"))
    claim = rating = None
    if card:
        mark = card.find("mark")
        found = [mark] if mark else list(card.find_all("h2", "h3", "p"))[:3]
        claim = next((t for t in (n.text(" ", True) for n in found) if t), None)
        hinted = card.find_all(where=lambda n: any(h in c.lower() for c in n.classes for h in lx.RATING_HINTS))
        short = (t for t in (n.text(" ", True) for n in card.find_all("span", "strong", "p", "h3", "h4")) if 0 < len(t.split()) <= 3)
        rest = card.text(" ", True)
        texts = [*(n.text(" ", True) for n in hinted), *short, rest.replace(claim, " ") if claim else rest]
        rating = next((v for v in (_verdict(t, lx.NEWTRAL_VERDICTS) for t in texts) if v), None)
    by = page.find("div", where=_has_class("pot-author-date"))
    date = _meta(page, "property", "article:published_time") or _meta(page, "name", "date") or (by.text("", True) or None if by else None) or _time(page)
    return claim, rating, date


def maldita(page: dom.Node, url: str) -> tuple:
    """Claim from the first box with a heading, with its context; rating from a badge of at most three words; date from meta or time."""
    box = page.find("div", where=lambda n: _has_class("mb-4")(n) and n.find("h2") is not None)
    claim = box.find("h2").text(" ", True) or None if box else None
    badges = list((box or page).find_all("span", "strong", "p", "div", "h3", "h4"))[:60]
    texts = (t for t in (n.text(" ", True) for n in badges) if t and len(t.split()) <= 3)
    rating = next((v for v in (_verdict(t, lx.MALDITA_VERDICTS) for t in texts) if v), None)
    return claim, rating, _meta(page, "property", "article:published_time") or _time(page)


def maldita_context(page: dom.Node) -> str | None:
    box = page.find("div", where=lambda n: _has_class("mb-4")(n) and n.find("h2") is not None)
    n = box.find("div", where=lambda n: {"text-sm", "italic", "text-theme-text-secondary"} <= set(n.classes)) if box else None
    return n.text(" ", True) or None if n else None


def perucheck(page: dom.Node, url: str) -> tuple:
    """Headline (else the article's first bold text), the texts that its verdict is looked for in, and the date: meta, time, then the byline's."""
    article = page.find("article")
    h1 = page.find("h1")
    strong = article.find("strong") if article else None
    claim = (h1.text(" ", True) if h1 else "") or (strong.text(" ", True) if strong else "") or None
    listed = [c for payload in _structured(page) for c in (payload if isinstance(payload, list) else [payload]) if isinstance(c, dict)]
    texts = [str(c[k]) for c in listed for k in ("headline", "name", "description", "articleBody") if c.get(k)]
    date = _meta(page, "property", "article:published_time") or _time(page)
    if not date and article:
        for p in article.find_all("p"):
            m = re.search(r"\d{4}-\d{2}-\d{2}", p.text("", True)) if "Redacción:" in p.text("", True) else None
            if m:
                date = m[0]
                break
    return claim, json.dumps([texts, article.text(" ", True) if article else ""], ensure_ascii=False), date


PUBLISHERS = {"newtral": newtral, "maldita": maldita, "perucheck": perucheck}


def _fields(pages: DataFrame) -> DataFrame:
    schema = "page_id long, publisher string, url string, claim string, rating string, date string, context string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, name, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "publisher", "url", "html"))):
                if name in PUBLISHERS and html:
                    page = dom.parse(html)
                    rows.append((page_id, name, url, *PUBLISHERS[name](page, url or ""), maldita_context(page) if name == "maldita" else None))
                else:
                    rows.append((page_id, name, url, None, None, None, None))
            yield _batch(rows, schema)

    return pages.select("page_id", "publisher", "url", "html").mapInArrow(run, schema)


def fact_check_outcomes(pages: DataFrame) -> DataFrame:
    """pages (page_id, publisher, url, html) as claims: page_id, publisher, url, claim, rating, label, date, context and reason.

    reason is null for a claim that is kept, else why the page is skipped: fetch_error, missing_claim, meta_explainer, missing_rating or invalid_rating."""
    d = _fields(pages).join(pages.select("page_id", (F.length(F.coalesce("html", F.lit(""))) > 0).alias("_fetched")), "page_id")
    own = F.col("publisher") == "perucheck"
    # rules over rules grow fast as one expression: each step is a table of narrow rows
    d = keep(d.withColumn("claim", F.when(own, lb.clean_claim(F.col("claim"))).otherwise(F.col("claim"))), "claims").withColumn("claim", F.nullif("claim", F.lit("")))
    texts = F.from_json("rating", "array<string>")
    listed = F.from_json(F.get(texts, F.lit(0)), "array<string>")
    from_list = F.get(F.filter(F.transform(listed, lb.verdict_from_title), lambda v: v.isNotNull()), F.lit(0))
    verdict = F.coalesce(lb.verdict_from_url(F.col("url")), lb.verdict_from_title(F.col("claim")), from_list, lb.verdict_from_content(F.get(texts, F.lit(1))))
    d = keep(d.withColumn("rating", F.when(own, verdict).otherwise(F.col("rating"))), "verdicts")
    label = F.when(own, lb.perucheck_label(F.col("rating"))).when(F.col("publisher") == "newtral", lb.newtral_label(F.col("rating"))).otherwise(lb.maldita_label(F.col("rating")))
    d = d.withColumn("label", label)
    slug = F.regexp_extract(F.lower("url"), r"([^/?#]*)(?:[?#].*)?$", 1)
    explainer = own & (F.contains(slug, F.lit("explicador")) | F.startswith(slug, F.lit("perucheck")) | F.startswith(F.lower("claim"), F.lit("explicador")))
    reason = F.when(~F.col("_fetched"), "fetch_error").when(F.col("claim").isNull(), "missing_claim").when(explainer, "meta_explainer").when(F.col("rating").isNull(), "missing_rating").when(F.col("label").isNull(), "invalid_rating")
    return d.withColumn("reason", reason).drop("_fetched")


#: Fixed values.
PERUCHECK, ARTICLES_PATH = "https://perucheck.pe", "/articles/verificadas/"


def collected_urls(pages: DataFrame) -> DataFrame:
    """Distinct article addresses (url, in order) of list pages (html): links to articles, and the articles of the page's own data."""
    linked = F.regexp_extract_all("html", F.lit(rf'<a\s[^>]*href="([^"]*{ARTICLES_PATH}[^"]*)"'), 1)
    data = F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>', 1)
    named = F.from_json(F.get_json_object(data, "$.props.pageProps.dataArticl.articles.data"), "array<struct<slug:string>>")
    slugs = F.filter(F.transform(F.coalesce(named, F.array().cast("array<struct<slug:string>>")), lambda x: x.slug), lambda s: F.coalesce(F.length(s), F.lit(0)) > 0)
    found = pages.select(F.explode(F.concat(linked, slugs)).alias("u"))
    return found.select(F.when(F.startswith("u", F.lit("http")), F.col("u")).otherwise(F.concat(F.lit(PERUCHECK), "u")).alias("url")).distinct().orderBy("url")
