"""Queries over fetched pages: article pages of known sites, generic links, fact checks, lists of links and what becomes of them.

Pages are made from the documents, in the markup of each site, so that the documents tell what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions.text import compact, headline
from ..operators import reports
from ..sources import sites, tables
from .registry import CONTENT, TITLE, query, values

_SITES = ["El Comercio", "La Republica", "Peru21", "RPP Noticias"]
#: A page of each site: title, lead and body are put in.
_PAGES = [
    '<html><body><h1> {t} </h1><h2>{l}</h2><time datetime="2024-02-05T16:03:25-05:00">5 feb</time><a class="sc__author-nd-a x"> Ana Paz </a><article><p class="sc__font-paragraph">{b}</p><div class="story-content"><p>fin</p></div></article><p>pie</p></body></html>',
    '<html><body><h1>{t}</h1><h2>{l}</h2><time datetime="2024-02-05T16:03:25-05:00">5 feb</time><div class="MainContent_main__body__i6gEa"><p>{b}</p><p>fin</p></div><article><p>no</p></article></body></html>',
    '<html><body><h1>{t}</h1><div class="entradilla-full"><p>{l}</p></div><div class="firma-s1"><div class="field__item">Ana Paz</div></div><div class="cuerpo-full"><p>{b}</p><p></p><p>fin</p></div></body></html>',
    '<html><body><h1 class="article__title">{t}</h1><h1>otro</h1><h2>{l}</h2><time datetime="2024-02-05T16:03:25-05:00">x</time><div class="article__author"><div><a href="/a">Ana Paz</a></div></div><div class="body"><p>{b}</p></div><p>no</p></body></html>',
]


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _filled(template: str, **parts: Column) -> Column:
    """The template with columns in place of its names in braces."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), parts[name]]
    return F.concat(*out, F.lit(rest))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    content = compact(F.col("text"))
    return tables.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), headline(content).alias("t"), F.substring(content, 1, 80).alias("l"), content.alias("b"))


def _site_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    k = F.col("page_id") % 4
    parts = {c: _escaped(F.col(c)) for c in "tlb"}
    html = F.when(k == 0, _filled(_PAGES[0], **parts))
    for i in (1, 2, 3):
        html = html.when(k == i, _filled(_PAGES[i], **parts))
    site = F.get(F.array(*map(F.lit, _SITES)), k.cast("int"))
    path = F.concat(F.when(F.col("page_id") % 20 == 0, "/ecdata/").otherwise("/politica/"), F.col("page_id").cast("string"))
    return d.select("page_id", site.alias("site"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://x.example"), path)).otherwise(path).alias("url"), html.alias("html"))


_HOSTS = "['https://elcomercio.pe', 'https://larepublica.pe', 'https://peru21.pe', 'https://rpp.pe']"


@query(f"""with d as (select doc_id, doc_id % 4 as k, {TITLE} as t, {CONTENT} as b, substr({CONTENT}, 1, 80) as l, case when doc_id % 20 = 0 then '/ecdata/' else '/politica/' end || doc_id as p from documents),
    a as (select doc_id as page_id, k, {_SITES}[k + 1] as site, trim(t) as title, case when doc_id % 3 = 0 then 'https://x.example' else {_HOSTS}[k + 1] end || p as url, trim(l) as summary,
        trim(b || case when k = 3 then '' else ' fin' end) as content, case k when 0 then '2024-02-05' when 1 then '2024-02-05T16:03:25-05:00' when 3 then '2024-02-05' end as published_date, case when k <> 1 then 'Ana Paz' end as author from d)
    select page_id, site, title, url, summary, md5(content) as content, published_date, author from a where not (k = 0 and (page_id % 20 = 0 or length(content) < 80))""")
def site_articles(spark, sf):
    return sites.articles(_site_pages(spark, sf)).withColumn("content", F.md5(F.col("content").cast("binary")))


_FRONTS = [
    ("El Comercio", '<div class="story-item"><a class="story-item__title" href="/a/1">x</a></div><div class="story-item"><a href="/no">n</a></div><div class="story-item"><a class="story-item__title" href="/ecdata/2">x</a></div><div class="story-item b"><a class="story-item__title" href="https://e.pe/3">x</a></div>', ["https://elcomercio.pe/a/1", "https://e.pe/3"]),
    ("La Republica", '<div class="extend-link--outside"><p><a href="/m">m</a></p></div><div class="extend-link--outside"><a href="/second">s</a></div><div class="ListSection_list__section--item__zeP_z"><a class="extend-link" href="/b/1">b</a></div>', ["https://larepublica.pe/m", "https://larepublica.pe/b/1"]),
    ("Peru21", '<div class="mt-3"><a href="/c/1">c</a></div><div class="mt-4"><a href="/c/2">c</a></div>', ["https://peru21.pe/c/1"]),
    ("RPP Noticias", '<h2 class="news__title"><a href="/d/0">d</a></h2><article class="news"><a href="/outside">o</a></article><div class="column-fluid"><article class="news"><a href="/d/1">d</a></article><article class="news"><b>no link</b></article></div>', ["https://rpp.pe/d/0", "https://rpp.pe/d/1"]),
    ("Otro", "<a href='/x'>x</a>", []),
]


@query(f"select site, i - 1 as pos, u as url from (select col0 as site, unnest(col2) as u, generate_subscripts(col2, 1) as i from (values {values([f for f in _FRONTS if f[2]])}))")
def site_front_links(spark, sf):
    d = spark.createDataFrame([(i, s, h) for i, (s, h, _) in enumerate(_FRONTS)], "page_id long, site string, html string")
    return sites.front_links(d).select("site", F.col("pos").cast("long").alias("pos"), "url")


_LINKS = [(1, "https://h.pe/a/b?c=1", '<article><p><a href="../x"> uno <b>dos</b></a></p><a href="//o.pe/y">tres</a><a>none</a><a href="/z"> </a></article><a href="/w">out</a><h2><a href="?q=2">cuatro</a></h2><h3><a href="mailto:x@y">cinco</a></h3>'), (2, "", "<h3><a href='rel'>seis</a></h3>"), (3, "https://h.pe", None)]


@query("""select * from (values (1, 0, 'https://h.pe/x', 'uno dos', 'uno dos'), (1, 1, 'https://o.pe/y', 'tres', 'tres'), (1, 2, 'https://h.pe/a/b?q=2', 'cuatro', 'cuatro'), (1, 3, 'mailto:x@y', 'cinco', 'cinco'), (2, 0, 'rel', 'seis', 'seis')) t(page_id, pos, url, title, content)""")
def generic_links(spark, sf):
    return sites.generic_links(spark.createDataFrame(_LINKS, "page_id long, url string, html string"))


_STRATEGY = [("X", "https://www.ELCOMERCIO.pe/p"), ("RPP Noticias", "https://otra.pe"), ("peru21", None), ("La Republica", "https://rpp.pe/x"), ("Nadie", "https://nadie.pe"), (None, "https://larepublica.pe")]


@query("select source as name, 'https://' || source || '.example/' as base_url, null::varchar as site from (select distinct source from documents) union all select * from (values ('X', 'https://www.ELCOMERCIO.pe/p', 'El Comercio'), ('RPP Noticias', 'https://otra.pe', 'RPP Noticias'), ('peru21', null, 'Peru21'), ('La Republica', 'https://rpp.pe/x', 'RPP Noticias'), ('Nadie', 'https://nadie.pe', null), (null, 'https://larepublica.pe', 'La Republica'))")
def scraper_strategy(spark, sf):
    d = tables.sources(spark, sf).select("name", "base_url").unionByName(spark.createDataFrame(_STRATEGY, "name string, base_url string"))
    return d.select("name", "base_url", sites.strategy(F.col("name"), F.col("base_url")).alias("site"))


@query("select null::bigint as source_id, null::varchar as platform, null::varchar as original_url where false")
def social_posts(spark, sf):
    return sites.social_posts(spark).select("source_id", "platform", "original_url")


# --- fact checks ---------------------------------------------------------------------------------------------
_CLAIM = f"regexp_replace({TITLE}, '[?¿]', '', 'g')"


def _claim() -> Column:
    return F.regexp_replace(headline(compact(F.col("text"))), "[?¿]", "")


def _variants() -> Column:
    """A title with its verdict, in six ways."""
    k, c = F.col("doc_id") % 6, F.col("c")
    return (
        F.when(k == 0, F.concat(F.lit("Es falso que "), c)).when(k == 1, F.concat(F.lit("¿"), c, F.lit("? Es falso"))).when(k == 2, F.concat(c, F.lit(", pero es falso")))
        .when(k == 3, c).when(k == 4, F.concat(F.lit("Son falsas "), c)).otherwise(F.concat(F.lit("¿Es cierto "), c, F.lit("?")))
    )


@query(f"select doc_id, case when doc_id % 6 = 3 then c else upper(c[1]) || c[2:] end as claim from (select doc_id, case when doc_id % 6 = 5 and starts_with(lower(c), 'que ') then trim(c[5:]) else c end as c from (select doc_id, trim({_CLAIM}) as c from documents) where c <> '')")
def clean_claims(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", F.trim(_claim()).alias("c")).where("c <> ''")
    return d.select("doc_id", lb.clean_claim(_variants()).alias("claim"))


_BADGE = ["Falso", "Verdadero", "Alerta", "Verdad a medias"]


def _fact_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of three publishers; every eleventh could not be fetched, and every thirteenth has no claim."""
    d = tables.table(spark, sf, "documents").select("doc_id", F.trim(_claim()).alias("c")).where("c <> ''").withColumn("e", _escaped(F.col("c")))
    i, badge = F.col("doc_id"), F.get(F.array(*map(F.lit, _BADGE)), (F.col("doc_id") % 4).cast("int"))
    has = F.when(i % 13 == 0, F.lit("")).otherwise(F.col("e"))
    day = F.lit("2024-02-05")
    json = F.to_json(F.array(F.struct(F.lit("ClaimReview").alias("@type"), F.col("c").alias("claimReviewed"), F.struct(badge.alias("alternateName")).alias("reviewRating"), day.alias("datePublished"))))
    newtral = F.when((i % 2 == 0) & (i % 13 != 0), F.concat(F.lit('<script type="application/ld+json">'), json, F.lit("</script>"))).otherwise(
        F.concat(F.lit('<meta property="article:published_time" content="2024-02-05"><div class="card-factchecks-single"><mark>'), has, F.lit('</mark><span class="veredicto-x">'), badge, F.lit("</span></div>")))
    maldita = F.concat(F.lit('<time datetime="2024-02-05">x</time><div class="mb-4 p"><h2>'), has, F.lit("</h2><span>"), badge, F.lit('</span><div class="text-sm italic text-theme-text-secondary"> dicho en redes </div></div>'))
    title = F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("Es falso que "), F.col("e")))
    perucheck = F.concat(F.lit("<h1>"), title, F.lit("</h1><article><p>Redacción: Ana - 2024-02-05</p><p>Es falso, dice el informe</p></article>"))
    url = F.concat(F.lit("https://p.pe/articles/"), F.when(i % 10 == 0, "explicador-").otherwise("nota-"), i.cast("string"))
    html = F.when(i % 3 == 0, newtral).when(i % 3 == 1, maldita).otherwise(perucheck)
    publisher = F.when(i % 3 == 0, "newtral").when(i % 3 == 1, "maldita").otherwise("perucheck")
    return d.select(i.alias("page_id"), publisher.alias("publisher"), url.alias("url"), F.when(i % 11 != 0, html).alias("html"))


_FACTS = f"""with d as (select doc_id as page_id, trim({_CLAIM}) as c, {_BADGE}[doc_id % 4 + 1] as badge, ['newtral', 'maldita', 'perucheck'][doc_id % 3 + 1] as publisher,
        'https://p.pe/articles/' || case when doc_id % 10 = 0 then 'explicador-' else 'nota-' end || doc_id as url from documents where trim({_CLAIM}) <> ''),
    x as (select page_id, publisher, url, case when page_id % 11 = 0 or page_id % 13 = 0 then null when publisher = 'perucheck' then upper(c[1]) || c[2:] else trim(c) end as claim,
        case when page_id % 11 = 0 then null when publisher = 'perucheck' then case when page_id % 10 = 0 or page_id % 13 = 0 then null else 'Falso' end when publisher = 'maldita' and badge = 'Verdad a medias' then null else badge end as rating, case when page_id % 11 <> 0 then '2024-02-05' end as date from d),
    y as (select *, case when page_id % 11 = 0 then 'fetch_error' when claim is null then 'missing_claim' when publisher = 'perucheck' and page_id % 10 = 0 then 'meta_explainer' when rating is null then 'missing_rating' when rating in ('Alerta', 'Verdad a medias') then 'invalid_rating' end as reason,
        case when rating = 'Verdadero' then 'true' when rating = 'Falso' then 'false' end as label from x)"""


@query(f"{_FACTS} select page_id, publisher, claim, date, reason, case when reason is null then label end as label from y")
def fact_check_outcomes(spark, sf):
    d = sites.fact_check_outcomes(_fact_pages(spark, sf))
    return d.select("page_id", "publisher", "claim", "date", "reason", F.when(F.col("reason").isNull(), F.col("label")).alias("label"))


@query(f"{_FACTS} select r as reason, (select count(*) from y where y.reason = r) as n from (values {values(reports.REASONS)}) v(r)")
def skip_reasons(spark, sf):
    return reports.skip_reasons(sites.fact_check_outcomes(_fact_pages(spark, sf)))


@query(f"""{_FACTS} select url, reason, case reason when 'fetch_error' then 'Failed to fetch HTML' when 'missing_claim' then 'No claim text found' when 'meta_explainer' then 'Meta/explicador page: explicador-' || page_id when 'missing_rating' then 'Claim: ' || claim[:50] || '...' else 'Unsupported rating: ' || coalesce(rating, '') end as details from y where reason is not null""")
def fact_check_rejects(spark, sf):
    return reports.rejects(sites.fact_check_outcomes(_fact_pages(spark, sf)))


@query(f"""{_FACTS} select publisher || '-' || page_id as id, label from y where reason is null qualify row_number() over (partition by trim(regexp_replace(lower(strip_accents(claim)), '\\s+', ' ', 'g')) order by page_id) = 1""")
def fact_check_claims(spark, sf):
    return reports.claims(sites.fact_check_outcomes(_fact_pages(spark, sf))).select("id", "label")


_SLUGGED = """case when doc_id % 2 = 0 then 'https://otro.pe' else '' end || '/articles/verificadas/' || doc_id % 50"""


@query(f"select distinct case when u like 'http%' then u else 'https://perucheck.pe' || u end as url from (select {_SLUGGED} as u from documents union all select '/d/' || doc_id % 30 from documents where doc_id % 3 = 0)")
def collected_urls(spark, sf):
    i = F.col("doc_id")
    u = F.concat(F.when(i % 2 == 0, "https://otro.pe").otherwise(""), F.lit("/articles/verificadas/"), (i % 50).cast("string"))
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("/d/"), (i % 30).cast("string")).alias("slug")), F.struct(F.lit(None).cast("string").alias("slug"))).alias("data")).alias("articles")).alias("dataArticl")).alias("pageProps")).alias("props")))
    own = F.when(i % 3 == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>"))).otherwise("")
    pages = tables.table(spark, sf, "documents").select(F.concat(F.lit('<a class="x" href="'), u, F.lit('">y</a><a href="/no">z</a>'), own).alias("html"))
    return sites.collected_urls(pages)
