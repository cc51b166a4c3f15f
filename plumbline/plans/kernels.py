"""Queries over text kernels, dataset tools, evidence, caches and SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import lexicon as lx
from ..functions import sql
from ..functions import text as tx
from ..operators import caching, claims, datasets, evidence, metrics, reports, scoring, summaries, training
from ..sources import files, tables
from ..storage import work_folder
from .registry import BASE, NEWS, RAW, TITLE, isoformat, query, token_list, values

_FLOATS = ["1", " 2.5 ", "-3e2", "abc", "", None, ".5", "1d", "NaN", "0x1", "1_0"]


@query("select doc_id, try_cast(x as double) as value from (select doc_id, case when doc_id % 3 = 0 then cast(n_chars as varchar) || '.25' when doc_id % 3 = 1 then ' -' || n_chars || 'e-2 ' else lang end as x from documents)")
def safe_float(spark, sf):
    i, n = F.col("doc_id"), F.col("n_chars").cast("string")
    x = F.when(i % 3 == 0, F.concat(n, F.lit(".25"))).when(i % 3 == 1, F.concat(F.lit(" -"), n, F.lit("e-2 "))).otherwise(F.col("lang"))
    return tables.table(spark, sf, "documents").select("doc_id", tx.safe_float(x).alias("value"))


@query(f"select t as text, v as value from (values {values(list(zip(_FLOATS, [1.0, 2.5, -300.0, None, None, None, 0.5, None, None, None, None])))}) x(t, v)")
def safe_float_cases(spark, sf):
    v = tx.safe_float(F.col("text"))
    return spark.createDataFrame([(x,) for x in _FLOATS], "text string").select("text", F.when(~F.isnan(v), v).alias("value"))


@query(f"with {RAW} select news_raw_id, md5(trim(regexp_replace(title_raw || ' ' || content_raw, '\\s+', ' ', 'g'))) as text from raw")
def coerce_text(spark, sf):
    d = tables.news_raw(spark, sf)
    parts = F.array(F.concat(F.lit("\n "), "title_raw"), F.lit(None).cast("string"), F.concat(F.lit(" "), "content_raw"))
    return d.select("news_raw_id", F.md5(tx.coerce_text(parts).cast("binary")).alias("text"))


@query("select doc_id, md5(text) as text from documents")
def fix_mojibake(spark, sf):
    """Every text that Latin-1 can say is spoiled, and must come back."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    spoiled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    # what has a sign of it from the start is left alone
    clean = ~tx.has(F.col("text"), lx.MOJIBAKE)
    marked = tx.has(spoiled, lx.MOJIBAKE)
    return d.select("doc_id", F.md5(F.when(clean & marked, tx.fix_mojibake(spoiled)).otherwise(F.col("text")).cast("binary")).alias("text"))


_MOJIBAKE = [("Ã¡rbol", "árbol"), ("árbol", "árbol"), ("Ã", "Ã"), ("Ã¡ €", "Ã¡ €"), ("Â¿QuÃ© pasÃ³?", "¿Qué pasó?"), ("plain", "plain"), (None, None)]


@query(f"select * from (values {values(_MOJIBAKE)}) v(text, fixed)")
def mojibake_cases(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in _MOJIBAKE], "text string").select("text", tx.fix_mojibake(F.col("text")).alias("fixed"))


@query(f"""with {NEWS} select news_id, {isoformat("published_at + to_microseconds(news_id % 2)")} as iso, strftime(published_at, '%Y-%m-%d') as day, news_id % 2 = 0 as whole from news""")
def iso_times(spark, sf):
    from .catalogue import _news

    d = _news(spark, sf).withColumn("t", F.timestamp_micros(F.unix_micros("published_at") + F.col("news_id") % 2))
    iso = tx.isoformat(F.col("t"))
    return d.select("news_id", iso.alias("iso"), tx.date_part(iso).alias("day"), (F.col("news_id") % 2 == 0).alias("whole"))


_TIMES = [("2024-02-05T16:03:25-05:00", "2024-02-05 21:03:25"), ("2024-02-05T16:03:25Z", "2024-02-05 16:03:25"), ("2024-02-05", "2024-02-05 00:00:00"), ("2024-02-05 06:07:08", "2024-02-05 06:07:08"), ("ayer", None), ("", None), (None, None)]


@query(f"select t as text, cast(x as timestamp) as time from (values {values(_TIMES)}) v(t, x)")
def parse_times(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in _TIMES], "text string").select("text", tx.parse_time(F.col("text")).alias("time"))


_DATES = [("2024-01-02", "x", "t 2023-01-01", "2024-01-02"), (" ", "2024-02-05T1", "t", "2024-02-05T1"), (None, "", "Redacción: A - 2023-04-05 x", "2023-04-05"), (None, None, "nada", None)]


@query(f"select meta, \"time\", body, date from (values {values(_DATES)}) v(meta, \"time\", body, date)")
def date_cascade(spark, sf):
    d = spark.createDataFrame([x[:3] for x in _DATES], "meta string, time string, body string")
    return d.select("*", tx.first_date(F.col("meta"), F.col("time"), F.col("body")).alias("date"))


_PAYLOADS = [('{"output_text": " hola "}', "hola"), ('{"output_text": "", "output": [{"content": [{"text": null}, {"text": " uno"}]}, {"content": [{"text": "dos"}]}]}', "uno"), ('{"output": []}', None), ('{"output": [{"type": "x"}]}', None), ("no json", None), (None, None)]


@query(f"select payload, t as text from (values {values(_PAYLOADS)}) v(payload, t)")
def output_texts(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in _PAYLOADS], "payload string").select("payload", tx.output_text(F.col("payload")).alias("text"))


@query("select doc_id, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) < 20 as empty, substr(text, 1, 150) as message, substr(text, 1, 50) as version from documents")
def truncated_fields(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", tx.summary_is_empty(F.col("text")).alias("empty"), F.substring("text", 1, 150).alias("message"), F.substring("text", 1, 50).alias("version"))


@query("select doc_id, coalesce(nullif(trim(case when doc_id % 2 = 0 then ' ' else lang end), ''), nullif(trim(case when doc_id % 3 = 0 then '' else ' ' || source || ' ' end), ''), 'x') as chosen from documents")
def first_present(spark, sf):
    i = F.col("doc_id")
    return tables.table(spark, sf, "documents").select("doc_id", F.coalesce(tx.first_present(F.when(i % 2 == 0, " ").otherwise(F.col("lang")), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))), F.lit("x")).alias("chosen"))


@query(f"with {RAW} select news_raw_id, md5(case when starts_with(lower(content_raw), lower(title_raw)) then content_raw else title_raw || '. ' || content_raw end) as context from (select news_raw_id, case when news_raw_id % 2 = 0 then title_raw else 'Otro titular' end as title_raw, content_raw from raw)")
def article_contexts(spark, sf):
    head = F.when(F.col("news_raw_id") % 2 == 0, F.col("title_raw")).otherwise(" Otro  titular")
    return tables.news_raw(spark, sf).select("news_raw_id", F.md5(tx.article_context(head, F.col("content_raw")).cast("binary")).alias("context"))


# --- verdicts over whole tables ------------------------------------------------------------------------------
_WORDS = ["falso", "verdadero", "impreciso", "sin evidencia", "alerta", "contexto", "engañoso", "verdad a medias", "bulo", "Ciérto", "mentira", "manipulado"]
_RATING = f"{_WORDS}[doc_id % 12 + 1]"
_F = "lower(strip_accents(x))"


@query(f"""with d as (select doc_id, {_RATING} as x from documents) select doc_id, case when contains({_F}, 'verdad a medias') or contains({_F}, 'media verdad') then 'Verdad a medias' when regexp_matches({_F}, 'enga|manip|tergivers') then 'Enganoso' when regexp_matches({_F}, 'falso|falsa|bulo|mentira') then 'Falso' when regexp_matches({_F}, 'verdadero|verdadera|cierto|correcto') then 'Verdadero' end as newtral,
    case when regexp_matches({_F}, 'falso|bulo') then 'Falso' when regexp_matches({_F}, 'verdadero|cierto') then 'Verdadero' when contains({_F}, 'alerta') then 'Alerta' when contains({_F}, 'contexto') then 'Contexto' end as maldita from d""")
def publisher_verdicts(spark, sf):
    x = F.get(F.array(*map(F.lit, _WORDS)), (F.col("doc_id") % 12).cast("int"))
    return tables.table(spark, sf, "documents").select("doc_id", lb.newtral_verdict(x).alias("newtral"), lb.maldita_verdict(x).alias("maldita"))


@query("""select doc_id, case doc_id % 5 when 0 then 'Falso' when 1 then 'Verdadero' when 2 then 'Impreciso' when 3 then 'Sin Evidencia' end as verdict from documents""")
def verdict_cascade(spark, sf):
    """The verdict stands in the url, else the title, else the structured data, else the article."""
    k, one = F.col("doc_id") % 5, lambda test, x: F.when(test, x).otherwise("")
    url = F.concat(F.lit("https://p.pe/v/"), F.when(k == 0, "es-falso-que").otherwise("nota"))
    v = lb.verdict(url, one(k == 1, "Es cierto lo dicho"), one(k == 2, "Dato impreciso"), one(k == 3, "Queda sin evidencia alguna"))
    return tables.table(spark, sf, "documents").select("doc_id", v.alias("verdict"))


# --- dataset tools -------------------------------------------------------------------------------------------
def _claims(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    label = F.when(i % 4 == 0, "true").when(i % 4 == 1, "false").when(i % 4 == 2, "other").otherwise("")
    return tables.table(spark, sf, "documents").select("doc_id", "source", label.alias("label"), "text")


@query("select source as path, count(*) as total, count(*) filter (doc_id % 4 = 0) as true, count(*) filter (doc_id % 4 = 1) as false from documents where doc_id % 4 <> 3 group by source")
def labels_by_file(spark, sf):
    return reports.labels_by_file(_claims(spark, sf), "source").withColumnRenamed("source", "path")


@query("select split, doc_id, row_number() over (partition by split order by h) as nth from (select doc_id, md5('42|' || doc_id) as h, case doc_id % 3 when 0 then 'train' else 'test' end as split from documents)")
def numbered_split(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", datasets.shuffled(F.col("doc_id")).alias("h"), F.when(F.col("doc_id") % 3 == 0, "train").otherwise("test").alias("split"))
    return reports.numbered(d, "split", "h").select("split", "doc_id", "nth")


@query("with o as (select doc_id as id, row_number() over (order by md5('42|' || doc_id)) - 1 as r, count(*) over () as n from documents) select id, case when r < floor(n * 0.8) then 'train' when r < floor(n * 0.8) + floor(n * 0.1) then 'validation' else 'test' end as split from o")
def plain_split(spark, sf):
    return datasets.plain_split(tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))).select("id", "split")


@query(f"select doc_id from documents qualify row_number() over (partition by trim(regexp_replace(lower(strip_accents({TITLE})), '\\s+', ' ', 'g')) order by doc_id) = 1")
def keep_first_claims(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", tx.headline(tx.compact(F.col("text"))).alias("t"))
    return datasets.keep_first(d, tx.normalized(F.col("t")), "doc_id").select("doc_id")


_LIAR = ["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true"]


@query(f"with d as (select doc_id, {_LIAR}[doc_id % 6 + 1] as l from documents) select l as label, count(*) as n from d where l = 'half-true' group by l")
def skipped_labels(spark, sf):
    return reports.liar_examples(_liar(spark, sf))[1]


@query(f"with d as (select doc_id, {_LIAR}[doc_id % 6 + 1] as l, case when doc_id % 10 = 0 then ' ' else 'x' end as t from documents) select doc_id, cast(l in ('half-true', 'mostly-true', 'true') as int) as label from d where t <> ' '")
def liar_examples(spark, sf):
    return reports.liar_examples(_liar(spark, sf), "relaxed")[0].select("doc_id", "label")


def _liar(spark: SparkSession, sf: str) -> DataFrame:
    label = F.get(F.array(*map(F.lit, _LIAR)), (F.col("doc_id") % 6).cast("int"))
    return tables.table(spark, sf, "documents").select("doc_id", label.alias("label"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise("x").alias("claim_text"))


_SPLIT_PRED = "p as (select ['validation', 'test', 'train'][doc_id % 3 + 1] as split, case when quality = 1 then 'true' else 'false' end as gold, case when ((doc_id * 7919) % 1000) / 2000.0 + (1 - quality) * 0.5 >= 0.5 then 'false' else 'true' end as pred from labels)"


@query(f"""with {_SPLIT_PRED}, l(label) as (values ('true'), ('false')), s as (select distinct split from p), c as (select s.split, label, (select count(*) from p where p.split = s.split) as examples, (select avg(case when gold = pred then 1.0 else 0 end) from p where p.split = s.split) as accuracy,
        (select count(*) from p where p.split = s.split and gold = label and pred = label) as t, (select count(*) from p where p.split = s.split and pred = label) as pp, (select count(*) from p where p.split = s.split and gold = label) as support from s, l),
    r as (select *, case when pp = 0 then 0 else t / pp end as precision, case when support = 0 then 0 else t / support end as recall from c), f as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from r)
    select split, label, examples, support, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(avg(f1) over (partition by split), 6) as macro_f1 from f""")
def split_report(spark, sf):
    d = reports.split_metrics(_split_predictions(spark, sf), ["true", "false"])
    return d.select("split", "label", "examples", "support", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "macro_f1")])


def _split_predictions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    d = tables.scored_labels(spark, sf).withColumn("split", F.get(F.array(F.lit("validation"), F.lit("test"), F.lit("train")), (i % 3).cast("int")))
    exact = ((i * 7919) % 1000) / 2000.0 + F.when(F.col("gold") == "true", 0.0).otherwise(0.5)
    return d.select("split", "gold", F.when(exact >= 0.5, "false").otherwise("true").alias("pred"))


@query(f"""with scored as (select case when quality = 1 then 'true' else 'false' end as gold, round(((doc_id * 7919) % 1000) / 2000.0 + (1 - quality) * 0.5, 4) as risk from labels), x as (select distinct risk as v from scored union select 0.0 union select 1.0),
    k as (select v, (select count(*) from scored where risk <= v and gold = 'true') as tle, (select count(*) from scored where risk <= v) as le, (select count(*) from scored where risk >= v) as ge, (select count(*) from scored where risk >= v and gold = 'false') as fge from x),
    c as (select a.v as low, b.v as high, (select count(*) from scored) as n, (select count(*) from scored where gold = 'true') as tt, (select count(*) from scored where gold = 'false') as ft, a.le as pt, b.ge as pf, a.tle as tpt, b.fge as tpf from k a join k b on a.v < b.v),
    r as (select *, case when pf = 0 then 0 else tpf / pf end as fp, case when ft = 0 then 0 else tpf / ft end as fr, case when pt = 0 then 0 else tpt / pt end as tp, case when tt = 0 then 0 else tpt / tt end as tr, (pt + pf) / n as coverage, case when pt + pf = 0 then 0 else (tpt + tpf) / (pt + pf) end as acc from c),
    m as (select *, (case when fp + fr = 0 then 0 else 2 * fp * fr / (fp + fr) end + case when tp + tr = 0 then 0 else 2 * tp * tr / (tp + tr) end) / 2 as f from r)
    select low, high, round(coverage, 6) as coverage, round(f, 6) as macro_f1 from m order by round(coverage, 12) desc, round(f, 12) desc, round(acc, 12) desc, round(fp + tp, 12) desc, low, high limit 5""")
def threshold_candidates(spark, sf):
    return metrics.threshold_candidates(tables.scored_labels(spark, sf), 5).select("low", "high", F.round("coverage", 6).alias("coverage"), F.round("macro_f1", 6).alias("macro_f1"))


_COLUMNS = [("claim,label,lang", "claim"), ("text_claim,rating", "text_claim"), ("Claim,body", "Claim"), ("a,b", None)]


@query(f"select * from (values {values(_COLUMNS)}) v(columns, chosen)")
def column_guess(spark, sf):
    found = [(c, training.guess_column(c.split(","), ["claim", "text"])) for c, _ in _COLUMNS]
    return spark.createDataFrame(found, "columns string, chosen string")


@query("""with c as (select doc_id, ' ' || doc_id || ' ' as id from documents), r as (select cast(doc_id % 100 as varchar) as id, doc_id as row, repeat('w ', cast(doc_id % 150 as int)) as summary from documents), l as (select id, arg_max(summary, row) as s from r group by id)
    select doc_id, len(list_filter(string_split_regex(coalesce(s, ''), '\\s+'), lambda w: w <> '')) as words, len(list_filter(string_split_regex(coalesce(s, ''), '\\s+'), lambda w: w <> '')) between 50 and 130 as in_band from c left join l on l.id = trim(c.id)""")
def merged_references(spark, sf):
    i = F.col("doc_id")
    d = tables.table(spark, sf, "documents")
    refs = d.select((i % 100).cast("string").alias("id"), i.alias("row"), F.repeat(F.lit("w "), (i % 150).cast("int")).alias("summary"))
    cands = d.select(i, F.concat(F.lit(" "), i.cast("string"), F.lit(" ")).alias("id"))
    return summaries.merge_references(cands, refs).select("doc_id", F.col("words").cast("long").alias("words"), "in_band")


@query("""with old as (select doc_id, case when doc_id % 4 = 0 then ' ' else 'viejo' end as s from documents where doc_id % 2 = 0) select d.doc_id as news_processed_id, case when old.s = 'viejo' then 'viejo' else 'nuevo' end as summary_text from documents d left join old using (doc_id)""")
def reused_summaries(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("news_processed_id"))
    old = d.where("news_processed_id % 2 = 0").withColumn("summary_text", F.when(F.col("news_processed_id") % 4 == 0, " ").otherwise("viejo"))
    return summaries.reuse(old, d.withColumn("summary_text", F.lit("nuevo")))


@query("select 'json' as kind, count(*) as n from documents where doc_id % 4 in (0, 1) union all select 'gated', count(*) from documents where length(trim(text)) >= 300 and doc_id % 2 = 0 union all select 'urls', count(distinct url) from pages where page_id % 3 = 0 union all select 'tsv', count(*) from documents where doc_id % 4 in (0, 1)")
def file_round_trips(spark, sf):
    """Sources and sinks: JSON lines with labels, a CSV with a least length, a list of urls with comments, a headerless TSV."""
    out = work_folder(spark, "files")
    i = F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    rows = _claims(spark, sf).select(i.alias("id"), F.concat(F.lit("c "), i).alias("claim_text"), "label", none.alias("verdict_raw"), none.alias("url"), F.lit("s").alias("source"), none.alias("date"))
    files.write_jsonl(rows, f"{out}/claims.json")
    kept = files.read_claims_jsonl(spark, f"{out}/claims.json")
    files.write_claims_tsv(kept, f"{out}/claims.tsv")
    files.write_csv(tables.table(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", "text"), f"{out}/texts.csv")
    gated = files.read_table(spark, f"{out}/texts.csv", "text", 300)
    urls = tables.table(spark, sf, "pages").select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("# "), "url")).otherwise("").alias("value"))
    urls.write.text(f"{out}/urls.txt")
    n = lambda kind, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("json", kept).unionByName(n("gated", gated)).unionByName(n("urls", files.read_urls(spark, f"{out}/urls.txt").distinct())).unionByName(n("tsv", files.read_liar_tsv(spark, f"{out}/claims.tsv")))


@query()
def oversampled(spark, sf):
    """Labels in about equal numbers, drawn with replacement: a random draw, which SQL doesn't repeat."""
    return training.oversample(tables.scored_labels(spark, sf), "gold").groupBy("gold").agg(F.count(F.lit(1)).alias("n"))


# --- probabilities -------------------------------------------------------------------------------------------
@query("""with z as (select doc_id, [(doc_id % 7) / 2.0, (doc_id % 5) / 3.0, 0.5]::double[] as z from documents), e as (select doc_id, z, list_transform(z, lambda x: exp(x - list_max(z))) as e from z)
    select doc_id, round(e[1] / list_sum(e), 6) as first, list_position(z, list_max(z)) - 1 as best, round(pow(1 - e[1] / list_sum(e), 2) * -ln(e[1] / list_sum(e)), 6) as focal from e""")
def softmax_focal(spark, sf):
    i = F.col("doc_id")
    z = F.array((i % 7) / 2.0, (i % 5) / 3.0, F.lit(0.5))
    p = F.get(scoring.softmax(z), F.lit(0))
    return tables.table(spark, sf, "documents").select("doc_id", F.round(p, 6).alias("first"), (F.array_position(z, F.array_max(z)) - 1).alias("best"), F.round(scoring.focal_loss(p), 6).alias("focal"))


@query("""with c as (select conv_id // 2 as doc_id, round(((conv_id * 31 + turn) % 97) / 97.0, 4) as p from conversations), g as (select doc_id, (2 * sum(cast(round(p * 10000) as bigint)) + count(*)) // (2 * count(*)) / 10000.0 as risk, count(*) as claims from c group by 1)
    select doc_id, cast(risk as double) as risk, claims, round(1 - risk, 4) as real_support, case when risk >= 0.5 then 'False' else 'True' end as label from g""")
def risk_without_stance(spark, sf):
    c = tables.table(spark, sf, "conversations").select(F.expr("conv_id div 2").alias("doc_id"), F.round((F.col("conv_id") * 31 + F.col("turn")) % 97 / 97.0, 4).alias("p_false"))
    return scoring.article_risk_without_stance(c)


# --- evidence ------------------------------------------------------------------------------------------------
_CONCLUSIONS = [("Coincide.", 1, "Coincide."), ("No se encontró evidencia.", 0, "No se encontró evidencia."), ("", 1, "uno"), (None, 2, "varios"), ("Encontré dos notas.", 2, "varios"), ("Evidencia insuficiente", 1, "uno")]


@query(f"select t as text, n, case e when 'uno' then 'La evidencia periodística disponible se sustenta en un reporte de RPP relacionado con la afirmación analizada.' when 'varios' then 'La información difundida coincide con reportes publicados por varias fuentes periodísticas confiables, entre ellas RPP, Gestión, que documentan elementos relacionados con la afirmación analizada.' else e end as conclusion from (values {values(_CONCLUSIONS)}) v(t, n, e)")
def evidence_conclusions(spark, sf):
    d = spark.createDataFrame([x[:2] for x in _CONCLUSIONS], "text string, n int")
    listed = F.slice(F.array(F.struct(F.lit("RPP").alias("source")), F.struct(F.lit("Gestión").alias("source"))), F.lit(1), F.col("n"))
    return d.select("text", "n", evidence.conclusion(F.col("text"), listed).alias("conclusion"))


_SITES = ["https://rpp.pe/a/", "https://gestion.pe/b/", "https://x.com/c/", "https://blog.example/d/", "https://www.elcomercio.pe/e/"]


@query(f"""with r as (select page_id, {_SITES}[page_id % 5 + 1] || page_id as a, {_SITES}[(page_id // 5) % 5 + 1] || page_id as b, page_id % 3 as g from pages), u as (select page_id, g, unnest([a, b, a]) as url, unnest([0, 1, 2]) as i from r),
    k as (select page_id, g, url, min(i) as i from u where url not like 'https://x.com%' and url not like 'https://blog.example%' group by all), m as (select *, g = 1 and (url like 'https://rpp.pe%') as near from k),
    c as (select page_id, url, i from m where not (select bool_or(x.near) from m x where x.page_id = m.page_id) or near) select r.page_id, coalesce(string_agg(c.url, ' ' order by c.i), '') as urls from r left join c using (page_id) group by r.page_id""")
def evidence_sources(spark, sf):
    """Allowed ones, each once; those of a grounded domain, if any."""
    i = F.col("page_id")
    site = lambda k: F.concat(F.get(F.array(*map(F.lit, _SITES)), k.cast("int")), i.cast("string"))
    listed = lambda k: F.struct(site(k).alias("url"), F.lit("x").alias("source"), F.lit("Nota").alias("title"))
    second = F.floor(i / 5) % 5
    d = tables.table(spark, sf, "pages").select(i, F.array(listed(i % 5), listed(second), listed(i % 5)).alias("sources"), F.when(i % 3 == 1, F.array(F.lit("https://rpp.pe/otra"))).otherwise(F.array().cast("array<string>")).alias("grounded"))
    return evidence.normalise_sources(d).select("page_id", F.array_join(F.transform("sources", lambda s: s.url), " ").alias("urls"))


@query("""with recursive c as (select event_type as service, cast(user_id as varchar) as key, epoch_us(ts) as t from events), k as (select service, key, t, row_number() over (partition by service, key order by t) as i from c),
    w as (select service, key, i, t as made, false as hit from k where i = 1 union all select k.service, k.key, k.i, case when k.t - w.made < 3600000000 then w.made else k.t end, k.t - w.made < 3600000000 from w join k on k.service = w.service and k.key = w.key and k.i = w.i + 1)
    select count(*) filter (hit) as hits, count(*) filter (not hit) as misses, printf('%.2f%%', 100.0 * count(*) filter (hit) / count(*)) as hit_rate from w""")
def cache_stats(spark, sf):
    """Replayed calls: each event type is a service, each user a key. Fewer keys than the size live at once, so entries end by time alone."""
    calls = tables.table(spark, sf, "events").select(F.col("event_type").alias("service"), F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"))
    return caching.stats(caching.replay(calls, size=1 << 30))


@query("select user_id % 500 as prediction_id, max(ts) as generated_at from events where ts > (select max(ts) from events) - interval 3600 seconds group by 1")
def cache_alive(spark, sf):
    """The cache after all reports are put, asked one hour of life before the last."""
    d = tables.table(spark, sf, "events").select((F.col("user_id") % 500).alias("prediction_id"), F.col("ts").cast("timestamp").alias("generated_at"))
    cache = d.groupBy("prediction_id").agg(F.max("generated_at").alias("generated_at"))
    return caching.alive(cache, F.lit(d.agg(F.max("generated_at")).first()[0]))


# --- claims of known sentences, one for each rule --------------------------------------------------------------
#: title, body, mode and target of the only claim (null where there is none).
CASES = [
    ("", "El alcalde asegura que la obra del puente costó {n} millones de soles.", "reported_claim", "la obra del puente costó {n} millones de soles"),
    ("", "La ministra niega que el hospital {n} cerró en marzo pasado.", "refutation_projected", "el hospital {n} cerró en marzo pasado"),
    ("Newtral: ¿El congreso aprobó cerrar {n} colegios? Es falso, no hubo votación", "", "factcheck_question", "El congreso aprobó cerrar {n} colegios"),
    ("Es falso que la vacuna contiene {n} chips de rastreo", "", "factcheck_verdict", "la vacuna contiene {n} chips de rastreo"),
    ("Es falso el video que demostraría que Lima quedó {n} días sin agua", "", "factcheck_embedded", "lima quedo {n} dias sin agua"),
    ("", "Según el informe anual, la pobreza bajó {n} puntos en la sierra norte.", "reported_claim", "la pobreza bajó {n} puntos en la sierra norte"),
    ("", "El vocero dijo esta mañana ante la prensa que la deuda subió a {n} millones.", "reported_claim", "la deuda subió a {n} millones"),
    ("", "Leer resumen de la nota con {n} datos sobre el presupuesto del año.", None, None),
    ("", "AB-12 es el código del expediente {n} que firmó la oficina central.", None, None),
    ("", "20245 fue el año {n} con más lluvias registradas en toda la costa norte.", None, None),
    ("", "Yo creo que el presupuesto de {n} fue muy alto para la región.", None, None),
    ("", "El diputado afirma que es necesario cambiar las {n} normas de tránsito ya.", None, None),
    ("", "El clima de la región estuvo templado durante toda la semana pasada.", None, None),
    ("", "¿Cuándo se publicarán los {n} informes que pidió la comisión de salud?", None, None),
    ("", "También mencionó que la planta produjo {n} toneladas de arroz.", "reported_claim", "la planta produjo {n} toneladas de arroz"),
    ("", "El acta de {n} tiene 15 páginas firmadas por los miembros del consejo.", "verbatim", "El acta de {n} tiene 15 páginas firmadas por los miembros del consejo"),
]


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """An article for each document, with the sentence of its case and the document's number in it."""
    k, n = (F.col("doc_id") % len(CASES)).cast("int"), F.col("doc_id").cast("string")
    pick = lambda j: F.replace(F.get(F.array(*[F.lit(c[j]) for c in CASES]), k), F.lit("{n}"), n)
    return tables.table(spark, sf, "documents").select("doc_id", pick(0).alias("title"), pick(1).alias("body"))


_CASES = ", ".join(f"({i}, {values([c])[1:]}" for i, c in enumerate(CASES))


@query(f"select doc_id, 1 as rank, mode, replace(target, '{{n}}', cast(doc_id as varchar)) as target from documents join (values {_CASES}) c(k, title, body, mode, target) on k = doc_id % {len(CASES)} where mode is not null")
def claim_cases(spark, sf):
    return claims.extract_claims(cases(spark, sf)).select("doc_id", "rank", "mode", "target")


# --- SQL functions ---------------------------------------------------------------------------------------------
@query(f"""{BASE}, c as (select news_raw_id, list_distinct({token_list('title_raw')}) as a, list_distinct({token_list('content_raw')}) as b, content_raw, clean_text, language from processed)
    select news_raw_id, case when len(a) = 0 or len(b) = 0 then 0.0 else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) end as jaccard, case when len(a) = 0 or len(b) = 0 then 0.0 else round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) end as overlap,
    len(list_filter(string_split(content_raw, ' '), lambda x: x <> '')) as tokens, md5(clean_text) as clean, language as lang, 1.0::double as rouge from c""")
def sql_functions(spark, sf):
    sql.register(spark)
    d = tables.news_raw(spark, sf).select("news_raw_id", tx.cluster_tokens(F.col("title_raw")).alias("a"), tx.cluster_tokens(F.col("content_raw")).alias("b"), "title_raw", "content_raw")
    d.createOrReplaceTempView("sql_functions_input")
    return spark.sql("""select news_raw_id, round(jaccard(a, b), 6) as jaccard, round(overlap(a, b), 6) as overlap, cast(count_tokens(content_raw) as bigint) as tokens, md5(clean_text(concat_ws('\n', title_raw, content_raw))) as clean,
        detect_lang(clean_text(concat_ws('\n', title_raw, content_raw))) as lang, rouge_l(concat('x ', title_raw), concat('x ', title_raw)) as rouge from sql_functions_input""")


@query(f"select doc_id, 1 as rank, mode, replace(target, '{{n}}', cast(doc_id as varchar)) as target from documents join (values {_CASES}) c(k, title, body, mode, target) on k = doc_id % {len(CASES)} where mode = 'reported_claim'")
def claims_for_sql(spark, sf):
    """The claims' view for SQL users."""
    cases(spark, sf).createOrReplaceTempView("claim_articles")
    sql.claims_view(spark, "claim_articles", "claims_of_articles")
    return spark.sql("select doc_id, rank, mode, target from claims_of_articles where mode = 'reported_claim'")
