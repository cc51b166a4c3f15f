"""The queries of this subpackage, and their SQL where it can say the same."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, langid, media, mixing, packing, pii, quality, substring, token_shards, warc
from .common import read_documents


def _crc(raw: bytes, dtype: np.dtype) -> int:
    return zlib.crc32(np.frombuffer(raw, dtype).astype("<u4").tobytes())


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    folder = token_shards.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    read = token_shards.read_payloads(folder, token_shards.document_keys(docs), _crc, "long")
    return read.select("doc_id", "start", F.col("n").cast("long").alias("n_tokens"), F.col("value").alias("ids_crc32"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(read_documents(spark, sf_dir).select("doc_id", "text"), percent=90, k=3)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    judged = quality.judge(docs.withColumn("text", F.col("text")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    network = langid.fit(docs, ~F.coalesce(held_out(), F.lit(False)))
    found = langid.predict(docs.select("doc_id", "text"), network)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.stored(read_documents(spark, sf_dir))
    return media.read_media(files, media.chunk_store(files)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder, files = warc.write_archives(warc.resolve(pages))
    return warc.full_records(warc.read_archives(folder, files))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.strip_repeats(read_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_ngram_jaccard_join, op3_quality_rules, op4_language_id, op5_media_columns, op6_packing, op7_mixing, op8_warc, op9_substring_dedup, op10_pii)}

_SPLIT = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op2_ngram_jaccard_join": f"""
        with recursive w as (select doc_id, {_SPLIT.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as l from documents),
        s as (select doc_id, case when len(l) >= 3 then list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) when len(l) > 0 then [array_to_string(l, ' ')] else [] end as s from w),
        t as (select doc_id, len(s) as n, unnest(s) as x from s),
        p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o from t a join t b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by 1, 2),
        k as (select a, b from p where 100 * o >= 90 * (na + nb - o)), e as (select a, b from k union all select b, a from k),
        r as (select doc_id as id, doc_id as c from s union select e.b, r.c from r join e on e.a = r.id)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.c) as component_id from s join r on r.id = s.doc_id group by s.doc_id, len(s.s)""",
    "op9_substring_dedup": f"""
        with w as (select doc_id, {_SPLIT} as l from documents),
        v as (select doc_id, i, md5(array_to_string(l[i : i + 49], ' ')) as h from (select doc_id, l, unnest(range(1, len(l) - 48)) as i from w where len(l) >= 50)),
        o as (select h, min(doc_id) as first from v group by h), b as (select v.doc_id, v.i from v join o using (h) where o.first < v.doc_id),
        x as (select w.doc_id, w.i, w.x, max(b.i) over (partition by w.doc_id order by w.i) as last from (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as x from w) w left join b on b.doc_id = w.doc_id and b.i = w.i),
        k as (select doc_id, count(*) filter (last is null or i - last >= 50) as kept, string_agg(x, ' ' order by i) filter (last is null or i - last >= 50) as t from x group by doc_id)
        select w.doc_id, cast(len(w.l) as bigint) as n_words, cast(len(w.l) - coalesce(k.kept, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from w left join k using (doc_id)""",
    "op8_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as b from pages),
        d as (select page_id, octet_length(b) as n, sha256(b) as h from p),
        f as (select h, min(page_id) as first from d where n >= 100 group by h)
        select d.page_id, cast(d.n as bigint) as payload_bytes, d.h as payload_digest,
               case when f.first is null or f.first = d.page_id then 'response' else 'revisit' end as record_type,
               case when f.first <> d.page_id then f.first end as refers_to
        from d left join f on d.h = f.h""",
}
