"""The registered queries on tables with odd rows: those with SQL against it, all for their columns and rows."""

import duckdb
import pytest

from plumbline.llm import queries
from verify import rows

from .test_operators import SF, edge_rows

COLUMNS = {
    "op1_token_shards": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op2_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_pii": ["doc_id", "text", "n_entities"],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with the edge rows, and pages with repeated payloads and page_ids."""
    out = str(tmp_path_factory.mktemp("odd"))
    spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")).coalesce(1).write.parquet(f"{out}/documents.parquet")
    a, b = "<p>" + "á" * 80 + "</p>", "<p>" + "b" * 200 + "</p>"
    extra = [(-3, a), (-3, b), (-5, b), (-6, a), (-7, "x"), (-8, "x"), (-9, None), (-9, a), (-1, "c" * 100)] + [(1000 + i, a) for i in range(200)]
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in extra], "page_id long, url string, html string"))
    pages.coalesce(1).write.parquet(f"{out}/pages.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    assert got.columns == COLUMNS[name]
    data = [tuple(r) for r in got.collect()]
    assert data
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
        want = con.execute(queries.ORACLE_SQL[name])
        assert rows(got.columns, data) == rows([d[0] for d in want.description], want.fetchall())
    elif name != "op6_packing":
        assert len(data) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_media_features(spark, folder):
    import math
    import statistics

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op5_media_columns(spark, folder).collect():
        raw = docs[r["doc_id"]]
        x = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        p = [x.count(b) / len(x) for b in set(x)]
        got = dict(f.split("=") for f in r["feature"].split(";"))
        assert float(got["mean"]) == pytest.approx(statistics.fmean(x), abs=1e-3) and float(got["std"]) == pytest.approx(statistics.pstdev(x), abs=1e-3)
        assert int(got["crossings"]) == sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))
        assert float(got["entropy"]) == pytest.approx(-sum(q * math.log2(q) for q in p), abs=1e-3) and float(got["fill"]) == pytest.approx(x.count(255) / len(x), abs=1e-4)
