"""What steps of the training-data operators hold: bytes of a batch, and shuffles that are finished."""

import os

from pyspark.sql import functions as F

from plumbline.llm import common, jaccard_join


def test_batches_are_bounded_by_bytes(spark):
    common.work_dir(spark, "bounds")
    rows = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    got = [r["n"] for r in rows.mapInArrow(run, "n long").collect()]
    assert sum(got) == 1000 and max(got) * 100_000 <= common.BATCH_BYTES + 200_000


def test_join_releases_finished_shuffles(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(jaccard_join, "release", lambda s: calls.append(s), raising=False)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "a b c d")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and len(calls) >= 5


def test_join_deletes_tables_that_it_no_longer_reads(spark, monkeypatch):
    written = []
    keep = jaccard_join.cut

    def noted(df, name):
        written.append((name, keep(df, name)))
        return written[-1][1]

    monkeypatch.setattr(jaccard_join, "cut", noted)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "a b c d")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    there = {name: os.path.isdir(table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) for name, table in written if name in ("sets", "members", "rows")}
    assert there == {"sets": False, "members": False, "rows": True}


def test_trim_drops_kept_encoders():
    import public_tokenizers

    from plumbline.llm import tokens

    tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.encoder.cache_info().currsize
    common.trim()
    assert not tokens.encoder.cache_info().currsize
