"""The corpus pipeline, stage by stage, against brute force on a small table."""

import collections
import re

import corpus_pipeline
import pytest

from .test_operators import _components, _quality, _sets, _words, edge_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long"))
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") + "/pipeline"
    out, columns = [docs.collect()], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        docs.write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append(docs.collect())
    return out


def test_quality_drops_what_fails_the_base_rule(stages):
    kept = {r["doc_id"] for r in stages[1]}
    for r in stages[0]:
        words, *_, repeated = _quality(r["text"])
        failed = words < 50 or 100 * repeated > 50 * words
        # 87 labels prove no cutoff, so the base rule alone decides here
        assert (r["doc_id"] in kept) == (not failed)


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1]]
    groups = _components(_sets(rows, 5), 80)
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(set(groups.values()))


def test_no_entity_stays(stages):
    before, after = {r["doc_id"]: r["text"] for r in stages[2]}, {r["doc_id"]: r["text"] for r in stages[3]}
    assert before.keys() == after.keys()
    pattern = re.compile(r"[\w.]+@[\w.]+\w|\(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-f]{40}\b|\b(?:\d{1,3}\.){3}\d{1,3}\b")
    entities = {m for t in before.values() for m in pattern.findall(t)}
    for d, t in before.items():
        found = pattern.findall(t)
        assert (after[d] == t) == (not found) and len(pattern.findall(after[d])) == len(found)
        assert not set(pattern.findall(after[d])) & entities


def test_mix_and_packs_are_whole(spark, stages):
    from plumbline.llm import mixing

    docs = spark.createDataFrame(stages[3], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect() if r["taken"]}
    got = collections.Counter()
    for r in stages[4]:
        got[r["doc_id"]] += len(_words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert dict(got) == want
    pieces = collections.defaultdict(list)
    for r in stages[5]:
        pieces[r["doc_id"], r["copy"]].append((r["start"], r["length"], r["doc_tokens"]))
    rows = collections.Counter(r["doc_id"] for r in stages[4])
    assert sum(rows.values()) == sum(1 for p in pieces.values() for start, *_ in p if start == 0)
    for p in pieces.values():
        per = len([1 for start, *_ in p if start == 0])
        assert sum(n for _, n, _ in p) == per * p[0][2]


def test_run_equals_its_stages(spark):
    spark.conf.set("plumbline.pii.key", "test")
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        want = sorted(tuple(r) for r in docs.select(*names).collect())
        assert want and sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select(*names).collect()) == want
    finally:
        spark.conf.unset("plumbline.pii.key")


def test_stages_of_an_empty_table_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    own = spark.createDataFrame([(1, "w1 w2 w3 a@b.de " + " ".join(f"w{i}" for i in range(9, 90)), "mine", "too", True)], "doc_id long, text string, n_words string, n_entities string, kept boolean")
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.hide_persons):
        row = stage(spark, own, SF).first()
        assert (row["n_words"], row["n_entities"], row["kept"]) == ("mine", "too", True) and row.__fields__ == own.columns
