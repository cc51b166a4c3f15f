"""Clusters against a plain loop, scores, thresholds, evidence, files, pages and streams on rows of our own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import labels, text
from plumbline.operators import clustering, datasets, evidence, metrics, preprocess, scoring, serving
from plumbline.sources import files, html
from plumbline.streaming import jobs


def test_clusters_equal_the_sequential_loop(spark):
    r = random.Random(8)
    words = [f"tema{i}" for i in range(40)]
    rows = []
    for i in range(60):
        topic = r.randrange(8) * 5
        body = [r.choice(words[topic : topic + 9] if topic < 31 else words[topic:]) for _ in range(14)]
        rows.append((i, " ".join(body[:5]), " ".join(body)))
    articles = spark.createDataFrame(rows, "id long, title string, text string")

    def sets(title, body):
        t, b = list(dict.fromkeys(title.split())), list(dict.fromkeys(body.split()))
        return set(t), set(b[:120]), set(b)

    ctx = {i: sets(t, b) for i, t, b in rows}

    def sim(x, y):
        (t1, l1, b1), (t2, l2, b2) = ctx[x], ctx[y]
        jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        t, c = (len(t1 & t2) / min(len(t1), len(t2)) if t1 and t2 else 0.0), max(jac(l1, l2), jac(b1, b2))
        return round(max(jac(b1, b2), 0.65 * t + 0.35 * c if t >= 0.35 else c), 4)

    want = {(a, b): sim(a, b) for a in range(60) for b in range(a + 1, 60) if sim(a, b) >= 0.40}
    pairs = clustering.similar_pairs(articles).cache()
    assert {(p["a"], p["b"]): p["sim"] for p in pairs.collect()} == pytest.approx(want, abs=1e-4)
    founders, leader = [], {}
    for i in range(60):
        best = max(((sim(f, i), -f) for f in founders), default=(0, 0))
        if best[0] >= 0.40:
            leader[i] = -best[1]
        else:
            founders.append(i)
            leader[i] = i
    got = clustering.leaders(articles.select("id", F.col("id").alias("rank")), pairs)
    assert {x["id"]: x["leader"] for x in got.collect()} == leader
    reps = clustering.representatives(got, clustering.contexts(articles)).collect()
    assert {x["leader"] for x in reps} == set(founders) and all(leader[x["representative"]] == x["leader"] for x in reps)


def test_signals_and_triage(spark):
    # a false claim that the article refutes, and one that it supports
    rows = spark.createDataFrame([(1, 0.9, 0.1, 0.0, 0.10, 0.05, 0.85), (2, 0.9, 0.1, 1.0, 0.0, 0.0, 0.0)], "doc_id long, p_false double, p_true double, stance_agree double, stance_discuss double, stance_unrelated double, stance_disagree double")
    got = {r["doc_id"]: r for r in scoring.article_risk(scoring.claim_signals(rows)).withColumn("t", scoring.triage(F.col("risk"))).collect()}
    assert got[1]["risk"] < 0.2 and got[1]["label"] == "True" and got[1]["t"] == "likely_real"
    assert got[2]["risk"] == 0.9 and got[2]["label"] == "False" and got[2]["t"] == "likely_fake"


def test_thresholds_against_the_full_grid(spark):
    r = random.Random(3)
    rows = [("true" if r.random() < 0.6 else "false", None) for _ in range(80)]
    rows = [(g, round(min(1.0, max(0.0, r.gauss(0.3 if g == "true" else 0.75, 0.2))), 2)) for g, _ in rows]
    d = spark.createDataFrame(rows, "gold string, risk double")
    best = None
    cands = sorted({0.0, 1.0, *[x for _, x in rows]})
    for low in cands:
        for high in cands:
            if low < high:
                pt, pf = [g for g, x in rows if x <= low], [g for g, x in rows if x > low and x >= high]
                tt, tf = pt.count("true"), pf.count("false")
                if pt and pf and tt / len(pt) >= 0.8 and tf / len(pf) >= 0.9:
                    n_t, n_f = sum(g == "true" for g, _ in rows), sum(g == "false" for g, _ in rows)
                    f = lambda p, q: 2 * p * q / (p + q) if p + q else 0.0
                    macro = (f(tf / len(pf), tf / n_f) + f(tt / len(pt), tt / n_t)) / 2
                    key = (round((len(pt) + len(pf)) / len(rows), 12), round(macro, 12), round((tt + tf) / (len(pt) + len(pf)), 12), round(tt / len(pt) + tf / len(pf), 12), -low, -high)
                    best = max(best, key) if best else key
    x = metrics.fit_thresholds(d).first()
    assert (x["low"], x["high"]) == (-best[4], -best[5])


def test_rouge(spark):
    d = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a b", "c d"), (3, "", "a"), (4, "a x b y c", "a b c z")], "id long, candidate string, reference string")
    one = {r["id"]: r["f1"] for r in metrics.rouge_n(d, 1).collect()}
    assert one[1] == 1 and one[2] == 0 and one[3] == 0 and one[4] == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    longest = {r["id"]: r["f1"] for r in metrics.rouge_l(d).collect()}
    assert longest == {1: 1.0, 2: 0.0, 3: 0.0, 4: pytest.approx(one[4])}


def test_splits_are_disjoint_and_whole(spark):
    d = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "true").otherwise("false").alias("label"))
    s = datasets.stratified_split(d).groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in s} == {("true", "train"): 267, ("true", "validation"): 33, ("true", "test"): 34, ("false", "train"): 532, ("false", "validation"): 66, ("false", "test"): 68}
    g = datasets.grouped_split(d.withColumn("g", F.col("id") % 37), "g")
    assert g.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0 and 100 <= g.where("split = 'validation'").count() < 128


def test_text_kernels(spark):
    d = spark.createDataFrame([("<b>Ver</b> https://a.pe/x @yo #tag (15%) año",)], "t string")
    assert d.select(text.clean_text(F.col("t"))).first()[0] == "Ver 15 año"
    row = spark.createDataFrame([("Straße co-operó ﬁn 5G de la",)], "t string").select(text.cluster_tokens(F.col("t"))).first()[0]
    assert row == ["strae", "coopero", "fin", "5g"]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("maybe",)], "t string").select(labels.liar_label(F.col("t"))).collect()


def test_ingest_merge_and_seed(spark):
    cols = "news_raw_id long, source_id int, original_url string, title_raw string, content_raw string"
    batch = spark.createDataFrame([(1, 1, "u", "t", "c"), (2, 1, "u", "t", "c"), (3, 1, "v", " ", "c"), (4, 2, "k", "t", "c")], cols)
    known = spark.createDataFrame([(2, "k")], "source_id int, original_url string")
    assert {r["news_raw_id"]: r["outcome"] for r in preprocess.ingest_outcome(batch, known).collect()} == {1: "saved", 2: "duplicate", 3: "incomplete", 4: "duplicate"}
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    assert sorted((r["k"], r["v"]) for r in preprocess.merge(old, new, ["k"], "at").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    have = spark.createDataFrame([("Peru21", "x", "web", True)], "name string, base_url string, type string, is_active boolean")
    assert preprocess.seed_sources(have).count() == 4


def test_serving(spark):
    ev = spark.createDataFrame([(1, 7, 1, 1, 1), (2, 7, 1, -1, 2), (3, 8, 1, 1, 1), (4, 8, 1, 0, 2)], "event_id long, user_id long, news_id long, reaction int, created_at int")
    assert [(r["user_id"], r["reaction"]) for r in serving.latest_reactions(ev).collect()] == [(7, -1)]


def test_evidence(spark):
    sources = [("https://rpp.pe/politica/el-congreso-aprobo-la-ley-noticia/", "RPP", "The law will pass"), ("https://rpp.pe/politica/el-congreso-aprobo-la-ley-noticia/", "RPP", "x"), ("https://gestion.pe/x", "Gestión", "Otra"), ("https://x.com/y", "RPP", "no")]
    d = spark.createDataFrame([(1, sources, ["https://www.rpp.pe/otra"]), (2, sources, ["https://nadie.example/"]), (3, [], [])], "id int, sources array<struct<url: string, source: string, title: string>>, grounded array<string>")
    got = {r["id"]: r["sources"] for r in evidence.normalise_sources(d).collect()}
    assert [(s["source"], s["title"]) for s in got[1]] == [("RPP", "El Congreso Aprobo la Ley")]
    assert [s["source"] for s in got[2]] == ["RPP", "Gestión"] and got[3] == []
    j = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so: {"b": 2} ok',), ("none",)], "t string").select(evidence.salvage_json(F.col("t")).alias("j"))
    assert [r["j"] and json.loads(r["j"]) for r in j.collect()] == [{"a": 1}, {"b": 2}, None]


def test_pages(spark):
    ld = json.dumps([{"@type": ["Thing", "ClaimReview"], "claimReviewed": "Llueve", "reviewRating": {"ratingValue": 1}, "datePublished": "2024-02-03"}])
    page = f'<h1>Es <b>falso</b></h1><script type="application/ld+json">{ld}</script><p>uno <i>dos</i></p><a class="x" href="/a">y</a>'
    d = spark.createDataFrame([(1, "https://h.pe/x", page), (2, "https://h.pe/x", None), (3, "u", '<script type="application/ld+json">{bad</script><strong>S</strong>')], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.fact_checks(d).collect()}
    assert (got[1]["headline"], got[1]["claim"], got[1]["rating"], got[1]["date"]) == ("Es falso", "Llueve", "1", "2024-02-03") and got[2]["claim"] is None and got[3]["strong"] == "S"
    assert [r["text"] for r in html.paragraphs(d).collect()] == ["uno dos"] and [r["url"] for r in html.links(d).collect()] == ["https://h.pe/a"]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Sí, \"cierto\"", "true", None, "u", "s", None), ("2", "no", "false", None, "u", "s", None), ("3", "x", "other", None, "u", "s", None)], files.CLAIMS)
    files.write_jsonl(rows, str(tmp_path / "j"))
    back = files.read_claims_jsonl(spark, str(tmp_path / "j"))
    assert back.count() == 2
    files.write_claims_tsv(back, str(tmp_path / "t"))
    assert sorted(r["claim_text"] for r in files.read_liar_tsv(spark, str(tmp_path / "t")).collect()) == ['Sí, "cierto"', "no"]
    (tmp_path / "urls.txt").write_text("# c\n\nhttps://a\n")
    assert [r["url"] for r in files.read_urls(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a"]
    for name, score in (("a", 0.64), ("b", 0.87)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "c.json").write_text(json.dumps({"model_name": name, "validation_metrics": {"macro_f1": score}}, indent=1))
    assert files.best_checkpoint(spark, str(tmp_path / "[ab]" / "c.json")).first()["model_name"] == "b"


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    seen = []
    stream = jobs.dedupe_stream(jobs.read_stream(spark, str(tmp_path / "in"), schema), ["user_id", "event_type"], "ts", "60 days")
    jobs.run_available(stream, lambda df, _: seen.extend((r["user_id"], r["event_type"]) for r in df.collect()), str(tmp_path / "ck"))
    assert sorted(seen) == sorted({(r["user_id"], r["event_type"]) for r in events.collect()})
    counts = {}
    jobs.run_available(jobs.window_counts(jobs.read_stream(spark, str(tmp_path / "in"), schema), "ts", "1 day"), lambda df, _: counts.update({(r["start"], r["event_type"]): r["n"] for r in df.collect()}), str(tmp_path / "ck2"), "update")
    assert counts == {(r["w"]["start"], r["event_type"]): r["count"] for r in events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().collect()}


def test_model_scorer(spark):
    rows = spark.createDataFrame([(f"bulo falso numero {i}", 0.0) for i in range(20)] + [(f"dato oficial cierto {i}", 1.0) for i in range(10)], "t string, y double")
    got = scoring.ModelScorer.fit(rows, "t", "y", 1 << 10).score(rows, "t")
    assert got.where("(p_true > 0.5) <> (y = 1)").count() == 0
