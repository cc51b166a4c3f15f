"""The engine over a folder of tables, incremental clusters, caches, reports and pages, on rows of our own."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.engine import Engine
from plumbline.operators import analysis, caching, clustering, reports, runs, selection, serving
from plumbline.operators.analysis import AnalysisSettings
from plumbline.schemas import TABLES
from plumbline.sources import dom, sites
from plumbline.streaming import jobs

BODY = "El congreso de la republica aprobo la ley de presupuesto para la region norte y el ministro informo que la obra del hospital costara 20 millones de soles en total este año segun el acta firmada por la comision de economia y por los alcaldes de los distritos de la costa que pidieron mas fondos para las escuelas rurales"
SPORT = "El equipo nacional de futbol gano el partido ante su rival en el estadio con dos goles del delantero en la segunda mitad y la tabla del torneo queda con tres puntos de ventaja para el club que dirige el tecnico argentino desde marzo pasado cuando firmo contrato por dos temporadas con opcion de una tercera si clasifica"
ITEMS = [(1, "https://a.pe/1", "Congreso aprueba ley de presupuesto", BODY), (1, "https://a.pe/2", "Aprueban ley de presupuesto en el congreso", BODY + " hoy"), (1, "https://a.pe/3", "Gana el equipo nacional", SPORT), (1, "https://a.pe/4", " ", BODY), (1, "https://a.pe/1", "Congreso aprueba ley de presupuesto", BODY), (1, "https://a.pe/5", "Nota breve", "muy corta")]


class Even:
    """Half and half."""

    def score(self, rows, text):
        return rows.withColumn("p_false", F.lit(0.9)).withColumn("p_true", F.lit(0.1))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('tables')}", AnalysisSettings(veracity=Even()), F.expr("timestamp '2024-03-01 10:00:00'"))
    e.add_source("Uno", "https://a.pe", "web")
    items = spark.createDataFrame(ITEMS, "source_id long, original_url string, title_raw string, content_raw string").withColumns({"author_raw": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp")})
    e.outcome = e.ingest(items).first().asDict()
    e.counters = e.run_pipeline()
    return e


def test_engine_runs_from_items_to_a_feed(engine):
    assert engine.outcome == {"source_id": 1, "saved": 4, "duplicate": 1, "incomplete": 1}
    assert engine.counters == {"source_id": None, "raw_news_count": 4, "processed_count": 4, "cluster_count": 2, "published_count": 2}
    news = engine.feed().collect()
    assert len(news) == 2 and {r["sourceName"] for r in news} == {"Uno"} and all(r["publishedAt"] == "2024-03-01T10:00:00" for r in news)
    assert {r["status"] for r in engine.store.read("news_raw").collect()} == {"processed", "rejected"}
    assert engine.feed(source_name="Uno").count() == 2 and engine.feed(source_name="Otro").count() == 0 and engine.feed(2, 10).count() == 0
    logs = {(r["stage"], r["status"]) for r in engine.store.read("processing_logs").collect()}
    assert logs == {("preprocessing", "success"), ("preprocessing", "failed"), ("clustering", "success")}
    assert engine.store.read("ingestion_logs").first()["message"] == "4 guardadas, 1 duplicadas, 1 incompletas"


def test_engine_detail_refresh_unpublish(engine):
    rep = engine.store.read("news").join(engine.store.read("cluster_members").groupBy("cluster_id").count().where("count = 2").join(engine.store.read("news_clusters"), "cluster_id"), "representative_id").first()
    d = engine.detail(rep["news_id"]).first()
    assert d["cluster_id"] == rep["cluster_id"] and d["similar"] == [] and d["is_high_risk"] == (d["fake_score"] >= 0.8)
    prediction = engine.store.read("ml_predictions").where(F.col("representative_id") == rep["representative_id"]).first()
    assert d["fake_score"] == prediction["fake_score"] and d["sentiment_label"] == prediction["sentiment_label"]
    before = engine.refresh(rep["news_id"]).first()
    assert (before["news_id"], str(before["published_at"])) == (rep["news_id"], "2024-03-01 10:00:00")
    engine.unpublish(rep["news_id"])
    assert engine.feed().count() == 1
    with pytest.raises(ValueError):
        engine.refresh(999)


def test_engine_reprocess_publishes_again(engine):
    first = engine.store.read("news_raw").where("status = 'processed'").orderBy("news_raw_id").first()["news_raw_id"]
    got = engine.reprocess(first)
    assert got["raw_news_id"] == first and got["published_count"] == got["cluster_count"] == 2
    assert engine.store.read("cluster_members").count() == 3 and engine.feed().count() == 2
    with pytest.raises(ValueError):
        engine.reprocess(10_000)


def test_engine_interactions_and_sources(engine, spark):
    engine.record_reaction(1, 1, 1)
    assert [r["reaction"] for r in engine.record_reaction(1, 1, -1).collect()] == [-1]
    assert engine.remove_reaction(1, 1).count() == 0
    engine.record_view(1, 1, 30)
    assert [r["view_id"] for r in engine.record_view(2, 1, 3).orderBy("view_id").collect()] == [1, 2]
    assert engine.record_click(1, 1).count() == 1
    with pytest.raises(ValueError, match="ya existe"):
        engine.add_source("Uno", "https://b.pe", "web")
    with pytest.raises(ValueError, match="soportado"):
        engine.add_source("Dos", "https://b.pe", "rss")
    assert engine.add_source("Dos", "https://b.pe", "Web").first()["sourceId"] == 2
    assert engine.seed_sources().count() == 6 and engine.seed_sources().count() == 6
    assert engine.status()["fake_news_ready"] and Engine(spark, engine.store.folder, AnalysisSettings(veracity=None)).status()["status"] == "degraded"


def test_engine_evidence_cache(engine, spark):
    engine.cache_evidence(spark.createDataFrame([(1, "a"), (2, "b")], "prediction_id long, report string"))
    hits, misses = engine.cached_evidence(spark.createDataFrame([(1,), (3,)], "prediction_id long"))
    assert [r["report"] for r in hits.collect()] == ["a"] and [r["prediction_id"] for r in misses.collect()] == [3]
    engine.clear_evidence()
    assert engine.store.read("evidence_cache").count() == 0


def test_a_failed_write_leaves_the_last_version(engine, spark):
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("click_id"), F.col("id").alias("user_id"), F.col("id").alias("news_id"), F.lit(None).cast("timestamp").alias("clicked_at"))
    before = engine.store.read("news_clicks").count()
    with pytest.raises(Exception, match="no"):
        engine.store.write("news_clicks", bad)
    assert engine.store.read("news_clicks").count() == before


def test_a_missing_model_publishes_without_predictions(spark):
    raw = spark.createDataFrame([(i, 1, None, "web", "s", f"u{i}", f"t{i}", BODY + f" {i}", None, None, None, "pending") for i in (1, 2)], TABLES["news_raw"])
    empty = {n: spark.createDataFrame([], TABLES[n]) for n in runs.Tables.__dataclass_fields__}
    t = runs.Tables(**{**empty, "news_raw": raw})
    done, _ = runs.run(t, runs.waiting(raw), F.lit("2024-01-01").cast("timestamp"), AnalysisSettings(veracity=None))
    assert done.news.count() == 1 and done.ml_predictions.count() == 0 and done.news.first()["fake_score"] == 0
    with pytest.raises(analysis.ModelNotReady):
        analysis.analyze(spark.createDataFrame([(1, "t", "c")], "doc_id long, title string, content string"), AnalysisSettings(veracity=None))


def test_representative_counts_all_members(spark):
    """Similarities under the threshold count, too: the second of four members is nearest to all."""
    words = [f"palabra{i}" for i in range(40)]
    texts = {0: words[:20], 1: words[5:25], 2: words[10:30], 3: words[2:22]}
    articles = spark.createDataFrame([(i, "", " ".join(w)) for i, w in texts.items()], "id long, title string, text string")
    sets = clustering.contexts(articles)
    members = spark.createDataFrame([(i, 0) for i in texts], "id long, leader long")

    def sim(a, b):
        x, y = set(texts[a]), set(texts[b])
        return round(len(x & y) / len(x | y), 4)

    want = max((round(sum(sim(i, j) for j in texts if j != i) / 3, 4), -i) for i in texts)
    r = clustering.representatives(members, sets).first()
    assert (r["representative"], r["cluster_score"], r["size"]) == (-want[1], pytest.approx(want[0], abs=1e-4), 4)


def test_member_pairs_of_a_large_cluster_are_whole(spark, monkeypatch):
    monkeypatch.setattr(clustering, "CHUNK", 4)
    articles = spark.createDataFrame([(i, "", f"uno dos tres w{i}") for i in range(30)], "id long, title string, text string")
    members = spark.createDataFrame([(i, i // 20) for i in range(30)], "id long, leader long")
    got = [(r["leader"], r["a"], r["b"]) for r in clustering.member_pairs(members, clustering.contexts(articles)).collect()]
    assert sorted(got) == [(i // 20, i, j) for i in range(30) for j in range(i + 1, 30) if i // 20 == j // 20]


def test_streamed_clusters_equal_stored_ones(spark, tmp_path):
    from plumbline.storage import Store

    store = Store(spark, f"file://{tmp_path}/tables")
    rows = spark.createDataFrame([(1, "Congreso aprueba ley", BODY), (2, "Gana el equipo", SPORT), (3, "Aprueban ley en el congreso", BODY + " hoy"), (4, "Ganó el equipo nacional", SPORT + " ayer")], "id long, title string, text string").withColumns({"source_id": F.lit(1).cast("long"), "rank": F.col("id")})
    rows.where("id < 3").coalesce(1).write.parquet(f"{tmp_path}/in")
    articles = lambda d: d.unionByName(rows.join(store.read("cluster_members").select(F.col("news_processed_id").alias("id")), "id", "left_semi"))
    schema = "id long, title string, text string, source_id long, rank long"
    for _ in range(2):
        jobs.run_available(jobs.read_stream(spark, f"{tmp_path}/in", schema), jobs.cluster_sink(store, articles, 0.4), f"{tmp_path}/ck")
        rows.where("id >= 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {r["news_processed_id"]: r["cluster_id"] for r in store.read("cluster_members").collect()}
    assert got == {1: 1, 3: 1, 2: 2, 4: 2}


def test_cache_replay(spark):
    calls = [("s", "k", t) for t in (0, 3500, 5000, 8000)] + [("t", k, t) for t, k in enumerate("abcad")]
    d = spark.createDataFrame(calls, "service string, key string, at long").withColumn("at", F.timestamp_seconds("at"))
    s = caching.stats(caching.replay(d.where("service = 's'"))).first()
    assert (s["hits"], s["misses"], s["hit_rate"]) == (2, 2, "50.00%")
    # two places: a goes when c comes, b when a comes again
    assert [r["hit"] for r in caching.replay(d.where("service = 't'"), size=2).orderBy("at").collect()] == [False] * 5
    assert caching.stats(caching.replay(d.limit(0))).first()["hit_rate"] == "0.00%"


def test_evaluation_report(spark, tmp_path):
    rows = spark.createDataFrame([("test", "True", "True"), ("test", "False", "True"), ("test", "False", "False"), ("validation", "True", "True")], "split string, gold string, pred string")
    r = reports.evaluation(rows, ["False", "True"], {"model_dir": "m"})
    assert r["splits"]["test"]["confusion_matrix"] == [[1, 1], [0, 1]] and r["splits"]["test"]["num_examples"] == 3 and r["splits"]["validation"]["accuracy"] == 1
    reports.write_report(r, str(tmp_path / "r.json"), str(tmp_path / "r.md"))
    assert json.loads((tmp_path / "r.json").read_text()) == r
    text = (tmp_path / "r.md").read_text()
    assert "## Test set" in text and "- False: precision=1.0000 recall=0.5000 f1=0.6667 support=2" in text


def test_export_has_its_columns(spark):
    d = spark.createDataFrame([(1, None, 2, "s", None, None, "u", 0.123456, None)], "representative_id long, news_id long, source_id long, source_name string, published_at timestamp, title_raw string, original_url string, fake_score double, sentiment_label string")
    row = selection.export_rows(d).first()
    assert row.__fields__ == selection.EXPORT and len(selection.EXPORT) == 26 and (row["stored_fake_score"], row["news_id"], row["title"]) == ("0.1235", "", "")


def test_analysis_item_is_nested_and_ranked(spark):
    body = "La ministra niega que el hospital 7 cerro en marzo de 2020. El alcalde asegura que la obra costo 20 millones de soles."
    r = analysis.analyze(spark.createDataFrame([(1, "Nota", body)], "doc_id long, title string, content string"), AnalysisSettings(veracity=Even(), with_summary=True, force_summary=True)).first()
    f = r["fake_news"]
    assert f["claims"]["selected"] == 2 and {c["extraction_mode"] for c in f["claims"]["items"]} == {"reported_claim", "refutation_projected"}
    assert [c["rank"] for c in f["claims"]["items"]] == [1, 2] and f["claims"]["items"][0]["prediction"]["probabilities"] == {"False": 0.9, "True": 0.1}
    assert [x["label"] for x in f["ranking"]] == (["False", "True"] if f["label"] == "False" else ["True", "False"]) and r["summary"] == body[:600]
    assert sum(r["stance"]["probabilities"].values()) == pytest.approx(1, abs=1e-3) and r["models"]["stance_classifier"] == "OverlapStance" and r["warnings"] == []


def test_publish_keeps_ids_and_similar_skips_itself(spark):
    news = spark.createDataFrame([(i, i, 1, f"t{i}", "s", "u", "l", 0.1, 0.9, None) for i in range(8)], TABLES["news"]).withColumn("published_at", F.timestamp_seconds("news_id"))
    members = spark.createDataFrame([(i, 1) for i in range(8)], "news_id long, cluster_id long")
    got = {}
    for r in serving.similar_published(news, members, 5).orderBy("news_id", "rank").collect():
        got.setdefault(r["news_id"], []).append(r["peer"])
    assert got == {i: [j for j in range(7, -1, -1) if j != i][:5] for i in range(8)}


def test_dom_and_pages(spark):
    page = dom.parse('<div id="a" class="x y"><p>uno <b>dos</b><br>tres</p><script>no</script><img src="q"><a href="/l" data-k="v">l</a></div><p>fuera')
    assert [n.text() for n in page.select("div.x p")] == ["uno dostres"] and page.first("#a").text(" ", True) == "uno dos tres l" and page.first('a[data-k="v"]').attrs["href"] == "/l"
    assert [n.tag for n in page.select("p, a[href]")] == ["p", "a", "p"] and page.first("div p.z") is None and page.first('a[href*="/l"]').tag == "a"
    pages = spark.createDataFrame([(1, "perucheck", "https://p.pe/v/x", '<article><strong>Es falso el dato</strong> cosas</article><script type="application/ld+json">[{"headline": "Dato impreciso"}]</script>'), (2, "newtral", "u", None), (3, "nadie", "u", "<p>x</p>")], "page_id long, publisher string, url string, html string")
    got = {r["page_id"]: r for r in sites.fact_check_outcomes(pages).collect()}
    assert (got[1]["claim"], got[1]["rating"], got[1]["label"], got[1]["reason"]) == ("El dato", "Impreciso", "false", None) and got[2]["reason"] == "fetch_error" and got[3]["reason"] == "missing_claim"
    out = sites.fact_check_outcomes(pages)
    assert {r["reason"]: r["n"] for r in reports.skip_reasons(out).collect()}["invalid_rating"] == 0 and [r["label"] for r in reports.claims(out).collect()] == ["false"]
