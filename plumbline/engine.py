"""The engine over a folder of tables: what an API or a scheduler calls. Each call reads the last version of the tables and writes new ones."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sql
from .operators import analysis, caching, evidence, preprocess, runs, serving
from .operators.analysis import AnalysisSettings
from .storage import Store

VERSION = "1.0"


class Engine:
    def __init__(self, spark: SparkSession, folder: str, settings: AnalysisSettings = AnalysisSettings(), now: Column | None = None):
        self.spark, self.settings = spark, settings
        self.store = Store(spark, folder)
        self.now = now if now is not None else F.current_timestamp()
        sql.register(spark)

    # --- status and sources --------------------------------------------------------------------
    def status(self) -> dict:
        ready = self.settings.veracity is not None
        return {"status": "ok" if ready else "degraded", "version": VERSION, "fake_news_ready": ready, "stance_ready": self.settings.stance is not None, "claims_enabled": self.settings.use_claims}

    def seed_sources(self) -> DataFrame:
        known = self.store.read("sources")
        default = preprocess.seed_sources(known.select("name", "base_url", "type", "is_active")).join(known.select("name"), "name", "left_anti")
        return self.store.write("sources", serving.add_sources(known.drop("created_at"), default.select("name", "base_url", "type")).withColumn("created_at", self.now).join(known.select("source_id", F.col("created_at").alias("_at")), "source_id", "left").withColumn("created_at", F.coalesce("_at", "created_at")))

    def add_source(self, name: str, base_url: str, kind: str) -> DataFrame:
        known = self.store.read("sources")
        new = self.spark.createDataFrame([(name, base_url, kind)], "name string, base_url string, type string")
        outcome = serving.source_outcomes(known, new).first()["outcome"]
        if outcome == "unsupported":
            raise ValueError("Tipo de fuente no soportado.")
        if outcome == "exists":
            raise ValueError("La fuente ya existe.")
        made = serving.add_sources(known.drop("created_at"), new).join(known.select("source_id", F.col("created_at").alias("_at")), "source_id", "left")
        written = self.store.write("sources", made.withColumn("created_at", F.coalesce("_at", self.now)))
        return serving.show_source(written.where(F.col("name") == name))

    # --- runs ------------------------------------------------------------------------------------
    def _tables(self) -> runs.Tables:
        return runs.Tables(**{f.name: self.store.read(f.name) for f in fields(runs.Tables)})

    def _write(self, t: runs.Tables) -> runs.Tables:
        return runs.Tables(**{f.name: self.store.write(f.name, getattr(t, f.name)) for f in fields(runs.Tables)})

    def ingest(self, items: DataFrame) -> DataFrame:
        """Saves new raw news of items; returns outcomes by source, each with its log."""
        known = self.store.read("news_raw")
        rows, outcomes = runs.ingested(self.store.read("sources"), items, known, self.now)
        counts = outcomes.groupBy("source_id").pivot("outcome", ["saved", "duplicate", "incomplete"]).agg(F.first("n")).na.fill(0)
        logs = self.store.read("ingestion_logs")
        message = F.format_string("%d guardadas, %d duplicadas, %d incompletas", "saved", "duplicate", "incomplete")
        new = counts.select(F.lit("web").alias("ingestion_type"), F.lit("success").alias("status"), message.alias("message"), self.now.alias("created_at"), "source_id")
        self.store.write("ingestion_logs", serving.record_events(logs, new, "log_id"))
        self.store.write("news_raw", known.unionByName(rows))
        return counts

    def run_pipeline(self, source_id: int | None = None) -> dict:
        """Runs over raw news that wait, of one source or all; returns the counters."""
        t = self._tables()
        done, counters = runs.run(t, runs.waiting(t.news_raw, source_id), self.now, self.settings, source_id)
        counts = counters.first().asDict()
        self._write(done)
        return {"source_id": source_id, **counts}

    def reprocess(self, raw_id: int) -> dict:
        done, counters = runs.reprocess(self._tables(), raw_id, self.now, self.settings)
        counts = counters.first().asDict()
        self._write(done)
        return counts

    # --- news ------------------------------------------------------------------------------------
    def refresh(self, news_id: int) -> DataFrame:
        t = self._tables()
        one = t.news.where(F.col("news_id") == news_id).select("representative_id")
        if one.isEmpty():
            raise ValueError(f"no news {news_id}")
        made = serving.snapshots(one, t.news_processed, t.news_raw, t.summaries, t.ml_predictions)
        return serving.by_id(self.store.write("news", serving.refresh(t.news, made)), "news_id", news_id)

    def unpublish(self, news_id: int) -> None:
        news = self.store.read("news")
        self.store.write("news", serving.unpublish(news, self.spark.createDataFrame([(news_id,)], "news_id long")))

    def feed(self, page: int = 1, size: int = 10, source_id: int | None = None, source_name: str | None = None) -> DataFrame:
        sources = self.store.read("sources")
        return serving.show_news(serving.feed(self.store.read("news"), page, size, source_id, sources, source_name), sources).orderBy(F.desc("publishedAt"), "newsId")

    def detail(self, news_id: int) -> DataFrame:
        t = self._tables()
        members = t.cluster_members.select("news_processed_id", "cluster_id")
        return serving.by_id(serving.details(t.news, members, t.news_clusters), "news_id", news_id)

    # --- interactions ------------------------------------------------------------------------------
    def record_reaction(self, user_id: int, news_id: int, reaction: int) -> DataFrame:
        known = self.store.read("news_reactions")
        new = self.spark.range(1).select(F.lit(user_id).cast("long").alias("user_id"), F.lit(news_id).cast("long").alias("news_id"), F.lit(reaction).alias("reaction"), self.now.alias("created_at"))
        return self.store.write("news_reactions", serving.record_reactions(known, new))

    def remove_reaction(self, user_id: int, news_id: int) -> DataFrame:
        return self.record_reaction(user_id, news_id, 0)

    def record_view(self, user_id: int, news_id: int, seconds: int) -> DataFrame:
        new = self.spark.range(1).select(F.lit(user_id).cast("long").alias("user_id"), F.lit(news_id).cast("long").alias("news_id"), self.now.alias("viewed_at"), F.lit(seconds).alias("time_spent_sec"))
        return self.store.write("news_views", serving.record_events(self.store.read("news_views"), new, "view_id"))

    def record_click(self, user_id: int, news_id: int) -> DataFrame:
        new = self.spark.range(1).select(F.lit(user_id).cast("long").alias("user_id"), F.lit(news_id).cast("long").alias("news_id"), self.now.alias("clicked_at"))
        return self.store.write("news_clicks", serving.record_events(self.store.read("news_clicks"), new, "click_id"))

    # --- analysis and evidence ---------------------------------------------------------------------
    def analyze(self, rows: DataFrame) -> DataFrame:
        return analysis.analyze(rows, self.settings)

    def predict(self, rows: DataFrame) -> DataFrame:
        """The whole text's veracity alone."""
        if self.settings.veracity is None:
            raise analysis.ModelNotReady("El clasificador de fake news no esta listo.")
        return analysis.whole_article(analysis.texts(rows), self.settings)

    def normalize_evidence(self, reports: DataFrame) -> DataFrame:
        return evidence.normalise_sources(reports)

    def cached_evidence(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Reports of wanted (prediction_id) that are young enough, and the ids that must be made."""
        return caching.lookup(self.store.read("evidence_cache"), wanted, self.now)

    def cache_evidence(self, reports: DataFrame) -> DataFrame:
        return self.store.write("evidence_cache", caching.put(self.store.read("evidence_cache"), reports, self.now))

    def clear_evidence(self) -> None:
        self.store.write("evidence_cache", self.store.read("evidence_cache").limit(0))
