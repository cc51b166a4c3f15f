"""Structured Streaming: incremental ingest and interaction windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder; a path that is a file stands for the files of its name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def dedupe_stream(events: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """First event of each key while its time is within the watermark; state is bounded by the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, time: str, width: str = "1 hour", by: str = "event_type", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def session_counts(events: DataFrame, time: str, gap: str = "30 minutes", by: str = "user_id", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events with less than the gap between them. In append mode a session is out when the watermark has passed it."""
    d = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("session_window.start").alias("start"), by, "n")


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch under its number: one that comes again replaces itself."""

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return sink


def cluster_sink(store, articles_of: Callable[[DataFrame], DataFrame], tau: float) -> Callable[[DataFrame, int], None]:
    """Incremental clusters: each micro-batch of processed news joins the stored clusters or opens new ones, and tables get a new version. A batch that comes again finds its articles as members."""
    from ..operators import clustering

    def sink(rows: DataFrame, batch: int) -> None:
        articles = articles_of(rows)
        # every stored member is an article, too: its cluster may get another representative
        members, clusters = store.read("cluster_members"), store.read("news_clusters")
        every, made = clustering.incremental(articles, members, clusters, tau)
        since = clusters.select("cluster_id", "created_at")
        store.write("news_clusters", made.join(since, "cluster_id", "left").withColumn("created_at", F.coalesce("created_at", F.current_timestamp())))
        store.write("cluster_members", every)

    return sink


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and ends: the daily run. The sink gets each micro-batch, once for each id if it is idempotent."""
    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
