"""Tables on shared storage: steps that end lineage, and the engine's own tables with their versions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .schemas import TABLES


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "plumbline")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: computed once, its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes work folders that no later step reads, so that they don't stay on the disk until the run's end."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders(table: DataFrame) -> set[str]:
    """Where a table lies that ``keep`` wrote."""
    return {f.rsplit("/", 1)[0] for f in table.inputFiles()}


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so when their handles are collected as garbage."""
    spark.sparkContext._jvm.System.gc()


class Store:
    """Tables below a folder. A write makes a new version; readers see the last one that is whole, so a failed write changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        inside = [s.getPath() for s in fs.listStatus(path)]
        whole = [p.getName() for p in inside if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in whole if n.startswith("v"))

    def read(self, name: str) -> DataFrame:
        """The table, empty where nothing was written. Columns that an older version lacks are null."""
        schema, versions = TABLES[name], self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        schema = TABLES[name]
        path = f"{self.folder}/{name}/v{(self._versions(name) or [0])[-1] + 1}"
        df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], schema).schema)).write.mode("overwrite").parquet(path)
        return self.read(name)
