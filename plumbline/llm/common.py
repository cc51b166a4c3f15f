"""Shared plumbing: work folders on shared storage, files, Arrow batches and grouped streams."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch: texts may be long, and bounded batches bound what a Python worker and its executor hold.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only local sessions without that setting get a temporary one."""
    bound_batches(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/plumbline"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``cut`` wrote and that no later step reads, so that it doesn't stay on the disk until the run's end."""
    spark = table.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """For the start of a task: its Python worker gives back what tasks of other steps left, which are a tokenizer with its cache and freed memory that allocators keep."""
    if tokens := sys.modules.get(f"{__package__}.tokens"):
        tokens.encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so when their handles are collected as garbage."""
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a uri (file, hdfs, s3, gs), and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def write_atomically(uri: str, fill: Callable) -> None:
    """fill(stream) writes a file that appears under its name only when whole; a repeated task replaces it by an equal one."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        fill(out)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return column.fill_null("").to_pylist()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in one array, and len + 1 offsets into it, without copying; null counts as empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by them. A group is held whole, so callers bound its size."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        start = 0
        for i, key in enumerate(rows):
            if last is not None and key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start = [], i
            last = key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")



def bloom(hashes: DataFrame, column: str, log2_words: int) -> np.ndarray:
    """A blocked Bloom filter with 2**log2_words 64-bit words over a long column.

    Its size is fixed by log2_words (at most 2**22 words: 32 MB), whatever the input; a fuller
    filter lets more candidates through, and exact steps follow, so results stay the same."""
    h = F.col(column)
    mask = F.lit(0).cast("long")
    for s in (0, 6, 12, 18):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {s}) & 63 as int))"))
    # bits above the mask's choose the word: the highest are alike where callers keep the least hashes
    words = hashes.select(F.shiftrightunsigned(h, 24).bitwiseAND(F.lit((1 << log2_words) - 1)).alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(1 << log2_words, np.uint64)
    got = words.toArrow()
    out[got["w"].to_numpy().astype(np.int64)] = got["m"].to_numpy().view(np.uint64)
    return out


def in_bloom(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    mask = np.zeros(len(hashes), np.uint64)
    for s in (0, 6, 12, 18):
        mask |= one << ((hashes >> np.uint64(s)) & low)
    return (words[((hashes >> np.uint64(24)) & np.uint64(len(words) - 1)).astype(np.int64)] & mask) == mask


def passing(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """rows whose column may be among keys' (a superset, by a filter of bounded size), and the others: neither is shuffled."""
    words = rows.sparkSession.sparkContext.broadcast(bloom(keys.select(F.xxhash64(column).alias("h")), "h", bloom_size(keys.count())))
    names = rows.columns
    hashed = rows.withColumn("_h", F.xxhash64(column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def keep(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                on = in_bloom(words.value, batch.column("_h").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(on == want)).select(names)

        return run

    return hashed.mapInArrow(keep(True), schema), hashed.mapInArrow(keep(False), schema)


def bloom_size(n: int) -> int:
    """log2 of the words for about 16 bits a key, between 2**6 and 2**22 words."""
    return min(22, max(6, int(np.ceil(np.log2(max(1, n) / 4)))))
