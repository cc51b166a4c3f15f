"""Token shards: raw id payloads in files, and a minimal perfect hash index from document keys to them.

Layout below one folder: ``shard-NNNNNN.bin`` holds little-endian ids, documents in ascending doc_id
order; ``index-NNNNNN.mph`` holds one minimal perfect hash over the keys that fall in its bucket, with
a 32-bit fingerprint, shard, offset and length for each slot; ``manifest.json`` lists the shards' sizes.

A key is (doc_id, occurrence). Repeated doc_ids are numbered by text, nulls are a key of their own and
come first; null and empty texts give the end id alone; an empty table gives no shard."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, filesystem, grouped, read_file, shuffle_partitions, texts_of, work_dir, write_atomically
from .tokens import encoder
from .words import mix

U = np.uint64
GAMMA, LEVELS, KEYS_PER_INDEX = 2.0, 40, 1 << 20
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays; a key takes the first level where it met no other, and its slot is that bit's rank."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.bases = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        counts = np.concatenate(([0], np.cumsum(np.bitwise_count(bits).astype(np.int64))))
        self.ranks = counts

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = -(-max(64, int(GAMMA * len(keys))) // 64) * 64
            at = cls.places(keys, level, size)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(once, bitorder="little").view("<u8"))
            keys = keys[~once[at]]
        if len(keys):
            raise ValueError("keys of a perfect hash must be distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level takes it."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            bit = self.places(keys[left], level, int(size)) + self.bases[level]
            word, low = bit >> 6, (bit & 63).astype(U)
            hit = (self.bits[word] >> low) & U(1) == 1
            w, b = word[hit], low[hit]
            out[left[hit]] = self.ranks[w] + np.bitwise_count(self.bits[w] & ((U(1) << b) - U(1)))
            left = left[~hit]
        return out


def _key(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """64-bit key of doc_id and occurrence; a bijection on doc_id for the first occurrence, so keys only meet by the odds of the mix."""
    doc = batch.column("doc_id")
    ids = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U) if isinstance(doc, pa.Array) else doc.combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    null = doc.is_null().to_numpy(zero_copy_only=False) if isinstance(doc, pa.Array) else doc.combine_chunks().is_null().to_numpy(zero_copy_only=False)
    occ = batch.column("occ").to_numpy(zero_copy_only=False).astype(U) if isinstance(doc, pa.Array) else batch.column("occ").to_numpy().astype(U)
    return mix(ids ^ mix(occ + U(2) * null.astype(U) * U(0x5851F42D4C957F2D))) if occ.any() or null.any() else mix(ids ^ mix(np.zeros(1, U)))


def _spark_bucket(buckets: int):
    """Index file of a key."""
    return F.pmod(F.xxhash64("doc_id", "occ"), F.lit(buckets)).cast("int")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None, shard_bytes: int = 64 << 20) -> str:
    """Encodes ``docs`` (doc_id, text) into a folder of shards with index and manifest, and returns the folder.

    One range shuffle of the texts by doc_id; each task sorts its range, encodes in batches and streams
    one shard file, so its memory is a batch. File names depend on the range alone and files appear
    whole, so a lost executor's task is repeated safely."""
    spark = docs.sparkSession
    out = out or work_dir(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 4).alias("b"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-(size["b"] or 0) // shard_bytes), min(shuffle_partitions(spark), size["n"]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        rows: list[tuple] = []

        def fill(stream) -> None:
            at, last, occ = 0, object(), 0
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for i in range(0, len(ids), 256):
                    for doc, payload in zip(ids[i : i + 256], enc.encode(texts_of(texts.slice(i, 256)))):
                        occ = occ + 1 if doc == last else 0
                        last = doc
                        stream.write(payload)
                        stream.write(end)
                        n = len(payload) // enc.dtype.itemsize + 1
                        rows.append((shard, doc, occ, at, n))
                        at += n

        write_atomically(f"{out}/shard-{shard:06d}.bin", fill)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["shard", "doc_id", "occ", "at", "n"])

    entries = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    entries = cut(entries.mapInArrow(write, "shard int, doc_id long, occ int, at long, n int"), "entries")
    buckets = max(1, -(-size["n"] // KEYS_PER_INDEX))
    _write_index(entries, out, buckets)
    totals = {r["shard"]: r["t"] for r in entries.groupBy("shard").agg(F.sum("n").alias("t")).collect()}  # one row a shard
    base, listed = 0, []
    for s in sorted(totals):
        listed.append([s, base])
        base += totals[s]
    text = json.dumps({"dtype": encoder(tokenizer).dtype.str, "end_id": end_id, "buckets": buckets, "tokens": base, "bases": listed})
    write_atomically(f"{out}/manifest.json", lambda f: f.write(text.encode()))
    return out


def _write_index(entries: DataFrame, out: str, buckets: int) -> None:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket"]):
            keys = _key(group)
            perfect = PerfectHash.build(keys)
            slot = np.zeros(len(keys), SLOT)
            at = perfect.slots(keys)
            slot["print"][at] = (keys >> U(32)).astype(np.uint32)
            for name, column in (("shard", "shard"), ("offset", "at"), ("n", "n")):
                slot[name][at] = group.column(column).to_numpy()
            bucket = group.column("bucket")[0].as_py()

            def fill(f) -> None:
                f.write(struct.pack("<QQ", len(perfect.sizes), len(perfect.bits)))
                for part in (perfect.sizes.astype("<i8"), perfect.bits.astype("<u8"), slot):
                    f.write(part.tobytes())

            write_atomically(f"{out}/index-{bucket:06d}.mph", fill)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], ["bucket"])

    placed = entries.withColumn("bucket", _spark_bucket(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    placed.mapInArrow(build, "bucket int").agg(F.count(F.lit(1))).collect()


@lru_cache(4)
def _index(path: str) -> tuple[PerfectHash, np.ndarray]:
    raw = read_file(path)
    levels, words = struct.unpack_from("<QQ", raw)
    sizes = np.frombuffer(raw, "<i8", levels, 16)
    bits = np.frombuffer(raw, "<u8", words, 16 + 8 * levels)
    return PerfectHash(sizes, bits), np.frombuffer(raw, SLOT, -1, 16 + 8 * levels + 8 * words)


def manifest(folder: str) -> dict:
    return json.loads(read_file(f"{folder}/manifest.json"))


def locate(folder: str, keys: DataFrame) -> DataFrame:
    """For keys (doc_id, occ): shard, offset in ids (at) and n by one index probe each; keys whose fingerprint differs are left out."""
    buckets = manifest(folder)["buckets"]
    spark = keys.sparkSession
    per = max(1, shuffle_partitions(spark) // buckets)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in batches:
            bucket = group.column("bucket").to_numpy()
            for b in np.unique(bucket):
                rows = group.filter(pa.array(bucket == b))
                perfect, slot = _index(f"{folder}/index-{b:06d}.mph")
                k = _key(rows)
                at = perfect.slots(k)
                found = np.where(at < 0, 0, at)
                right = (at >= 0) & (slot["print"][found] == (k >> U(32)).astype(np.uint32))
                s = slot[found][right]
                kept = rows.filter(pa.array(right))
                yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("occ"), pa.array(s["shard"].astype(np.int32)), pa.array(s["offset"].astype(np.int64)), pa.array(s["n"].astype(np.int32))], ["doc_id", "occ", "shard", "at", "n"])

    keys = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("occ").cast("int").alias("occ")).withColumn("bucket", _spark_bucket(buckets))
    if buckets > 1:  # each task then reads few index files
        keys = keys.repartition(buckets * per, "bucket", F.pmod(F.xxhash64("occ", "doc_id"), F.lit(per)))
    return keys.mapInArrow(probe, "doc_id long, occ int, shard int, at long, n int")


def read_payloads(folder: str, keys: DataFrame, derive: Callable[[memoryview, np.dtype], object] | None = None, kind: str = "binary") -> DataFrame:
    """Payload of each key, or derive(bytes, dtype) of it as ``value``: located by the index, then read shard by shard in file order.

    ``start`` counts the ids of all documents before it."""
    read_type = {"binary": pa.binary(), "long": pa.int64()}[kind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = manifest(folder)
        bases, dtype = dict(about["bases"]), np.dtype(about["dtype"])
        fs, root = filesystem(folder)
        name, stream = None, None
        for batch in batches:
            shards, ats, ns = (batch.column(c).to_pylist() for c in ("shard", "at", "n"))
            values = []
            for shard, at, n in zip(shards, ats, ns):
                if shard != name:
                    name, stream = shard, fs.open_input_file(f"{root}/shard-{shard:06d}.bin")
                stream.seek(at * dtype.itemsize)
                raw = stream.read(n * dtype.itemsize)
                values.append(derive(raw, dtype) if derive else raw)
            start = pa.array([bases[s] + a for s, a in zip(shards, ats)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("occ"), start, batch.column("n"), pa.array(values, read_type)], ["doc_id", "occ", "start", "n", "value"])

    at = locate(folder, keys).repartition("shard").sortWithinPartitions("shard", "at")
    return at.mapInArrow(read, f"doc_id long, occ int, start long, n int, value {kind}")


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, occ) of every row of a table."""
    many = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    return many.select("doc_id", F.explode(F.expr("sequence(0, cast(c as int) - 1)")).alias("occ"))


def open_shards(spark: SparkSession, folder: str) -> dict:
    """What the manifest says of a folder."""
    return manifest(folder)
