"""Media payloads in content-defined chunks.

A text's bytes, padded with 255 to whole frames, are the 8-bit samples of a mono WAV file. The file is cut
where a rolling gear hash of the last 32 bytes has zero bits, chunks are stored once for each digest,
and a file is an ordered list of chunk digests. Reading joins lists and chunks, puts each distinct file
together in order, checks its digest and parses it.

Null text is an empty one: one frame of 255. Equal texts have one stored file. Repeated rows and
doc_ids each give their row; an empty table gives none; other columns are ignored."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, bloom_size, cut, flat, grouped, in_bloom, shuffle_partitions, slices

FRAME, RATE = 576, 8000
SMALLEST, MASK_BITS, LARGEST = 1024, 12, 16384
_GEAR = np.random.default_rng(576).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM with the canonical 44-byte header."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or media[36:40] != b"data":
        raise ValueError("not a WAV file of this kind")
    return media[44 : 44 + struct.unpack_from("<I", media, 40)[0]]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, sum of the last 32 bytes' gear values, each shifted left by its distance: by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    return h


def cuts(media: np.ndarray, hashes: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash's top bits are zero, at least SMALLEST and at most LARGEST bytes after the last."""
    n, marks = len(media), np.flatnonzero(hashes >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, at = [], 0
    while n - at > SMALLEST:
        i = int(np.searchsorted(marks, at + SMALLEST))
        end = min(int(marks[i]) if i < len(marks) else n, at + LARGEST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def features(payload: np.ndarray) -> str:
    """Mean and deviation of the samples, zero crossings about the middle, entropy of the histogram and share of silence (255)."""
    counts = np.bincount(payload, minlength=256)
    p = counts[counts > 0] / len(payload)
    signs = payload >= 128
    return f"mean={payload.mean():.4f};std={payload.std():.4f};crossings={int((signs[1:] != signs[:-1]).sum())};entropy={-(p * np.log2(p)).sum():.4f};fill={counts[255] / len(payload):.4f}"


def _media(raw: bytes) -> bytes:
    return to_wav(raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME))


def _chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    view, at = np.frombuffer(media, np.uint8), 0
    for end in cuts(view, gear_hashes(view)):
        yield hashlib.sha256(media[at:end]).digest(), media[at:end]
        at = end


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def shared_digests(docs: DataFrame) -> DataFrame:
    """The first 64 bits (h) of digests that occur twice or more: counted in the task first, so that a frequent chunk is one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["h", "c"])

        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i in range(batch.num_rows):
                for digest, _ in _chunks(_media(data[offsets[i] : offsets[i + 1]].tobytes())):
                    h = _short(digest)
                    counts[h] = counts.get(h, 0) + 1
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, c long")
    return found.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h")


def stored(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, media_sha256 and its ordered chunks (digest, shared, data).

    Data of a chunk that occurs once stays with its file; that of a shared chunk is sent once by each task, for the chunk store."""
    shared = cut(shared_digests(docs), "shared")
    words = docs.sparkSession.sparkContext.broadcast(bloom(shared, "h", bloom_size(shared.count())))  # at most 32 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        seen: set[bytes] = set()
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("shared", pa.bool_()), ("data", pa.binary())]))
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                rows: list[tuple] = []
                for k in range(i, j):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    media = _media(raw)
                    parts = list(_chunks(media))
                    often = in_bloom(words.value, np.array([_short(d) for d, _ in parts], np.int64).view(np.uint64))
                    listed = []
                    for (digest, chunk), both in zip(parts, often.tolist()):
                        listed.append({"digest": digest, "shared": both, "data": None if both and digest in seen else squeeze.compress(chunk)})
                        if both:
                            seen.add(digest)
                    rows.append((len(raw), hashlib.sha256(media).hexdigest(), listed))
                if len(seen) > 500_000:
                    seen.clear()
                n, sha, chunks = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(sha), pa.array(chunks, kind)], ["doc_id", "n_bytes", "media_sha256", "chunks"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(docs.mapInArrow(run, "doc_id long, n_bytes long, media_sha256 string, chunks array<struct<digest: binary, shared: boolean, data: binary>>"), "media")


def chunk_store(files: DataFrame) -> DataFrame:
    """(digest, data) of the shared chunks, each once."""
    sent = files.select(F.explode("chunks").alias("c")).where("c.shared and c.data is not null").select("c.digest", "c.data")
    return cut(sent.dropDuplicates(["digest"]), "chunks")


READ = "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def _examine(sha: str, media: bytes) -> tuple:
    """What is read from a stored file; it must have the digest that it was stored under."""
    if hashlib.sha256(media).hexdigest() != sha:
        raise ValueError(f"the chunks do not make up media {sha}")
    payload = from_wav(media)
    return sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), features(np.frombuffer(payload, np.uint8))


def _batch(rows: list[tuple], extra: list[pa.Array] = (), names: list[str] = ()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*extra, *(pa.array(x, t) for x, t in zip(zip(*rows), _KINDS))], [*names, *(c.split()[0] for c in READ.split(", "))])


def read_media(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id and n_bytes with what is read back: files of their own chunks in place, others by a join of lists and chunk store, each distinct file once."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [_examine(sha, b"".join(opened.decompress(c["data"]) for c in listed)) for sha, listed in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield _batch(rows, [part.column(0), part.column(1)], ["doc_id", "n_bytes"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        for group in grouped(batches, ["media_sha256"]):
            parts = group.column("data").to_pylist()
            if len(parts) != group.column("n")[0].as_py():
                raise ValueError(f"chunks are missing of media {group.column('media_sha256')[0]}")
            rows.append(_examine(group.column("media_sha256")[0].as_py(), b"".join(map(opened.decompress, parts))))
            if len(rows) == 500:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    has = files.withColumn("shared", F.exists("chunks", lambda c: c.shared))
    alone = has.where("not shared").select("doc_id", "n_bytes", "media_sha256", "chunks").mapInArrow(whole, "doc_id long, n_bytes long, " + READ)
    mixed = has.where("shared").withColumn("own", F.exists("chunks", lambda c: ~c.shared))
    first = mixed.where("own").select("media_sha256", "chunks")  # holds a chunk that no other row has, so it is distinct
    listed = mixed.where("not own").select("media_sha256", F.transform("chunks", lambda c: c.digest).alias("d")).dropDuplicates(["media_sha256"])
    own = first.select("media_sha256", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "c")).select("media_sha256", "n", "seq", "c.digest", "c.shared", "c.data")
    need = own.where("shared").select("media_sha256", "n", "seq", "digest").unionByName(listed.select("media_sha256", F.size("d").alias("n"), F.posexplode("d").alias("seq", "digest")))
    parts = own.where("not shared").select("media_sha256", "n", "seq", "data").unionByName(need.join(chunks, "digest").select("media_sha256", "n", "seq", "data"))
    made = parts.repartition(shuffle_partitions(files.sparkSession), "media_sha256").sortWithinPartitions("media_sha256", "seq").mapInArrow(assembled, READ)
    back = mixed.select("doc_id", "n_bytes", "media_sha256").join(made, "media_sha256").select("doc_id", "n_bytes", *(c.split()[0] for c in READ.split(", ")))
    return alone.unionByName(back)
