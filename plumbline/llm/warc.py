"""WARC archives with revisit records.

Header rows alone (page, url, size and digest of the payload) are grouped and joined: records whose payload is large
enough and equal to that of a smaller page become revisits of it. A revisit is written from its header row; payloads
stay with their pages and are not shuffled, but for the few that a filter of fixed size can't tell from a revisit's. Archives
are written by streaming tasks, one gzip member a record, and read back record by record.

Null html is an empty payload; payloads below the least size are always responses. A record's id names its page and
its payload, so rows that repeat a page_id with other payloads are records of their own; rows that repeat a page_id
together with its payload are responses if that page is the original. A null page_id is never an original unless all
its group are null, and refers to nothing then; an empty table writes no archive; other columns are ignored."""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filesystem, passing, work_dir, write_atomically

LEAST, LEVEL = 100, 1
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with payload (binary, null for revisits), size, digest, and original: the smallest page_id of an equal payload of at least `least` bytes, null where the record stands for itself.

    A payload that fills a third of the table is one row a task in the grouping; joins are between tables, so that Spark may split them where a digest is frequent."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("header", F.xxhash64("page_id", "digest"))
    heads = cut(rows.drop("payload"), "headers")
    firsts = cut(heads.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "digests")
    visits = cut(heads.join(firsts, "digest").where(~F.col("first").eqNullSafe(F.col("page_id"))).withColumnRenamed("first", "original"), "revisits")
    maybe, own = passing(rows, visits, "header")  # of the responses, few pass
    mistaken = cut(maybe.drop("payload").join(visits.select("header", F.col("page_id").alias("p"), F.col("digest").alias("d")).distinct(), "header", "left").where("d is null or d <> digest or not p <=> page_id").select("header"), "mistaken")
    kept, _ = passing(maybe, mistaken, "header")
    known = visits.select("header", "digest", F.col("page_id").alias("p")).distinct()
    kept = kept.join(known, (kept.header == known.header) & (kept.digest == known.digest) & kept.page_id.eqNullSafe(known.p), "left_anti")
    names = ["page_id", "url", "payload", "size", "digest", "original"]
    nothing = F.lit(None).cast("long").alias("original")
    revisits = visits.withColumn("payload", F.lit(None).cast("binary")).select(*names)
    return own.select(*names[:-1], nothing).unionByName(kept.select(*names[:-1], nothing)).unionByName(revisits)


def _record(page_id, url, payload: bytes | None, size: int, digest: str, original, date: str) -> bytes:
    kind = "response" if payload is not None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}"]
    if payload is None:
        lines += [f"WARC-Refers-To: {record_id(original, digest)}", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page: {original}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(resolved: DataFrame, out: str | None = None, date: str = "2024-01-01T00:00:00Z", level: int = LEVEL) -> tuple[str, DataFrame]:
    """Writes one archive for each partition that has rows; returns the folder and a table of its file names."""
    out = out or work_dir(resolved.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        held = next((b for b in batches if b.num_rows), None)
        if held is None:
            return

        def fill(f) -> None:
            nonlocal n
            batch = held
            while batch is not None:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "original"))):
                    f.write(gzip.compress(_record(*row, date), level, mtime=0))
                    n += 1
                batch = next(batches, None)

        write_atomically(f"{out}/{name}", fill)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

    return out, cut(resolved.mapInArrow(write, "file string, n long"), "archives")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each."""
    rest, part, unzip = b"", [], zlib.decompressobj(31)
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                return
        part.append(unzip.decompress(rest))
        rest = unzip.unused_data
        if unzip.eof:
            yield b"".join(part)
            part, unzip = [], zlib.decompressobj(31)
        else:
            rest = b""


def read_archives(folder: str, files: DataFrame) -> DataFrame:
    """Records of the archives: page_id, record_id, record_type, payload_digest, refers_to_record, refers_to, payload (null for revisits), and payload_bytes and read_digest of a stored payload."""
    import hashlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        names = ["page_id", "record_id", "record_type", "payload_digest", "refers_to_record", "refers_to", "payload", "payload_bytes", "read_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                size = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        head, _, body = record.partition(b"\r\n\r\n")
                        h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        body = body[: int(h["Content-Length"])]
                        payload = body.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                        page, to = h.get("X-Page-Id"), h.get("X-Refers-To-Page")
                        rows.append((page and int(page), h["WARC-Record-ID"], h["WARC-Type"], h["WARC-Payload-Digest"].split(":")[1], h.get("WARC-Refers-To"), to and int(to), payload, None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest()))
                        size += len(record)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    spread = files.select("file").repartition(max(1, files.count()), "file")
    return spread.mapInArrow(read, "page_id long, record_id string, record_type string, payload_digest string, refers_to_record string, refers_to long, payload binary, payload_bytes long, read_digest string")


def full_records(records: DataFrame) -> DataFrame:
    """Every record with the size and digest of its full payload: revisits take them from the response that they refer to."""
    heads = cut(records.drop("payload"), "records")
    visits = heads.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "refers_to_record")
    originals = heads.where("record_type = 'response' and payload_bytes >= 0").select(F.col("record_id").alias("refers_to_record"), "payload_bytes", F.col("read_digest").alias("payload_digest")).dropDuplicates(["refers_to_record"])
    originals = cut(originals, "originals")
    named = visits.join(originals, "refers_to_record").drop("refers_to_record")
    own = heads.where("record_type = 'response'").select("page_id", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", F.col("read_digest").alias("payload_digest"))
    return own.unionByName(named).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
