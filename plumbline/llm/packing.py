"""Packing documents into fixed-length token sequences as a cutting-stock problem.

Texts are encoded and cut into full pieces of ``length`` tokens and one rest. Rests are counted by
length class; column generation solves the linear program over patterns (which classes share a
sequence), a knapsack by dynamic programming prices new patterns, solutions are rounded down and what
is left goes by best fit. Ranked pieces then take the slots of their class. The program's size depends
on the number of classes alone, and everything over documents is distributed.

A null or empty text is its end id alone; an empty table gives no rows; repeated rows are packed each
(a number tells them apart); other columns are ignored."""

from __future__ import annotations

import uuid
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, filesystem, texts_of, work_dir
from .tokens import encoder

LENGTH, GRAIN = 2048, 16
#: Column generation ends when no pattern prices above 1 by this.
GAP = 1e-4
#: Ranks are counted in so many hash buckets for each class, each of which one task sorts.
DOCS_PER_BUCKET = 4_000


def _simplex(demand: np.ndarray, capacity: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (rows) and how often each is used, covering demand of class sizes 1..capacity with the fewest bins."""
    sizes = np.flatnonzero(demand) + 1
    need = demand[sizes - 1].astype(float)
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)  # basis columns
    basis = np.linalg.inv(columns) if m else np.zeros((0, 0))
    x = basis @ need
    for step in range(rounds):
        if step % 50 == 49:
            basis = np.linalg.inv(columns)
            x = basis @ need
        price = basis.sum(axis=0)
        pattern = _knapsack(price, sizes, capacity)
        if price @ pattern <= 1 + GAP:  # then the program is within that share of its least value
            break
        d = basis @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, np.maximum(x, 0) / d, np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        columns[:, r] = pattern
        x = x - ratio[r] * d
        x[r] = ratio[r]
        row = basis[r] / d[r]
        basis = basis - np.outer(d, row)
        basis[r] = row
    else:
        warnings.warn(f"column generation stopped after {rounds} patterns: sequences may be padded more", stacklevel=2)
    full = np.zeros((m, capacity), np.int64)
    full[:, sizes - 1] = columns.T.round().astype(np.int64)
    return full, np.maximum(x, 0)


def _knapsack(price: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Pattern of greatest total price: unbounded knapsack over capacity units."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = sizes <= c
        value = np.where(fits, best[c - np.minimum(sizes, c)] + price, -np.inf)
        k = int(np.argmax(value))
        if value[k] > best[c - 1] + 1e-12:
            best[c], take[c] = value[k], k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= sizes[take[c]]
    return pattern


def plan(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (class counts) and number of sequences of each that hold exactly counts[c] pieces of class c + 1."""
    counts = counts.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if not counts.any():
        return out
    for pattern, often in zip(*_simplex(counts, capacity)):
        n = int(often + 1e-6)
        used = pattern > 0
        if used.any():
            n = min(n, int((counts[used] // pattern[used]).min()))
        if n and used.any():
            out.append((pattern, n))
            counts -= pattern * n
    while counts.any():  # what rounding left: greedy patterns, each as often as it can be
        pattern, room, left = np.zeros_like(counts), capacity, counts.copy()
        while room and left[:room].any():
            c = int(np.flatnonzero(left[:room])[-1])
            k = min(int(left[c]), room // (c + 1))
            pattern[c] += k
            left[c] -= k
            room -= k * (c + 1)
        used = pattern > 0
        n = int((counts[used] // pattern[used]).min())
        out.append((pattern, n))
        counts -= pattern * n
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, folder: str, length: int = LENGTH) -> DataFrame:
    """Writes the ids of all documents to files in a folder, one a task, and gives the pieces: doc_id, copy (a hash that tells texts of one doc_id apart), start, length, doc_tokens, and
    the file and byte at which the piece's ids lie (little-endian, of 16 bits where the tokenizer's ids fit them). A file's name is its task attempt's own, so rows and file always agree."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        name, at = f"ids-{uuid.uuid4().hex}.bin", 0
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    rows: list[tuple] = []
                    for doc, copy, raw in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), enc.encode(texts_of(part.column(1)))):
                        out.write(raw)
                        out.write(end)
                        n = len(raw) // width + 1
                        rows += [(doc, copy, start, min(length, n - start), n, at + start * width) for start in range(0, n, length)]
                        at += n * width
                    columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(rows))], ["doc_id", "copy", "start", "length", "doc_tokens", "at", "file"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("copy"))
    return docs.mapInArrow(cut_up, "doc_id long, copy long, start long, length long, doc_tokens long, at long, file string")


def place(made: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """(piece, sequence_id, offset) of pieces (piece, doc_id, copy, start, length). Narrow rows alone: ids take no part in the plan."""
    units = length // grain
    made = made.select("piece", "doc_id", "copy", "start", "length", F.ceil(F.col("length") / grain).cast("int").alias("class"))
    buckets = max(1, -(-made.count() // DOCS_PER_BUCKET))
    keyed = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy", "start"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("c"))
    histogram = np.zeros(units, np.int64)
    for r in counts.groupBy("class").agg(F.sum("c").alias("c")).collect():  # at most `units` rows
        histogram[r["class"] - 1] = r["c"]
    slots, sequence = [[] for _ in range(units)], 0
    filled = np.zeros(units, np.int64)
    for pattern, n in plan(histogram, units):
        for c in np.flatnonzero(pattern):
            slots[c].append((int(filled[c]), int(pattern[c]), sequence))
            filled[c] += pattern[c] * n
        sequence += n
    tables = [tuple(np.array(x, np.int64) for x in zip(*s)) if s else None for s in slots]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            seq = np.empty(len(rank), np.int64)
            for c in np.unique(kind):
                first, per, base = tables[c - 1]
                own = kind == c
                p = np.searchsorted(first, rank[own], side="right") - 1
                seq[own] = base[p] + (rank[own] - first[p]) // per[p]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("length"), batch.column("rank"), pa.array(seq)], ["piece", "length", "rank", "sequence_id"])

    before = counts.withColumn("before", F.sum("c").over(W.partitionBy("class").orderBy("bucket")) - F.col("c")).drop("c")
    ranked = keyed.withColumn("r", F.row_number().over(W.partitionBy("class", "bucket").orderBy("doc_id", "copy", "start", "piece")) - 1)
    ranked = ranked.join(before, ["class", "bucket"]).select("piece", "length", "class", (F.col("r") + F.col("before")).alias("rank"))
    seqs = ranked.mapInArrow(assign, "piece long, length long, rank long, sequence_id long")
    w = W.partitionBy("sequence_id").orderBy(F.desc("length"), "rank", "piece").rowsBetween(W.unboundedPreceding, -1)
    return seqs.select("piece", "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))


@dataclass(frozen=True)
class Packed:
    """A packed corpus: the folder of its id files, bytes of an id, and the table of pieces (doc_id, copy, start, length, doc_tokens, at, file, sequence_id, offset), the index of the files."""

    folder: str
    width: int
    index: DataFrame


def write_packed(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, grain: int = GRAIN, folder: str | None = None) -> Packed:
    """Packs docs. Ids are written once and stay where they are; a sequence is its pieces in the index, in order of offset."""
    folder = folder or work_dir(docs.sparkSession, "ids")
    # the number of a piece stays as it was written
    made = cut(pieces(docs, tokenizer, end_id, folder, length).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    return Packed(folder, encoder(tokenizer).dtype.itemsize, cut(made.join(place(made, length, grain), "piece").drop("piece"), "index"))


def read_pieces(packed: Packed) -> DataFrame:
    """Every piece of a packed corpus with its ids, read from the files one after the other, and ids_crc32 (of the ids as 32 bits)."""
    folder, width = packed.folder, packed.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, stream = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = []
                for file, at, n in zip(*(part.column(c).to_pylist() for c in ("file", "at", "length"))):
                    if file != name:
                        if stream is not None:
                            stream.close()
                        name, stream = file, fs.open_input_stream(f"{root}/{file}", buffer_size=1 << 20)
                        place = 0
                    if at > place:
                        stream.read(at - place)
                    ids.append(stream.read(n * width))
                    place = at + n * width
                crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(ids, pa.binary()), pa.array(crc, pa.int64())], [*names, "ids", "ids_crc32"])
        if stream is not None:
            stream.close()

    names = ["doc_id", "copy", "start", "length", "doc_tokens", "sequence_id", "offset"]
    rows = packed.index.repartition("file").sortWithinPartitions("file", "at").select(*names, "file", "at")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", ids binary, ids_crc32 long")


def read_sequences(packed: Packed, length: int = LENGTH, pad_id: int | None = None) -> DataFrame:
    """(sequence_id, ids) of every sequence, from its ranges of the files; padded to the length if a pad id is given. A sequence has at most `length` pieces."""
    folder, width = packed.folder, packed.width
    fill = b"" if pad_id is None else int(pad_id).to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        held: dict = {}
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                ids = []
                for p in parts:
                    if p["file"] not in held:
                        if len(held) >= 64:
                            held.pop(next(iter(held))).close()
                        held[p["file"]] = fs.open_input_file(f"{root}/{p['file']}")
                    ids.append(held[p["file"]].read_at(p["length"] * width, p["at"]))
                raw = b"".join(ids)
                out.append(raw + fill * (length - len(raw) // width))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(out, pa.binary())], ["sequence_id", "ids"])

    rows = packed.index.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "file", "at", "length"))).alias("parts"))
    return rows.select("sequence_id", "parts").mapInArrow(run, "sequence_id long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """The pieces of the packed corpus with their ids and places, read back from its files."""
    return read_pieces(write_packed(docs, tokenizer, end_id, length, grain))
