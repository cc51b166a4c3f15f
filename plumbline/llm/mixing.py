"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents lie in hash order on a line of words, cut into blocks of equal size. Slot n of
the mix goes to the source at which the golden-ratio point n falls on the cumulative targets; the k-th
slot of a source takes its block k modulo the number of its blocks, so a source is repeated as a whole
before any block comes again. Skew: a source's line is cut into hash buckets that are sorted apart, and
blocks are of equal size, so a source with a third of all rows is spread like any other.

Null and empty texts have size 0 and are in no block; a null source is a source of its own, last in
order; repeated rows count each; an empty table gives an empty mix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, passing

BLOCK, WEIGHTS, REPEAT = 2048, (1, 2, 3), 3
GOLDEN = 11400714819323198485  # 2**64 divided by the golden ratio
DOCS_PER_BUCKET, SLOTS_PER_CHUNK, MAX_SOURCES = 400, 1 << 12, 1_000_000


def n_words(text: Column) -> Column:
    """Words of a text, without listing them: starts of runs of other characters than space and 9 to 13."""
    plain = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(plain, F.lit(" [^ ]")).cast("long")


def targets(sizes: list[int], weights: list[float], repeat: float = REPEAT) -> list[float]:
    """Shares of the total by weight, none above repeat times its size; excess is shared again by weight."""
    total, left, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    room = total
    while left:
        unit = room / sum(weights[i] for i in left)
        full = {i for i in left if unit * weights[i] > repeat * sizes[i]}
        if not full:
            for i in left:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(repeat * sizes[i])
            room -= out[i]
        left -= full
    return out


def source_table(docs: DataFrame) -> list[tuple]:
    """(source, words, target) in code point order, null last. One row a source: at most MAX_SOURCES."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(((r["source"], r["s"]) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    got = targets([s for _, s in rows], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    return [(a, s, t) for (a, s), t in zip(rows, got)]


def schedule(listed: DataFrame, quota: np.ndarray, block: int) -> DataFrame:
    """(slot, sid, rank): the source of each slot, and its rank among that source's slots.

    Slots are golden-ratio points over cumulative quotas; ranks are counted in chunks of slots. The points
    give a source its share but for a few slots; those that it lacks for its whole quota follow at the end."""
    spark = listed.sparkSession
    total = int(quota.sum())
    ends = np.cumsum(quota).astype(np.float64)
    n = -(-total // block) + 4 * len(quota) + 8 if total else 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            point = ((slot.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)).astype(np.float64) / 2.0**64 * max(1, total)
            sid = np.minimum(np.searchsorted(ends, point, side="right"), len(ends) - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sid)], ["slot", "sid"])

    slots = spark.range(0, n).mapInArrow(place, "slot long, sid int").withColumn("chunk", F.floor(F.col("slot") / SLOTS_PER_CHUNK))
    counts = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(W.partitionBy("sid").orderBy("chunk")) - F.col("c")).drop("c")
    ranked = slots.withColumn("r", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(before, ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("r") + F.col("before")).cast("long").alias("rank"))
    # whole passes have blocks of which the last is short, so they count apart
    per_pass = f"((source_size + {block} - 1) div {block})"
    wanted = listed.where("quota > 0 and source_size > 0").withColumn("k", F.expr(f"quota div source_size * {per_pass} + (quota % source_size + {block} - 1) div {block}"))
    lacking = wanted.join(counts.groupBy("sid").agg(F.sum("c").alias("have")), "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("k > have")
    lacking = lacking.select("sid", F.explode(F.expr("sequence(have, k - 1)")).alias("rank"))
    return ranked.unionByName(lacking.select((F.lit(n) + F.col("rank") * len(quota) + F.col("sid")).alias("slot"), "sid", "rank"))


def mix(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents with size, source_size, target and key columns, and the mix: (slot, key, word, words) pieces of documents in slot order.

    ``docs`` needs doc_id, text and source. ``key`` names a row: its doc_id with a hash of its text and its place among equal rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("copy"))
    rows = cut(rows, "sizes")
    table = source_table(rows)
    quota = np.array([round(t) for _, _, t in table], np.int64)
    buckets = max(1, -(-rows.count() // DOCS_PER_BUCKET))
    listed = spark.createDataFrame([(i, a, int(s), float(t), int(q)) for i, ((a, s, t), q) in enumerate(zip(table, quota))] or [(0, "", 0, 0.0, 0)], "sid int, name string, source_size long, target double, quota long")
    known = rows.join(F.broadcast(listed) if len(table) <= 10_000 else listed, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    known = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int"))
    order = W.partitionBy("sid", "bucket").orderBy(F.xxhash64(F.lit("mix"), "doc_id", "copy"), "doc_id", "copy")
    known = known.withColumn("nth", F.row_number().over(order)).withColumn("inner", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(W.partitionBy("sid").orderBy("bucket")) - F.col("s")).drop("s")
    lined = cut(known.join(before, ["sid", "bucket"]).withColumn("at", F.col("inner") + F.col("before")).drop("inner", "before"), "line")
    key = [F.col("bucket"), F.col("nth"), F.col("sid")]
    lined = lined.withColumn("key", F.struct(*key))
    part = lined.where("size > 0").select("sid", "key", "doc_id", "copy", "source_size", "quota", "size", "at", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    part = part.withColumn("from", F.greatest("at", F.col("block") * block)).withColumn("to", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block))
    slots = schedule(listed, quota, block).join(F.broadcast(listed.select("sid", "source_size", "quota")) if len(table) <= 10_000 else listed.select("sid", "source_size", "quota"), "sid")
    blocks = F.expr(f"(source_size + {block} - 1) div {block}")
    # words of the source taken before this slot: whole passes over its line, then blocks of this pass
    slots = slots.where("source_size > 0").withColumn("pass", F.expr(f"rank div ((source_size + {block} - 1) div {block})")).withColumn("block", F.col("rank") % blocks)
    slots = slots.withColumn("left", F.col("quota") - F.col("pass") * F.col("source_size") - F.col("block") * block).where("left > 0").select("slot", "sid", "block", "pass", "left")
    pieces = part.join(slots, ["sid", "block"])
    pieces = pieces.withColumn("to", F.least("to", F.col("block") * block + F.col("left"))).where("to > from")
    return lined, pieces.select("slot", "pass", "key", "doc_id", "copy", (F.col("from") - F.col("at")).alias("word"), (F.col("to") - F.col("from")).alias("words"))


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target and the words the mix takes of it, repeats counted."""
    lined, pieces = mix(docs, block)
    sums = pieces.groupBy("key").agg(F.sum("words").alias("t"))
    return lined.join(sums, "key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, with_slot: bool = False) -> DataFrame:
    """The mix as documents: for each document and pass one row, with the whole text where the pass takes all of it, else the run of words that it takes, joined by one space.

    Columns as in docs, and ``slot`` if asked for: the first slot of the row's words. Rows are in slot order, so that files written from them are interleaved by source."""
    _, pieces = mix(docs, block)
    runs = pieces.groupBy("doc_id", "copy", "key", "pass").agg(F.min("word").cast("int").alias("a"), F.sum("words").cast("int").alias("n"), F.min("slot").alias("slot"))
    runs = runs.groupBy("doc_id", "copy", "key").agg(F.collect_list(F.struct("pass", "a", "n", "slot")).alias("runs"))
    runs = runs.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "copy").orderBy("key"))).drop("key")
    full = docs.withColumn("copy", F.xxhash64("text")).withColumn("_key", F.xxhash64("doc_id", "copy"))
    # equal rows are told apart by a number; whole texts are shuffled for it only where there are such
    repeated = cut(full.groupBy("_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_key"), "repeated")
    if repeated.isEmpty():
        full = full.withColumn("nth", F.lit(1))
    else:
        near, clear = passing(full, repeated, "_key")
        full = near.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "copy").orderBy(F.lit(0)))).unionByName(clear.withColumn("nth", F.lit(1)))
    joined = full.join(runs, (full.doc_id.eqNullSafe(runs.doc_id)) & (full.copy == runs.copy) & (full.nth == runs.nth)).select(*[full[c] for c in docs.columns], runs["runs"])
    joined = joined.withColumn("run", F.explode("runs")).withColumn("size", n_words(F.col("text")))
    words = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    part = F.array_join(F.slice(words, F.col("run.a") + 1, F.col("run.n")), " ")
    text = F.when((F.col("run.a") == 0) & (F.col("run.n") == F.col("size")), F.col("text")).otherwise(part)
    chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    named = [c for c in docs.columns if not (with_slot and c == "slot")]
    order = [F.col("run.slot").alias("_slot"), F.col("run.pass").alias("_pass")]
    out = joined.withColumn("text", text).select(*named, *order).withColumns(chars).orderBy("_slot", "_pass", "doc_id", F.xxhash64("text"))
    return out.select(*named, *([F.col("_slot").alias("slot")] if with_slot else []))
