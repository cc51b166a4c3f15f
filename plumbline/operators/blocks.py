"""Exact Jaccard pairs of token sets by pairs of blocks, so that no candidate leaves its task.

Sets are written once, in files by size. A task reads two files from the shared storage. Counts of the sets' tokens in hash buckets are multiplied as
matrices: the product is at least the overlap, so pairs below the threshold by it are left out without loss, and the others are verified on the sets.
Only files whose sizes allow a pair are compared. The disk holds the sets and the pairs found; the work grows with the square of the sets of like size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep, work_folder

#: Tokens of a file on average, sets of a strip, and least and most buckets.
WEIGHT, STRIP, LEAST, MOST = 1 << 19, 512, 1 << 10, 1 << 13
#: A pair's threshold is met up to rounding.
EPS = 1e-9


def _block(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets and tokens of a file of sets, in order of size."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        t = pq.read_table(f, columns=["id", "s"]).combine_chunks()
    ids, sets = t["id"].to_numpy(), t["s"].combine_chunks()
    offsets = sets.offsets.to_numpy().astype(np.int64)
    return ids, offsets, sets.values.to_numpy()


def _counts(offsets: np.ndarray, tokens: np.ndarray, i: int, j: int, buckets: int) -> np.ndarray:
    """Tokens of the sets i to j in each bucket."""
    row = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
    at = row * buckets + (tokens[offsets[i] : offsets[j]] & (buckets - 1))
    return np.bincount(at, minlength=(j - i) * buckets).reshape(j - i, buckets).astype(np.float32)


def _pairs(x: tuple, y: tuple, same: bool, tau: float) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, common, sum of sizes) of the pairs, a < b, of two blocks, or inside of one."""
    (xi, xo, xt), (yi, yo, yt) = x, y
    xn, yn = np.diff(xo), np.diff(yo)
    for i in range(0, len(xi), STRIP):
        p = min(i + STRIP, len(xi))
        left: tuple[int, np.ndarray] | None = None
        for j in range(i if same else 0, len(yi), STRIP):
            q = min(j + STRIP, len(yi))
            if xn[i:p].max() < tau * yn[j:q].min() - EPS or yn[j:q].max() < tau * xn[i:p].min() - EPS:
                continue
            buckets = min(MOST, max(LEAST, 1 << int(8 * max(xn[i:p].max(), yn[j:q].max()) - 1).bit_length()))
            if left is None or left[0] != buckets:
                left = buckets, _counts(xo, xt, i, p, buckets)
            most = np.minimum(left[1] @ _counts(yo, yt, j, q, buckets).T, np.minimum(xn[i:p, None], yn[None, j:q]))
            ok = most * (1 + tau) >= tau * (xn[i:p, None] + yn[None, j:q]) - 1e-3
            for r, c in zip(*np.nonzero(ok)):
                r, c = r + i, c + j
                if same and r >= c or xi[r] == yi[c]:
                    continue
                n, both = len(np.intersect1d(xt[xo[r] : xo[r + 1]], yt[yo[c] : yo[c + 1]], assume_unique=True)), int(xn[r] + yn[c])
                if n >= tau * (both - n) - EPS * both:
                    yield min(xi[r], yi[c]), max(xi[r], yi[c]), n, both


def jaccard_pairs(sets: DataFrame, tau: float) -> DataFrame:
    """(a, b, common, both) of the pairs a < b of sets (id, s) with Jaccard of at least tau, up to rounding; both is the sum of the sizes. Empty sets have no pair."""
    spark = sets.sparkSession
    sets = sets.where(F.size("s") > 0).select("id", "s", F.size("s").alias("n"))
    files = int((sets.agg(F.sum("n")).first()[0] or 0) // WEIGHT) + 1
    path = work_folder(spark, "blocks")
    sets.repartitionByRange(files, "n", "id").sortWithinPartitions("n").select("id", "n", "s").write.option("compression", "zstd").parquet(path)
    spans = spark.read.schema("id long, n int, s array<bigint>").parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    spans = keep(spans, "spans")
    x, y = spans.alias("x"), spans.alias("y")
    near = (F.col("x.f") <= F.col("y.f")) & (F.col("x.hi") >= tau * F.col("y.lo") - EPS) & (F.col("y.hi") >= tau * F.col("x.lo") - EPS)
    tasks = x.join(y, near).select(F.col("x.f").alias("x"), F.col("y.f").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = _block(f)
                found = list(_pairs(one, one if f == g else _block(g), f == g, tau))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b", "common", "both"])

    spread = max(1, min(files * 4, 4 * spark.sparkContext.defaultParallelism))
    return tasks.repartition(spread, F.xxhash64("x", "y")).mapInArrow(run, "a long, b long, common long, both long")
