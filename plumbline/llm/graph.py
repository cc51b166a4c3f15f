"""Connected components by contraction with random priorities, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task finishes.
SMALL = 500_000


def _finished(edge: DataFrame) -> DataFrame:
    """(a, p) of a graph of at most SMALL edges, in one task: p is the least id that a is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not ends:
            return
        ids, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*ends)]), return_inverse=True)
        parent = list(range(len(ids)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for x, y in zip(at[: len(at) // 2].tolist(), at[len(at) // 2 :].tolist()):
            x, y = sorted((find(x), find(y)))
            parent[y] = x
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[[find(i) for i in range(len(ids))]])], ["a", "p"])

    return edge.select("a", "b").coalesce(1).mapInArrow(run, "a long, p long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of edges (a, b: long): component is the smallest id that it is connected with.

    Each round every vertex joins the neighbour, or itself, of least hash; the contracted graph goes on until it is
    small enough for one task. Vertices that are not a local least vanish, so rounds grow with the logarithm of the graph.
    Least neighbours are found by partial aggregation, so a vertex with very many edges is one row a task. No row goes to the driver."""
    edge = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    small = edge.count() <= SMALL
    if not small:
        edge = cut(edge.union(edge.select("b", "a")), "edges")
    whole, step = None, 0
    while True:
        if small:
            to = cut(_finished(edge), "parents")
        else:
            near = edge.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(step)).alias("h"), F.col("b").alias("v"))).alias("n"))
            own = F.struct(F.xxhash64("a", F.lit(step)).alias("h"), F.col("a").alias("v"))
            to = cut(near.select("a", F.least("n", own).alias("t")).select("a", F.col("t.v").alias("p")), "parents")
        if whole is None:
            whole = to.select(F.col("a").alias("id"), "p")
        else:
            whole = cut(whole.join(to.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("id", F.coalesce("q", "p").alias("p")), "labels")
        if small:
            break
        moved = edge.join(to, "a").select(F.col("p").alias("x"), F.col("b").alias("a")).join(to, "a").select("x", F.col("p").alias("y")).where("x <> y")
        edge = cut(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        small = edge.count() <= SMALL
        step += 1
    if not step:
        return whole.select("id", F.col("p").alias("component"))
    # the smallest id of each: a label is a vertex, not the least one
    least = cut(whole.groupBy("p").agg(F.min("id").alias("component")), "least")
    return cut(whole.join(least, "p").select("id", "component"), "components")
