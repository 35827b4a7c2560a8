"""Connected components over an edge table: alternating large-star / small-star steps
(Kiveris et al., 2014). Each step is a pair of keyed aggregations and joins; the edge
table is written to the shared folder between steps. No edge list reaches the driver.

Before the first step every task replaces the edges it reads, a bounded number at a time, by a
spanning forest of them. Steps over few edges run in few tasks (``EDGES_PER_TASK``)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.llm.tables import arrow_map, stored

EDGES_PER_TASK, FOREST_EDGES = 100_000, 1 << 20


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of 0..n-1 under the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def spanned(held):
        u, v = (np.concatenate([h[i] for h in held]) for i in range(2))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = forest(len(nodes), at[: len(u)], at[len(u):])
        child = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[label[child]])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
        n += batch.num_rows
        if n >= FOREST_EDGES:
            yield spanned(held)
            held, n = [], 0
    if n:
        yield spanned(held)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): root is the smallest node of the component; only nodes with an edge appear. Ids are not null."""
    e = stored(arrow_map(edges.where(F.col(u) != F.col(v)).select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")), _forests, "u long, v long"))
    before = _state(e)
    while before[0]:  # every round lowers a parent, so it ends; in the logarithm of the longest path
        few = max(1, math.ceil(2 * before[0] / EDGES_PER_TASK))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        e = stored(small.select("e.u", "e.v").where("u != v").coalesce(few).distinct().coalesce(few))
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
