"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def redealt(df: DataFrame, column: str) -> DataFrame:
    """The same rows, of whose partitioning by a bigint column Spark no longer knows: a join then deals both sides anew, and the
    adaptive planner can split the rows of a key that has many."""
    return df.withColumn(column, F.col(column).bitwiseXOR(F.lit(0).cast("long")))


#: Edges that a task contracts at once
CONTRACTED = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The same connections as few edges: each node but the least of its part is tied to that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)  # what stands for a part goes along
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    far = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["u", "v"])


def contracted(edges: DataFrame, most: int = CONTRACTED) -> DataFrame:
    """Edges (u, v) that connect the same nodes, never more: ``most`` edges of a task at a time become stars. Edges of one part that lie together,
    as those of rows in order often do, need no further step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield _stars(*(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
        if n:
            yield _stars(*(np.concatenate(c) for c in zip(*held)))

    return edges.select("u", "v").where("u is not null and v is not null").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v: bigint): the least node that a node reaches. Loops are no edges, so a node needs another to be listed.

    Tasks first contract the edges that they have. Then large-star and small-star steps in turn (Kiveris et al. 2014): a node's larger neighbours, then its smaller ones, are tied to the least it knows. The number
    of steps grows with the logarithm of the longest path, edges never multiply, and no step holds the neighbours of a node in a task:
    each is a least neighbour by partial aggregation and a join that splits nodes with many.
    """

    def least(e: DataFrame) -> DataFrame:
        return redealt(e.groupBy("u").agg(F.min("v").alias("low")), "u")

    def tied(a: F.Column, b: F.Column, e: DataFrame) -> DataFrame:
        return e.select(a.alias("u"), b.alias("v")).where("u <> v").distinct()

    edges = contracted(edges)
    now = storage.written(tied(F.greatest("u", "v"), F.least("u", "v"), edges), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tied(F.col("v"), F.least("u", "low"), both.join(least(both), "u").where("v > u"))
        small = tied(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")), F.col("low"), large.join(least(large), "u"))
        before, now = now, storage.written(small, "edges")
        storage.removed(before)
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == seen:
            break
        seen = told
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
