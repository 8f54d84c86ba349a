"""Connected components of an edge list by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.llm.common import lean, materialize, settle

#: Edges that a task takes together before the first round (16 MB).
TOGETHER = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, its component's least node) that connect what each stretch of edges connects: chains within a task take no rounds."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def star() -> pa.RecordBatch:
        a, b = (np.concatenate(side) for side in zip(*held))
        held.clear()
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = index[: len(a)], index[len(a) :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[x], label[y])
            before = label.copy()
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
            np.minimum.at(label, before, label.copy())
            label = label[label]
            if (label == before).all():
                break
        moved = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])

    for batch in batches:
        if len(batch):
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) >= TOGETHER:
            yield star()
    if held:
        yield star()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long, not null): label is the smallest node that can be reached.

    A round is two aggregations and two joins on the edges; rounds grow with the logarithm of the nodes. Each round is a table in the
    shared folder, so neither lineage nor driver grows; the one before it is deleted. A node with very many neighbours is one row on the
    aggregated side of each join, so its edges can be split over tasks.
    """
    spark = edges.sparkSession
    state: tuple = ()

    def kept(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        watched = pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
        out = materialize(watched, "edges")
        return out, (seen.get["n"], seen.get["s"])

    current, state = kept(edges.mapInArrow(lean(_stars), "a long, b long").distinct())
    before = None
    while state != before:
        before = state
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: the larger neighbours of a node go to its smallest
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, (current, state) = current, kept(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        settle(spark, old)
    labels = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
