"""Connected components by local forests: few shuffles for graphs of many small components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.session import cut_lineage


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node each is connected to by them: minima over neighbours, halving paths."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label[x] == label[y]).all():
            return nodes, nodes[label]


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a long, b long)``; the label is the smallest node of the component.

    Each task joins the edges it happens to have and gives every node the smallest it saw. Nodes with several answers make edges
    between these; that smaller graph is treated alike until there is none, and the answers are chained. An answer per node and
    task is all that meets in one place, so a hub is no hot key. Every round is written to the checkpoint folder.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if len(batch)]
        if parts:
            nodes, labels = smallest_labels(*(np.concatenate(c) for c in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "root"])

    current, rounds = edges.select(F.col("a").cast("long"), F.col("b").cast("long")), []
    while True:
        told = cut_lineage(current.mapInArrow(local, "node long, root long").groupBy("node").agg(F.min("root").alias("label"), F.collect_set("root").alias("_roots")))
        rounds.append(told.select("node", "label"))
        current = told.filter(F.size("_roots") > 1).select(F.explode("_roots").alias("a"), F.col("label").alias("b")).filter("a != b")
        if current.isEmpty():
            break
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.select(F.col("node").alias("_node"), F.col("label").alias("_label")), F.col("label") == F.col("_node"), "left").select(
            "node", F.coalesce("_label", "label").alias("label"))
    return out
