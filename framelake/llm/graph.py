"""Connected components of an edge table, and free column names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.lineage import cut, shared_folder

__all__ = ["components", "cut", "fresh", "shared_folder"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


FEW_EDGES = 1 << 20  # 16 MB, which one task settles


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least node of its component.

    Up to ``few`` edges are settled by one task.  More go in rounds: each takes the least label among a node's
    neighbours and then that label's own label, so paths halve; rounds stop when nothing changes.  Hubs
    are aggregated before the shuffle.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    if edges.limit(few + 1).count() <= few:
        return edges.coalesce(1).mapInArrow(_settle, "node long, label long")
    both = cut(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels.node == heard.a).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        labels = cut(near.join(up, near.label == up.up, "left").select("node", "old", F.least("label", F.coalesce("up_label", "label")).alias("label")))
        changed = labels.where("label <> old").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rounds over one partition."""
    parts = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for b in batches]
    nodes, ends = np.unique(np.concatenate([*parts, np.zeros((2, 0), np.int64)], axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label, old = np.arange(len(nodes)), None
    while old is None or (label != old).any():
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        np.minimum.at(label, old, label.copy())  # what a node hears, its label hears
        label = label[label]
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(nodes[label[i : i + (1 << 16)]])], names=["node", "label"])
