"""Connected components of an edge table, without gathering it on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.steps import settled

MOST_ROUNDS = 60
#: Edges up to which one task joins them: 16 bytes each, and as much again for the nodes.
SMALL = 250_000


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for each node of edges(a, b); the component is its least node.

    A table of at most ``small`` edges is settled by one task. A larger one goes
    in rounds: each takes the least label among a node's neighbours and then
    follows labels once (so paths halve), until nothing changes. Minima are
    combined before they are shuffled, so a node with very many edges is no
    bottleneck.
    """
    edges = settled(edges.select("a", "b").where("a <> b").distinct())
    if edges.count() <= small:
        return settled(edges.coalesce(1).mapInArrow(_joined, "node bigint, component bigint"))
    return _in_rounds(edges)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label propagation with shortcuts over all edges of one bounded table."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _in_rounds(edges: DataFrame) -> DataFrame:
    both = settled(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(MOST_ROUNDS):
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("offer"))
        step = settled(labels.join(offered, labels["node"] == offered["a"]).select("node", F.col("label").alias("old"), F.least("label", "offer").alias("low")))
        ahead = step.select(F.col("node").alias("at"), F.col("low").alias("further"))
        jumped = settled(step.join(ahead, F.col("low") == F.col("at"), "left").select("node", "old", F.least("low", F.coalesce("further", "low")).alias("label")))
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("the components did not settle")
