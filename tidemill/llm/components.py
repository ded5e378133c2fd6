"""Connected components of a graph that no single task or driver needs to hold.

Alternates the large-star and small-star steps (Kiveris et al., 2014) until nothing changes.
Each step is a grouped minimum, which Spark aggregates before its shuffle, and a join, which
adaptive execution can split at a hot node. Every round is written to the shared folder. Edges of a small
table, of TASK_EDGES at most, are solved by one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.storage import Scratch
from tidemill.llm.words import releasing

#: Edges, of two longs each, that one task solves.
TASK_EDGES = 1 << 19


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, for each place the least place of its component, after links between the places a and b."""
    label = label.copy()
    while True:  # of two linked components the greater one's least place follows the other's
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while (label != label[label]).any():
            label = label[label]


@releasing
def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component from all edges u and v."""
    edges = [batch for batch in batches if batch.num_rows]
    if edges:
        u, v = (np.concatenate([batch.column(c).to_numpy() for batch in edges]) for c in "uv")
        nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = joined_labels(np.arange(len(nodes)), place[: len(u)], place[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def _state(edges: DataFrame) -> tuple:
    """The same for the same edges in any order."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", into: Scratch | None = None) -> DataFrame:
    """node and component, its least node, for every node that edges name. Null nodes are left out. into: whose working table the result becomes."""
    with Scratch(edges.sparkSession, "components") as scratch:
        edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
        edges = scratch.written(edges, "edges")
        last = _state(edges)
        if last[0] <= TASK_EDGES and edges.schema["u"].dataType.simpleString() == "bigint":
            nodes = edges.repartition(1).mapInArrow(_solved, "node long, component long")
            return into.written(nodes, "components") if into else scratch.result(nodes)
        while True:
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            # A node whose least neighbour is itself keeps its own larger neighbours; so does every node through its larger ones.
            alone = edges.where("u = v")
            large = scratch.written(large.union(alone).distinct(), "large")
            scratch.drop(edges)
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            edges = scratch.written(small.where("u <> v").union(large.where("u = v")).distinct(), "small")
            scratch.drop(large)
            state = _state(edges)
            if state == last:
                break
            last = state
        nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        nodes = nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        return into.written(nodes, "components") if into else scratch.result(nodes)
