"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import map_arrow, materialise, ship

#: Edges that a task contracts at once before they are dealt out.
LOCAL_EDGES = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and the smallest node that each reaches."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            return nodes, nodes[parent]
        low, high = np.minimum(px, py)[apart], np.maximum(px, py)[apart]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, root = roots(a, b)
        keep = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= LOCAL_EDGES:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that is not the smallest of its component has one edge, to that smallest node."""
    if edges.groupBy("u").count().where("count > 1").isEmpty():
        return edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
    return False


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` has two long columns, no nulls. Returns (node, component) for every node with an edge to another,
    component being the smallest node that it reaches.

    Each task first contracts its edges to stars. Then rounds of large-star and small-star follow, each a shuffle on
    nodes with partial aggregation; a hub's edges are spread by the skew join. Each round is written to the shared folder."""
    ship(edges.sparkSession)
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = materialise(now.transform(map_arrow, _contract, "u long, v long").distinct(), "edges")
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = materialise(small.transform(map_arrow, _contract, "u long, v long").distinct(), "edges")
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
