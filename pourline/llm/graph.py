"""Connected components of an edge list, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable_alone

MAX_ROUNDS = 100


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros(1, np.int64)
    for batch in batches:
        n += batch.num_rows
        total += batch.column(0).to_numpy().sum()
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array(total)], names=["n", "h"])


def _mark(edges: DataFrame) -> tuple:
    """How many edges there are, and their hashes' sum (each task's modulo 2 ** 64), without a shuffle."""
    rows = edges.select(F.xxhash64("u", "v")).mapInArrow(_sums, "n long, h long").collect()
    return sum(r["n"] for r in rows), sum(r["h"] for r in rows) % (1 << 64)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest neighbour and
    then its smaller neighbours likewise.  Edges lead from the larger node to the
    smaller, so the smallest neighbour is the least of a node's own edges, or itself.
    A round is five shuffles of single nodes and edges, equal edges are dropped before
    a node's are brought together, and the edge list is checkpointed after it, so
    neither a component nor an edge list ever has to fit in one task.
    """
    current = durable_alone(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    mark = _mark(current)
    for _ in range(MAX_ROUNDS):
        least = current.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = current.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        small = large.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
        ends = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        current = durable_alone(ends.where("u <> v").distinct())
        now = _mark(current)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("star contraction did not settle")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
