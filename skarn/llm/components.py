"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import drop_stored, stored


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task, each batch reduced to at most one per node: to the smallest node its links reach."""
    for batch in batches:
        ends = np.stack([batch.column("u").to_numpy(), batch.column("v").to_numpy()])
        nodes, flat = np.unique(ends, return_inverse=True)
        a, b = flat.reshape(2, -1)
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all() and (root[a] == root[b]).all():
                break
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link in (u, v), `root` the smallest node that links reach; u, v are longs.

    Links may repeat, in either direction; a link of a node to itself and one with a null end say nothing. A table
    without links gives no rows. Each step is written to the shared folder; only counts reach the driver. A node with
    very many links is one side of an ordinary join whose partitions adaptive execution may split.
    """
    edges = stored(links.where("u <> v").select("u", "v").mapInArrow(forest, "u long, v long").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        # large star: larger neighbours hang on the smallest node around
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: what a node hangs on hangs together
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        drop_stored(edges, least, large, lowest)
        edges = after
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tops)
