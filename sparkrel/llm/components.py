"""Connected components of a table of links.

Every task contracts the links it holds to a forest of stars (node, root). A
node met by several tasks keeps its smallest root, and its other roots are
linked to that one; these links between roots, far fewer, are contracted in
the next round. Rows are dealt by node or as they come, never by root, so a
hub with millions of links is no hot key. Once the links left are at most
``task_links``, a bound, one task contracts them all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, keep

TASK_LINKS = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): each node of the links with the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to stars, a bounded number of links at a time; what remains doubled is met by the next round."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 2 * TASK_LINKS:
            a, b = forest(a, b)
            if len(a) > TASK_LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["node", "root"])
                a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["node", "root"])


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for every node of the links (two long columns, no nulls): root is the smallest node of its component."""
    bounded_batches(links.sparkSession)
    a, b = links.columns
    links = keep(links.select(F.col(a).alias("a"), F.col(b).alias("b")), "links")
    n = links.count()
    if n <= task_links:
        return keep(links.repartition(1).mapInArrow(contract, "node long, root long"), "roots")
    stars = keep(links.repartition(-(-n // task_links)).mapInArrow(contract, "node long, root long"), "stars")
    own = keep(stars.groupBy("node").agg(F.min("root").alias("root")), "own")
    between = stars.join(own.withColumnRenamed("root", "least"), "node").filter("root != least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct()
    if between.isEmpty():
        return own
    above = components(between, task_links)
    return keep(own.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
