"""Connected components by alternating large and small stars; all state stays in tables, copied out each round.

A bounded number of links is joined in one task instead, since each round costs several shuffles however few links there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import discard, materialise


#: Links that one task joins, about 100 bytes each; more go through rounds of stars.
LINKS = 1_000_000
#: Rows of a batch that the one task sends on.
ROWS = 100_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of the links a - b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low < high
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) -> (node, component)."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        u.append(batch.column("u").to_numpy().copy())  # the batch itself isn't kept
        v.append(batch.column("v").to_numpy().copy())
    nodes, least = smallest_reached(np.concatenate(u), np.concatenate(v))
    for lo in range(0, len(nodes), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + ROWS]) for x in (nodes, least)], names=["node", "component"])


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component), a written table: the smallest node that links reach. Loops and repeats don't matter.

    A large star hangs each neighbour above a node on the node's smallest neighbour; a small star hangs those below it.
    Both take a minimum that is combined before the shuffle, so a node with very many links is no hot spot.
    """
    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    if links.count() <= LINKS:
        out = materialise(links.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
        discard(links)
        return out
    e = materialise(links.distinct())
    discard(links)
    before = _signature(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialise(hung.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        after = _signature(e)
        if after == before:
            break
        before = after
    out = materialise(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    discard(e)
    return out
