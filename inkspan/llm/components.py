"""Connected components of a graph of any size.

Edges are first reduced where they are: blocks of ``BLOCK`` edges become spanning forests, so that what is shuffled
follows the nodes of a block and not its edges. What is left is solved by one task if there are at most ``FEW`` edges,
a fixed bound that is checked, and else by DataFrame rounds of large-star and small-star steps: each rewrites the edges
so that nodes point at ever smaller neighbours, and rounds grow with the logarithm of the longest path. Minima are
pre-aggregated by node, and both sides of each join are staged tables, so that a hub's edges can be split over tasks
(adaptive skew join). Both ways give the same roots. Every round ends in the shared folder; nothing comes to the driver
but a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import stage, unstage

#: Edges of a block that is reduced at once; most edges that one task solves (16 bytes each, about 100 while it works).
BLOCK, FEW = 500_000, 1_000_000


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each is connected with: roots are hooked on smaller neighbours, paths shortened."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of edges (u, v) as (node, root) of their components; at most BLOCK edges and a batch are held."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, roots = solve(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
        own = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield flush(held)
            held, size = [], 0
    if size:
        yield flush(held)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        nodes, roots = solve(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
        own = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], ["node", "root"])


def thinned(rows: DataFrame, edges_of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Spanning forests of edges, block by block; ``edges_of`` makes the edges (two long columns) from the rows.

    Both run in one worker: two Python steps in a stage would take two workers for each task.
    """
    return rows.mapInArrow((lambda batches: forests(edges_of(batches))) if edges_of else forests, "u long, v long")


def components(edges: DataFrame, thin: bool = True) -> DataFrame:
    """(node, root) for every node that has an edge and isn't the smallest of its component; edges: two long columns, which
    are thinned out first unless they are already."""
    edges = stage(thinned(edges) if thin else edges, "forests")
    if edges.count() <= FEW:
        found = stage(edges.coalesce(1).mapInArrow(_whole, "node long, root long"), "roots")
        unstage(edges)
        return found
    first = edges
    edges, mark = _round_end(edges.distinct())
    unstage(first)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        least2 = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small, now = _round_end(moved.unionByName(least2.select("u", F.col("m").alias("v"))).distinct())
        for old in (least, least2, large, edges):
            unstage(old)
        edges = small
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def _round_end(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = stage(edges, "edges")
    return edges, tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
