"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, checkpointed


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find: each node that a pair names, with the least node linked to it."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as a star forest: the same links, at most one edge a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = forest((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        links = [(a, b) for a, b in found.items() if a != b]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def at_once(links: DataFrame) -> DataFrame:
    """(node, root) of few enough links, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = forest((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (found.keys(), found.values())], ["node", "root"])

    return links.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """(node, root) for every node of edges (a long, b long), root the least node reachable.

    Edges are contracted inside each partition first. If at most `few` are left, one task joins them. Otherwise every round takes the least label of
    all neighbours (a partial aggregate, so the messages to a hub shrink before they move) and then
    the label's own label, which halves the distance left. No node's neighbours are gathered; a hub's
    own edges, and the nodes of a large component, are a frequent join key that meets a single row,
    which adaptive execution splits where it is skewed.
    """
    links = checkpointed(contracted(edges))
    if links.count() <= few:
        return checkpointed(at_once(links))
    both = links.union(links.select("b", "a")).toDF("a", "b")
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        told = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("root").alias("told"))
        spread = labels.join(told, "node", "left").select("node", F.least("root", "told").alias("near"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        after = checkpointed(spread.join(jump, "near", "left").select("node", F.least("near", "far").alias("root"), "was"))
        changed = after.where("root <> was").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
