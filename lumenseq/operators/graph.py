"""Overlap graphs: components, and the rules that visit a component's reads in order."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .numbering import numbered
from .overlaps import edges


#: Links that one task joins at once, and nodes that a partition's forest holds; ids of 100 bytes take some 150 MB.
FEW_LINKS = 300_000


class Forest:
    """Union-find over ids of one type; a tree's root is its least id."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        top = x
        while self.parent.setdefault(top, top) != top:
            top = self.parent[top]
        while self.parent[x] != top:
            self.parent[x], x = top, self.parent[x]
        return top

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def stars(self, schema: pa.Schema) -> pa.RecordBatch:
        """Every id beside its root."""
        nodes = list(self.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, schema.types[0]), pa.array([self.root(x) for x in nodes], schema.types[1])], names=["a", "b"])


def stars(links: DataFrame, most: int = FEW_LINKS) -> DataFrame:
    """Links (a, b) that connect the same ids: each partition's as stars around the least id, begun anew whenever a forest holds `most` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, schema = Forest(), None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
            if len(forest.parent) >= most:
                yield forest.stars(schema)
                forest = Forest()
        if forest.parent:
            yield forest.stars(schema)

    return links.mapInArrow(run, links.schema)


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, root) of every node of links (a, b), ids of one type: root is the least node reachable. Links with a null end are left out.

    Each partition first thins its links to a star a component. Up to `few` links are then joined by one task. Beyond that, a node keeps the least of its
    stars' centres, and what is left to join are links from this one to its other centres: the component's least node is a centre wherever it occurs.
    Where these links are few against the stars, their components are found alike, else by rounds. Neither neighbours nor components are gathered.
    """
    thin = materialized(stars(links.select("a", "b").where("a is not null and b is not null")))
    n = thin.count()
    if n <= few:
        return materialized(stars(thin.coalesce(1), 2 * few + 1).toDF("node", "root"))
    least = thin.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("centre"))
    seams = materialized(thin.join(least, F.col("a") == F.col("node")).where("b <> centre").select(F.col("b").alias("a"), F.col("centre").alias("b")).distinct())
    if 2 * seams.count() > n:
        return rounds(thin)
    told = components(seams, few).toDF("centre", "told")
    return materialized(least.join(told, "centre", "left").select("node", F.coalesce("told", "centre").alias("root")))


def rounds(links: DataFrame) -> DataFrame:
    """(node, root): a node takes the least label among its neighbours each round, then that label's label; the number of rounds grows with the logarithm of a
    component's diameter."""
    both = materialized(links.union(links.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    while True:
        told = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("root").alias("told"))
        near = labels.join(told, "node").select("node", F.col("root").alias("was"), F.least("root", "told").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        after = materialized(near.join(jump, "near").select("node", "was", F.least("near", "far").alias("root")))
        labels = after.select("node", "root")
        if after.where("root <> was").limit(1).count() == 0:
            return labels


def walked(length: np.ndarray, links: np.ndarray, start: np.ndarray, by_length: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(reads in visiting order, whether each is forward) of a component; read 0 is the first one and forward.

    Read x has length[x] and links[start[x] : start[x + 1]], its overlaps by ord, each the other read's number doubled, plus 1 on the forward strand.
    Next comes, of the reads that overlap a visited one, the longest (of equal ones the first met), or without by_length the first met; its strand is that
    of the overlap with the first visited read that it overlaps, turned if that one is reversed. A heap holds the reads met, so n overlaps take n log n.
    """
    # a read is met when its first neighbour is visited, which settles its strand
    forward = np.full(len(length), -1, np.int8)  # -1: not met yet
    forward[0] = 1
    order, met, frontier = [0], 0, []
    while True:
        last = order[-1]
        near = links[start[last] : start[last + 1]]
        own = int(forward[last])
        for link in near[forward[near >> 1] < 0].tolist():
            x = link >> 1
            if forward[x] < 0:
                forward[x] = own == link & 1
                heappush(frontier, (-int(length[x]) if by_length else 0, met, x))
                met += 1
        if not frontier:
            break
        order.append(heappop(frontier)[2])
    if len(order) < len(length):
        raise ValueError("reads without a path of overlaps to the first one")
    return np.array(order), forward[order] == 1


def visited(reads: pd.DataFrame, links: pd.DataFrame, by_length: bool = True) -> list[tuple[str, str]]:
    """(id, strand) of one component's reads in visiting order; reads by ord, links by ord."""
    number = {x: k for k, x in enumerate(reads.id)}
    ends, same = np.array([links[c].map(number) for c in ("qn", "tn")], np.int64).T, (links.strand == "+").to_numpy().repeat(2)
    by_read = np.argsort(ends.ravel(), kind="stable")
    start = np.searchsorted(ends.ravel()[by_read], np.arange(len(reads) + 1))
    order, forward = walked(reads.len.to_numpy(), (2 * ends[:, ::-1].ravel() + same)[by_read], start, by_length)
    return [(reads.id.iloc[k], "+" if f else "-") for k, f in zip(order.tolist(), forward)]


def ordered_reads(reads: DataFrame, overlaps: DataFrame, by_length: bool = True) -> DataFrame:
    """(component, id, rank, strand): every component's reads in visiting order, starting from the one that comes first by ord.

    reads: id, len, ord; reads without an overlap are absent. Reads are numbered by component and their lists of overlaps put in order by all tasks. The rule
    goes through a component read by read, so one task takes it, which has to hold its lists (8 bytes an overlap, 16 while they are put together).
    """
    linked = overlaps.where("qn <> tn").select("qn", "tn", F.when(F.col("strand") == "+", 1).otherwise(0).alias("same"), "ord")
    roots = components(linked.select(F.col("qn").alias("a"), F.col("tn").alias("b")))
    met = roots.join(reads.select("id", "len", F.col("ord").alias("place")), F.col("node") == F.col("id")).select("id", "len", "place", F.col("root").alias("component"))
    ids = numbered(met, [F.asc("component"), F.asc("place")], "number", 0)
    numbers = ids.select("id", "number").hint("shuffle_hash")
    for end, name in (("qn", "a"), ("tn", "b")):
        linked = linked.join(numbers.toDF(end, name), end).drop(end)
    seen = lambda one, other: linked.select(F.col(one).alias("number"), "ord", (2 * F.col(other) + F.col("same")).alias("link"))
    lists = seen("a", "b").unionByName(seen("b", "a")).groupBy("number").agg(F.sort_array(F.collect_list(F.struct("ord", "link"))).alias("links"))
    dealt = ids.join(lists, "number").select("component", "number", F.col("len").cast("long").alias("len"), F.col("links.link").alias("links")).repartition("component").sortWithinPartitions("component", "number")

    def of_component(numbers: np.ndarray, length: np.ndarray, sizes: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        order, forward = walked(length, links, np.append(0, np.cumsum(sizes)), by_length)
        return pa.RecordBatch.from_arrays([pa.array(numbers[order]), pa.array(np.arange(1, len(order) + 1)), pa.array(np.where(forward, "+", "-"))], ["number", "rank", "strand"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = None

        def done() -> pa.RecordBatch:
            columns = [np.concatenate([x[i] for x in held]) for i in range(4)]
            held.clear()
            return of_component(*columns)

        for batch in batches:
            names = batch.column("component")
            cuts = np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)) + 1 if len(names) > 1 else np.zeros(0, int)
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                if held and names[at].as_py() != name:
                    yield done()
                name, part = names[at].as_py(), batch.slice(at, end - at)
                numbers, lists = part.column("number").to_numpy(), part.column("links")
                own = lists.flatten().to_numpy() - 2 * (held[0][0][0] if held else numbers[0])  # from here on the component's first read is number 0
                held.append((numbers, part.column("len").to_numpy(), pc.list_value_length(lists).to_numpy(), own.astype(np.int32)))
        if held:
            yield done()

    found = dealt.mapInArrow(run, "number long, rank long, strand string")
    return found.join(ids.select("number", "component", "id"), "number").select("component", "id", "rank", "strand")


def top_n_in_turn(overlaps: DataFrame, n: int) -> DataFrame:
    """Overlaps kept when reads are taken in the order in which they first appear: each keeps the n longest of those left to it, which
    its partners no longer count, and drops the others for its partners too.

    A read's turn settles all that is left to it, so what is left are its overlaps with later reads: an overlap is its
    earlier read's, and of those each read keeps the n longest. No turn has to wait for another one. Overlaps of a read with itself or without a name are left out.
    """
    links = overlaps.where("qn <> tn")
    ends = links.select("ord", F.posexplode(F.array("qn", "tn")).alias("_side", "_read"))
    seen = ends.groupBy("_read").agg(F.min(F.struct("ord", "_side")).alias("_seen"))
    for end in ("qn", "tn"):
        links = links.join(seen.select(F.col("_read").alias(end), F.col("_seen").alias(f"_{end}")), end)
    longest = Window.partitionBy(F.least("_qn", "_tn")).orderBy(F.desc("alnlen"), "ord")
    return links.withColumn("_rank", F.row_number().over(longest)).where(F.col("_rank") <= n).select(*overlaps.columns)


def connected(overlaps: DataFrame) -> DataFrame:
    """(n_components, n_reads) of the overlap graph."""
    roots = components(edges(overlaps).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return roots.agg(F.countDistinct("root").alias("n_components"), F.count("*").alias("n_reads"))
