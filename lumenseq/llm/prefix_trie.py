"""The prefix trie of conversations: each distinct sequence of first turns is a node, with its members, children and what sharing it saves.

A turn is known by the MD5 of its role and text, so texts don't move. Conversations are ordered by (sequence, conv_id) over range partitions, which brings
the members of a node together and deals copies of one conversation out; a partition is read in blocks of bounded size. A block is a shard: vertical bitmaps
give for each (position, turn) the bitset of its conversations. Depth first, a node's bitset is intersected with the postings of the next position, taking
its least conversation without a child yet, until all are in one: the intersections are the children, their bit counts the members, and the
bitset of conversations that end there the end list.

Only the nodes on the paths of a block's first and last conversation can be in other blocks too. All others are finished where they are found; the open ones, at
most two paths a block, are added up by their path. What a subtree sums over blocks is additive but for one term a node, which one block that
holds the node accounts for; so every sum needs one exchange, however deep the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Conversations and turns of a block; it ends when either is reached.
MOST_CONVERSATIONS, MOST_TURNS = 4096, 1 << 17
ROW = (
    "block long, path binary, parent binary, is_open boolean, parent_open boolean, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, chars long, ends_sha256 string, ends binary"
)
SCHEMA = pa.schema([(name, {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}[kind]) for name, kind in map(str.split, ROW.split(", "))])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (key, chars), key the MD5 of role and text, chars the text's code points.

    Null turns come first; equal ones are ordered by role, then the text's MD5, and all count, repeated rows too. Null roles and texts are
    empty; rows without a conv_id belong to no conversation and are left out. A conversation is one row, 24 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), F.md5(text.cast("binary")).alias("tie"), F.unhex(key).alias("key"), F.length(text).alias("chars")).alias("x"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["key"], x["chars"])).alias("turns"))


def grafted(rows: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, turns): every conversation c begins with the first h turns of conversation c - c % group and goes on with its own after
    its first h; h is the CRC-32 of the decimal c modulo heads. A conversation that isn't there has no turns to give."""
    c = F.col("conv_id")
    known = checkpointed(rows)
    first = known.where(c % group == 0).select(c.alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    joined = known.withColumns({"base": c - c % group, "h": (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")}).join(first, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.filter("turns", lambda x: F.lit(False)))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


class Conversation(NamedTuple):
    conv_id: int
    keys: list[bytes]
    chars: list[int]


def lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def decimal_ids(bits: int, some: list[Conversation]) -> bytes:
    ids = []
    while bits:
        ids.append(str(some[lowest(bits)].conv_id))
        bits &= bits - 1
    return ",".join(ids).encode()


def shard(some: list[Conversation], block: int) -> list[dict]:
    """A block's nodes as rows, parents before children; some: its conversations in the order of their sequences.

    An open node's n_leaves and saved leave out what only all blocks can tell: whether it is a leaf, and the one member whose turn isn't saved.
    """
    edges = {some[0].conv_id, some[-1].conv_id}
    some = sorted(some)  # bit k is the k-th conversation by id, so a node's lowest bit is its least member
    postings: list[dict[bytes, int]] = []
    ends: dict[int, int] = {}
    border = 0
    for k, c in enumerate(some):
        ends[len(c.keys)] = ends.get(len(c.keys), 0) | 1 << k
        border |= (c.conv_id in edges) << k
        for at, key in enumerate(c.keys):
            if at == len(postings):
                postings.append({})
            postings[at][key] = postings[at].get(key, 0) | 1 << k
    rows: list[dict] = []
    above: list[int] = []
    todo = [((1 << len(some)) - 1, -1)]
    while todo:
        bits, place = todo.pop()
        parent = rows[place] if place >= 0 else {"path": b"", "depth": -1, "conv_id": None, "is_open": False}
        depth, least = parent["depth"] + 1, some[lowest(bits)]
        path, chars = (hashlib.md5(parent["path"] + least.keys[depth - 1]).digest(), least.chars[depth - 1]) if depth else (b"", 0)
        ended, n, is_open = bits & ends.get(depth, 0), bits.bit_count(), bool(bits & border)
        left, listed = bits & ~ended, decimal_ids(ended, some)
        above.append(place)
        rows.append({
            "block": block, "path": path, "parent": parent["path"] if depth else None, "is_open": is_open, "parent_open": parent["is_open"], "conv_id": least.conv_id,
            "depth": depth, "parent_conv_id": parent["conv_id"], "n_convs": n, "n_children": 0, "n_leaves": int(not is_open and not left), "saved": chars * (n if is_open else n - 1),
            "chars": chars, "ends_sha256": None if is_open else hashlib.sha256(listed).hexdigest(), "ends": listed if is_open else None,
        })
        while left:
            child = left & postings[depth][some[lowest(left)].keys[depth]]
            todo.append((child, len(rows) - 1))
            left &= ~child
    for row, place in zip(rows[:0:-1], above[:0:-1]):
        parent = rows[place]
        parent["n_children"] += not row["is_open"]  # an open child is counted where all blocks meet
        parent["n_leaves"] += row["n_leaves"]
        parent["saved"] += row["saved"]
    return rows


def sharded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all blocks of a partition; blocks are numbered in the order of their sequences."""
    number, some, turns = TaskContext.get().partitionId() << 32, [], 0

    def told() -> Iterator[pa.RecordBatch]:
        rows = shard(some, number) if some else []
        for start in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist(rows[start : start + 4096], SCHEMA)

    for batch in batches:
        for c in map(Conversation, *(batch.column(i).to_pylist() for i in range(3))):
            some.append(c)
            turns += len(c.keys)
            if len(some) >= MOST_CONVERSATIONS or turns >= MOST_TURNS:
                yield from told()
                number, some, turns = number + 1, [], 0
    yield from told()


def once_each(block: pa.Table) -> pa.Table:
    """(path, leaves, saved): what a block's open nodes that it accounts for add to each of its open nodes' subtrees."""
    rows = sorted(block.to_pylist(), key=lambda r: -r["depth"])
    sums = {r["path"]: [int(r["owned"] and r["leaf"]), -r["chars"] * r["owned"]] for r in rows}
    for r in rows:
        if r["depth"]:
            for k in (0, 1):
                sums[r["parent"]][k] += sums[r["path"]][k]
    return pa.table({"path": pa.array(sums, pa.binary()), "leaves": pa.array([x[0] for x in sums.values()], pa.int64()), "saved": pa.array([x[1] for x in sums.values()], pa.int64())})


def joined_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, ends_sha256) of parts of end lists, in the order of path and block; a list streams through, however long."""
    last, sha = None, hashlib.sha256()
    for batch in batches:
        done = []
        for path, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if path != last:
                done += [(last, sha.hexdigest())] if last is not None else []
                last, sha = path, hashlib.sha256(ends)
            else:
                sha.update(b"," + ends)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["path", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], ["path", "ends_sha256"])


def nodes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of rows (conv_id, turns).

    conv_id is the least member, parent_conv_id the parent's; n_leaves and saved_tokens, each node's (n_convs - 1) x code points of its last turn's text, are sums
    over the subtree; ends_sha256 hashes the ids of the conversations that end in the node. Without conversations there is no node, not even the root.
    A conv_id is expected once. The end list of a node in several blocks is hashed in one stream, as its hash asks; it takes no memory.
    """
    ordered = rows.select("conv_id", F.transform("turns", lambda x: x["key"]).alias("keys"), F.transform("turns", lambda x: x["chars"]).alias("chars"))
    ordered = ordered.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    found = checkpointed(ordered.mapInArrow(sharded, ROW))
    parts = found.where("is_open")
    met = parts.groupBy("path").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.min("block").alias("owner"),
    )
    kids = met.where("depth > 0").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("kids"))
    met = checkpointed(met.join(kids, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids"))
    placed = checkpointed(parts.select("block", "path").join(met, "path").select("block", "path", "parent", "depth", "chars", "conv_id", (F.col("owner") == F.col("block")).alias("owned"), (F.col("n_children") == 0).alias("leaf")))
    once = placed.groupBy("block").applyInArrow(once_each, "path binary, leaves long, saved long").groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("less"))
    ends = parts.where("length(ends) > 0").select("path", "block", "ends").repartition("path").sortWithinPartitions("path", "block").mapInArrow(joined_ends, "path binary, ends_sha256 string")
    top = met.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shared = met.join(once, "path").join(ends, "path", "left").join(top, "parent", "left")
    shared = shared.withColumns({"n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved") + F.col("less"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS))})
    own = found.where("not is_open").withColumnRenamed("saved", "saved_tokens")
    under = own.where("parent_open").drop("parent_conv_id").join(placed.select("block", F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id")), ["block", "parent"])
    return own.where("not parent_open").select(*COLUMNS).unionByName(under.select(*COLUMNS)).unionByName(shared.select(*COLUMNS))
