"""Repeated passages across documents, by winnowing over line hashes.

A passage is a run of consecutive lines with PASSAGE words or more. Every line is hashed; a
gram is the shortest run from a line on with GRAM words. A window is the shortest run from a
line on with PASSAGE words, or the shortest one that ends at a line. Each window selects the gram with the least
hash in it as its fingerprint, so any passage that two places share is certain to show the same
selected gram at both. A document gives each selected gram once, with its position and the windows that it stands for.

The positions are joined by gram. A gram at one place only is settled: its windows occur nowhere
else. Of the others each window is held against the windows of the same gram, and where an earlier
place has the same lines, the match is extended both ways: the windows from a line on reach from a
common run's first line to the end of its last forward window, and the windows up to a line from
the start of its first backward window to its last line. So exactly the common runs of PASSAGE
words or more are found, to both ends, against all earlier places and not only the first one of a gram. The later run
is deleted; the first occurrence, by doc_id and line, stays. A line without a word goes only if it
lies inside a run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, looked_up, texts

PASSAGE = 50
GRAM = 25
#: Rows of one gram or window from which on its key is broadcast.
HOT = 200


def windows(data: bytes, passage: int = PASSAGE, gram: int = GRAM) -> list[tuple[int, int, bytes, int, int]]:
    """(first line, last line, window hash, selected gram's line, gram hash) of every window.

    Lines count from 0; those without a word are passed over, and runs of white space inside a
    line don't matter. A text of fewer than `passage` words has no window. A window hash has 128 bits.
    """
    at, sizes, hashes = [], [], []
    for i, line in enumerate(data.split(b"\n")):
        words = line.split()
        if words:
            at.append(i)
            sizes.append(len(words))
            hashes.append(xxhash.xxh3_128_digest(b" ".join(words)))
    total = np.cumsum(sizes)
    if not at or total[-1] < passage:
        return []
    before = total - sizes
    gram_end = np.searchsorted(total, before + gram).tolist()  # len(at): no such run
    window_end = np.searchsorted(total, before + passage).tolist()
    window_start = (np.searchsorted(before, total - passage, side="right") - 1).tolist()  # -1: no such run
    keys = b"".join(hashes)
    grams = [xxhash.xxh64_intdigest(keys[16 * i : 16 * e + 16]) if e < len(at) else None for i, e in enumerate(gram_end)]
    spans = [(i, e) for i, e in enumerate(window_end) if e < len(at)]
    spans += [(i, e) for e, i in enumerate(window_start) if i >= 0 and window_end[i] < e]
    found = []
    for i, end in spans:
        last = i
        while last + 1 < len(at) and gram_end[last + 1] <= end:
            last += 1
        least = min(range(i, last + 1), key=lambda q: (grams[q], -q))
        found.append((at[i], at[end], xxhash.xxh3_128_digest(keys[16 * i : 16 * end + 16]), at[least], signed(grams[least])))
    return found


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(gram, doc_id, at, windows) of every selected gram of every document, once a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("window", pa.binary())]))
        for batch in batches:
            grams, ids, places, stands = [], [], [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), texts(batch)):
                selected = defaultdict(list)
                for first, last, window, at, key in windows(data, passage, gram):
                    selected[key, at].append({"first": first, "last": last, "window": window})
                for (key, at), of in selected.items():
                    grams.append(key)
                    ids.append(doc_id)
                    places.append(at)
                    stands.append(of)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(ids, batch.column(0).type), pa.array(places, pa.int32()), pa.array(stands, spans)], ["gram", "doc_id", "at", "windows"])

    narrow = docs.where("doc_id is not null").select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"gram long, doc_id {kind}, at int, windows array<struct<first: int, last: int, window: binary>>")


def later_runs(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(doc_id, first, last, from_doc, from_line): lines of doc_id that repeat an earlier window.

    Rows of one document may overlap; together they are its repeated passages. Rows with a null
    doc_id have no place in the order and take no part.
    """
    found = checkpointed(fingerprints(docs, passage, gram))
    place = F.struct("doc_id", "at")
    shared = found.groupBy("gram").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")).where("low <> high").select("gram", "n")
    met = looked_up(found, shared, ["gram"], HOT).select("gram", "doc_id", F.explode("windows").alias("x")).select("gram", "doc_id", "x.*")
    start = F.struct("doc_id", F.col("first"))
    origin = met.groupBy("gram", "window").agg(F.min(start).alias("origin"), F.max(start).alias("end"), F.count("*").alias("n")).where("origin <> end").drop("end")
    later = looked_up(met, origin, ["gram", "window"], HOT).where((F.col("doc_id") > F.col("origin.doc_id")) | (F.col("first") > F.col("origin.first")))
    return later.select("doc_id", "first", "last", F.col("origin.doc_id").alias("from_doc"), F.col("origin.first").alias("from_line"))


def merged(runs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or adjoining line ranges as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def cuts(runs: DataFrame) -> DataFrame:
    """(doc_id, cut): each document's runs of lines to delete, overlapping ones merged, in an array.

    A document's runs are no more than twice its lines; they are merged where they are made first.
    """
    reach = F.struct(F.col("first"), F.col("last"))
    longest = runs.groupBy("doc_id", "first").agg(F.max("last").alias("last"))
    return longest.groupBy("doc_id").agg(F.collect_list(reach).alias("cut"))


def without_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, count: str | None = "n_removed") -> DataFrame:
    """The rows of docs, all columns, with later repeated runs cut out of text, and how many lines that took off.

    A text that is wholly repeated becomes empty; its row stays. Rows with null text or null
    doc_id come back as they are. Rows that repeat a doc_id are taken as one document: they lose
    the same lines. If docs has n_chars, it is counted anew where lines were cut. `count` names the
    last column, which takes the place of one of docs that has its name; None: no such column.
    """
    columns = [c for c in docs.columns if c != count]
    found = cuts(later_runs(docs, passage, gram)).select(F.col("doc_id").alias("id"), "cut")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("doc_id").alias("id"))
    schema = T.StructType([docs.schema[c] for c in columns])
    text_at, sizes_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(0).flatten()
            text, removed = arrays[text_at].to_pylist(), []
            sizes = arrays[sizes_at].to_pylist() if sizes_at is not None else None
            for i, ranges in enumerate(batch.column(1).to_pylist()):
                gone: set[int] = set()
                for first, last in merged((x["first"], x["last"]) for x in ranges or ()):
                    gone.update(range(first, last + 1))
                removed.append(len(gone))
                if gone and text[i] is not None:
                    text[i] = "\n".join(x for k, x in enumerate(text[i].split("\n")) if k not in gone)
                    if sizes:
                        sizes[i] = len(text[i])
            arrays[text_at] = pa.array(text, arrays[text_at].type)
            if sizes_at is not None:
                arrays[sizes_at] = pa.array(sizes, arrays[sizes_at].type)
            more = [(count, pa.array(removed, pa.int64()))] if count else []
            yield pa.RecordBatch.from_arrays([*arrays, *(x for _, x in more)], [*columns, *(c for c, _ in more)])

    out = T.StructType([*schema.fields, *([T.StructField(count, T.LongType())] if count else [])])
    return row.join(found, "id", "left").select("row", "cut").mapInArrow(run, out)
