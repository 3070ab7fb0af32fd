"""Benchmark decontamination: size-partitioned MinHash containment search, JVM-side only.

An item with n distinct shingles is contained when `share` of them occur in a document. So among
any n - ceil(share * n) + 1 of its shingles one at least must occur there; the ones with the
least hashes, the item's MinHash sketch, are searched. Items are partitioned by size class, and
a class's sketch size follows from its largest size, so no item gets a shorter sketch than it
needs and the search loses nothing. Document shingles are looked up in the sketches; each
candidate pair is then verified on the shingles' own words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, few_or_none

WIDTH = 5
SHARE = 0.8
#: Rows of sketches, shingles or ids that may be broadcast, some 16 to 60 bytes each. More are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def starts(words: Column, width: int) -> Column:
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(hashes: Column, widths: list[int]) -> Column:
    """One hash for each run of as many words, in order, of each width; an empty array if there are fewer."""
    hashed = lambda width: F.transform(starts(hashes, width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    runs = list(map(hashed, widths))
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def shingle_texts(tokens: Column, widths: list[int]) -> Column:
    """The distinct runs of as many words of each width, joined by spaces."""
    joined = lambda width: F.transform(starts(tokens, width), lambda i: F.array_join(F.slice(tokens, i + 1, width), " "))
    runs = list(map(joined, widths))
    return F.array_distinct(runs[0] if len(runs) == 1 else F.concat(*runs))


def by_width(tokens: Column, shingled: Callable[[Column, list[int]], Column], width: int) -> Column:
    """An item's shingles: its only one is all of it, if it has fewer than `width` words."""
    found = shingled(tokens, [width])
    for short in range(1, width):
        found = F.when(F.size(tokens) == short, shingled(tokens, [short])).otherwise(found)
    return found


def sketches(items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """(item_id, hash): each item's least shingle hashes, as many as its size class needs."""
    hashed = items.select("item_id", word_hashes(F.col("text")).alias("hashes"))
    sized = hashed.select("item_id", F.array_sort(F.array_distinct(by_width(F.col("hashes"), shingle_hashes, width))).alias("all")).where(F.size("all") > 0)
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.size("all"))) + 1) - 1  # of the class 2^k .. 2^(k+1) - 1
    need = (F.floor(largest * (1 - share) + 1e-9) + 1).cast("int")
    return sized.select("item_id", F.explode(F.slice("all", F.lit(1), F.least(need, F.size("all")))).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of each pair with containment >= share.

    Shingles are of `width` words, distinct. An item with fewer words is one shingle, which a document contains
    if it has the same words in a row. Items without a word are in no pair, nor are null ids or texts. Rows that
    repeat an id are taken as one: an item's shingles are those of all its rows. Texts of any length are
    searched whole.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    items = items.where("item_id is not null").select("item_id", "text")
    few = lambda table: few_or_none(checkpointed(table), broadcast_rows)
    n_words = F.size(words(F.col("text")))
    short = items.select(n_words.alias("n")).where(F.col("n").between(1, width - 1)).distinct().collect()  # of width - 1 values
    widths = [width, *sorted(r.n for r in short)]
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("hashes"))
    seen = hashed.select("doc_id", F.explode(shingle_hashes(F.col("hashes"), widths)).alias("hash"))
    candidates = checkpointed(seen.join(few(sketches(items, width, share)), "hash").select("doc_id", "item_id").distinct())
    own = items.select("item_id", words(F.col("text")).alias("tokens")).select("item_id", F.explode(by_width(F.col("tokens"), shingle_texts, width)).alias("shingle")).distinct()
    ids = few_or_none(candidates.select("doc_id").distinct(), broadcast_rows)
    suspects = docs.join(ids, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("tokens"))
    there = suspects.select("doc_id", F.explode(shingle_texts(F.col("tokens"), widths)).alias("shingle"))
    # a pair that holds share of an item's shingles is a candidate, so the suspects' shingles meet all items'
    hits = there.join(few(own), "shingle").join(few_or_none(candidates, broadcast_rows), ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_found"))
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    scored = hits.join(sizes, "item_id").withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return scored.where(F.col("n_found") >= F.ceil(F.lit(share) * F.col("n_shingles") - 1e-9)).select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """The rows of docs, all columns, that contain no item. Rows without a doc_id stay."""
    found = few_or_none(checkpointed(contained(docs, items, width, share).select(F.col("doc_id").alias("_found")).distinct()))
    return docs.join(found, docs.doc_id == found._found, "left_anti")
