"""Collocations: phrases of two and three words that occur far more often than their parts would together.

Level by level, as Apriori does: words are counted, then pairs, then triples. A level's pass over the texts takes the double-array trie
of all frequent shorter phrases of each language by broadcast. In a block of texts numpy advances the states of all positions at once,
one word a step; where both the phrase without its last word and that without its first are accepted, the position holds an Apriori-safe
candidate, which is the state it ended in and the next word. These are counted by bincount in the block, and the blocks' counts
are added up by phrase. Candidates are those that the texts hold: pairs of frequent words as a product would not fit anywhere.

A trie is broadcast only if it has at most FEW phrases, which their count is checked for. With more of them nothing is ruled out
beforehand: the block counts all its phrases, which costs a larger exchange and gives the same result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, looked_up

#: Phrases of a trie that may be broadcast (some 16 bytes a slot, and the words); text bytes of a block.
FEW, BLOCK_BYTES = 2_000_000, 6 << 20
#: Rows that one join key may bring to a task.
HOT = 100_000
#: A word's number is two symbols below DIGIT, so that no node has more children.
DIGIT = 2048
#: Ends of a piece become a word of their own, which no word can be: all white space but the tab ends pieces.
STOP = b"."
CLEAN = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")


class DoubleArray(NamedTuple):
    """A trie over number sequences: the child of slot s by symbol c is slot base[s] + c, if that slot's check is s. Slot 0 is the root."""

    base: np.ndarray
    check: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Each state's child by its symbol; -1 for none, for the state -1 and for a negative symbol."""
        at = self.base[state] + symbol
        fits = (state >= 0) & (symbol >= 0) & (at > 0) & (at < len(self.check))
        at = np.where(fits, at, 0)
        return np.where(fits & (self.check[at] == state), at, -1)

    @classmethod
    def of(cls, rows: np.ndarray) -> DoubleArray:
        """The trie of the rows of a table of symbols below DIGIT; -1 fills up shorter rows.

        Nodes with more children are placed first, each at the first of some spread offsets at which all its children's slots are free; those
        with one child fill slots that are left.
        """
        node, parents, symbols, n = np.zeros(len(rows), np.int64), [], [], 1
        for column in rows.T:
            there = np.flatnonzero(column >= 0)
            edges, which = np.unique(node[there] << 32 | column[there], return_inverse=True)
            node[there] = n + which
            parents.append(edges >> 32)
            symbols.append(edges & (1 << 32) - 1)
            n += len(edges)
        parent, symbol = (np.concatenate([np.zeros(1, np.int64), *x]) for x in (parents, symbols))  # ascending by parent
        starts = np.searchsorted(parent[1:], np.arange(n)) + 1
        sizes = np.diff(np.append(starts, n))
        base, used = np.zeros(n, np.int64), np.zeros(3 * n + 2 * DIGIT, bool)
        used[0] = True
        spread = np.arange(64) * 40503
        for tries, k in enumerate(np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist()):
            codes, turn = symbol[starts[k] : starts[k] + sizes[k]], tries * 64
            while True:
                shifts = (spread + turn * 40503) % (len(used) - DIGIT)
                fits = ~used[shifts[:, None] + codes].any(1)
                if fits.any():
                    break
                turn += 64
                if turn > tries * 64 + 64 * 32:
                    used, turn = np.append(used, np.zeros_like(used)), tries * 64
            base[k] = shifts[fits.argmax()]
            used[base[k] + codes] = True
        single = np.flatnonzero(sizes == 1)
        base[single] = np.flatnonzero(~used)[: len(single)] - symbol[starts[single]]
        slot = base[parent] + symbol
        slot[0] = 0
        size = int(slot.max()) + 1
        bases, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        bases[slot], check[slot] = base, slot[parent]
        return cls(bases, check)


class Trie:
    """Frequent phrases by language; words and languages are numbers."""

    def __init__(self, langs: pa.Array, phrases: pa.Array):
        split = pc.split_pattern(phrases, " ")
        offsets, lengths = split.offsets.to_numpy(), pc.list_value_length(split).to_numpy()
        words, own = split.flatten().dictionary_encode(), langs.dictionary_encode()
        self.vocabulary, self.langs = words.dictionary, {x: k for k, x in enumerate(own.dictionary.to_pylist())}
        if max(len(self.langs), len(self.vocabulary)) > DIGIT * DIGIT:
            raise ValueError("too many words for a trie")
        table, numbers = [own.indices.to_numpy()], words.indices.to_numpy()
        for k in range(int(lengths.max(initial=0))):
            has = lengths > k
            table.append(np.full(len(lengths), -1, np.int32))
            table[-1][has] = numbers[offsets[:-1][has] + k]
        digits = [x for column in table for x in (np.where(column < 0, -1, column // DIGIT), np.where(column < 0, -1, column % DIGIT))]
        self.array = DoubleArray.of(np.stack(digits, 1))

    @cached_property
    def words(self) -> dict[bytes, int]:
        """Words' numbers, made where they are asked for."""
        return {w: k for k, w in enumerate(self.vocabulary.cast(pa.binary()).to_pylist())}

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.array.step(self.array.step(state, np.where(word < 0, -1, word // DIGIT)), word % DIGIT)

    def states(self, lang: str, words: np.ndarray, length: int) -> np.ndarray:
        """At each position the state of the phrase of `length` words from there on; -1 if it isn't in the trie."""
        root = self.step(np.zeros(1, np.int64), np.array([self.langs.get(lang, -1)]))
        state = np.repeat(root, len(words))
        for k in range(length):
            state = self.step(state, np.append(words[k:], np.full(min(k, len(words)), -1)))
        return state


def words_of(text: bytes) -> list[bytes]:
    """Words and, between them, the ends of pieces."""
    return text.lower().translate(CLEAN).replace(b".", b" . ").split(b" ")


def block_counts(lang: str, texts: list[bytes], length: int, trie: Trie | None) -> tuple[pa.Array, np.ndarray, int]:
    """(phrases, their counts, words) of a block of one language."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    ids[STOP], ids[b""]
    numbered = [np.fromiter(map(ids.__getitem__, words_of(text + STOP)), np.int32) for text in texts]
    flat = np.concatenate(numbered)
    flat = flat[flat != 1].astype(np.int64)  # empty words between two spaces
    vocabulary = list(ids)
    if length == 1:
        counts = np.bincount(flat, minlength=len(vocabulary))
        counts[:2] = 0
        some = np.flatnonzero(counts)
        return pa.array(vocabulary, pa.binary()).take(pa.array(some)), counts[some], int(counts.sum())
    if trie:
        known = np.array([trie.words.get(w, -1) for w in vocabulary])
        state = trie.states(lang, known[flat], length - 1)
        following = np.append(state[1:], -1)
        at = np.flatnonzero((state >= 0) & (following >= 0))
        head = state[at]
    else:
        stop = flat == 0
        inside = ~stop
        for k in range(1, length):
            inside &= np.append(~stop[k:], np.zeros(min(k, len(stop)), bool))
        at = np.flatnonzero(inside)
        head = np.unique(np.stack([flat[at + k] for k in range(length - 1)]), axis=1, return_inverse=True)[1].ravel() if len(at) else at
    _, first, of = np.unique(head * len(vocabulary) + flat[at + length - 1], return_index=True, return_inverse=True)
    counts = np.bincount(of, minlength=len(first))
    names = pa.array(vocabulary, pa.binary())
    parts = [names.take(pa.array(flat[at[first] + k])) for k in range(length)]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())), counts, 0


def counted(docs: DataFrame, length: int, trie: Broadcast | None = None) -> DataFrame:
    """(lang, phrase, f): occurrences of phrases of `length` words, those that the trie rules out left out; the phrase '' has the number of words."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def block(texts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, some in texts.items():
            phrases, counts, words = block_counts(lang, some, length, trie and trie.value)
            told = [phrases.cast(pa.string()), pa.array(counts, pa.int64())]
            if words:
                told = [pa.concat_arrays([told[0], pa.array([""])]), pa.concat_arrays([told[1], pa.array([words])])]
            for start in range(0, len(told[0]), 65536):
                part = [x.slice(start, 65536) for x in told]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *part], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                if text:
                    texts.setdefault(lang, []).append(text)
                    size += len(text)
                if size > BLOCK_BYTES:
                    yield from block(texts)
                    texts, size = {}, 0
        yield from block(texts)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    # a block tells a phrase once, so there is nothing for a partial aggregate to add up before the exchange
    return rows.mapInArrow(run, "lang string, phrase string, f long").repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def broadcast_trie(*frequent: DataFrame) -> Broadcast | None:
    """The trie of all phrases of checkpointed tables, if there are few enough."""
    if sum(x.count() for x in frequent) > FEW:
        return None
    rows = pa.concat_tables([x.where("phrase <> ''").select("lang", "phrase").toArrow() for x in frequent])
    return frequent[0].sparkSession.sparkContext.broadcast(Trie(*(rows.column(c).combine_chunks() for c in ("lang", "phrase"))))


def frequent_phrases(docs: DataFrame, least: int) -> list[DataFrame]:
    """Checkpointed (lang, phrase, f) of the words, pairs and triples that occur `least` times; among the words, '' has their number."""
    levels: list[DataFrame] = []
    for length in (1, 2, 3):
        trie = broadcast_trie(*levels) if levels else None
        found = counted(docs, length, trie)
        levels.append(checkpointed(found.where((F.col("f") >= least) | (F.col("phrase") == ""))))
        if trie:
            trie.unpersist()
    return levels


def collocations(docs: DataFrame, least: int = 10, covers: int = 50, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of two or three words among docs (lang, text).

    A phrase counts a occurrences, `least` or more, inside pieces between `.,;:!?` and line ends. Each cut into two parts, with l and r occurrences, scores
    floor(10^6 a^2 / (l r)); the lowest, then the earliest, counts. A pair inside a triple with `covers` percent of its occurrences or more
    is left out. Order: score, a, both falling, phrase in UTF-8 byte order. Arithmetic is exact below 10^15 occurrences. Null texts have no words, a null
    lang is und, repeated rows count again, other columns aren't read; without any phrase the result is empty.
    """
    words, pairs, triples = frequent_phrases(docs, least)
    # a part's count bounds the number of candidates that it is part of, so it tells the hot keys
    counts = words.where("phrase <> ''").unionByName(pairs).select("lang", "phrase", "f", F.col("f").alias("n"))

    def with_part(rows: DataFrame, part, name: str) -> DataFrame:
        keyed = rows.withColumn("part", part)
        return looked_up(keyed, counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias(name), "n"), ["lang", "part"], HOT).drop("part", "n")

    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    inner = triples.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    open_pairs = pairs.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {covers} * f").drop("longer")
    both = with_part(with_part(open_pairs, first, "l1"), last, "r1").select("lang", "phrase", "f", "l1", "r1", F.lit(None).cast("long").alias("l2"), F.lit(None).cast("long").alias("r2"))
    for part, name in ((first, "l1"), (F.substring_index("phrase", " ", -2), "r1"), (F.substring_index("phrase", " ", 2), "l2"), (last, "r2")):
        triples = with_part(triples, part, name)
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    score = lambda l, r: F.expr(f"cast(1000000 as decimal(7, 0)) * ({wide('f')} * {wide('f')}) div ({wide(l)} * {wide(r)})")
    scored = both.unionByName(triples).withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    second = F.col("s2") < F.col("s1")
    pick = lambda a, b: F.when(second, F.col(b)).otherwise(F.col(a))
    rows = scored.select("lang", "phrase", F.col("f").alias("a"), pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    total = words.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # a row a language
