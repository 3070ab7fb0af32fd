"""Quality rules as a short-circuit cascade.

The rules are independent predicates over one document. On a small sample each rule's cost
and rejection rate are measured, and the cascade then tries them by rejection per cost, so a
bad document is mostly settled by the cheapest telling rule. The verdict is the conjunction
of all rules and doesn't depend on the order.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, texts

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
WINDOW = 8


class Document:
    """A text with the features that the rules share; each is computed when first needed."""

    def __init__(self, data: bytes):
        self.data = data
        self.words = data.split()
        self.n_words = len(self.words)

    def count(self, among: bytes) -> int:
        return len(self.data) - len(self.data.translate(None, among))

    @cached_property
    def word_chars(self) -> int:
        """Code points that are in words: no UTF-8 continuation byte and no white space."""
        return len(self.data) - self.count(bytes(range(0x80, 0xC0))) - self.n_spaces

    @cached_property
    def n_spaces(self) -> int:
        return self.count(SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return self.count(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        lines = self.lines
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of eight words found at least twice, the first one included.

    Windows get exact ranks by doubling: pairs of words, then pairs of pairs, then of fours.
    """
    n = len(words)
    if n <= window:
        return 0
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    rank = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    step = 1
    while step < window:
        rank = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        kinds, rank = np.unique(rank, return_inverse=True)
        if len(kinds) == len(rank):
            return 0  # no shorter window repeats, so no longer one does
        step *= 2
    again = np.bincount(rank)[rank] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[: len(again)] += again
    edges[window : window + len(again)] -= again
    return int((np.cumsum(edges)[:n] > 0).sum())


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Document], bool]


#: The thresholds lie well outside what clean prose shows, so that a rule only takes junk.
RULES = (
    Rule("symbols", lambda d: d.n_symbols > 0.25 * d.n_words),
    Rule("capitals", lambda d: 10 * d.count(UPPER) > 7 * max(20, d.count(LETTERS[:52]))),
    Rule("letters", lambda d: 5 * d.count(LETTERS) < 2 * (len(d.data) - d.n_spaces)),
    Rule("loose_marks", lambda d: 5 * sum(not w.strip(MARKS) for w in d.words) > d.n_words),
    Rule("stutter", lambda d: 10 * sum(a == b for a, b in zip(d.words, d.words[1:])) > 3 * d.n_words),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 14 * d.n_words),
    Rule("dup_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


#: The base test as rules, the cheaper half apart.
BASE_RULES = (Rule("few_words", lambda d: d.n_words < 20), Rule("repeats", lambda d: base_failed(d.n_words, d.n_repeat_words)))


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 200) -> list[Rule]:
    """The rules by rejection per cost, measured on about sample_rows rows that a hash of doc_id picks.

    Each rule is timed on documents of its own, so that no feature is found ready. Only the speed of
    the cascade depends on this sample, never a verdict.
    """
    known = docs.where("text is not null")
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
    rows = known.where(key < F.lit(int((1 << 20) * min(1.0, sample_rows / max(1, docs.count()))))).select(F.col("text").cast("binary").alias("text")).collect()
    worth = {}
    for rule in rules:
        began, rejected = time.perf_counter(), 0
        for row in rows:
            rejected += bool(rule.rejects(Document(bytes(row.text))))
        worth[rule.name] = (rejected + 0.5) / (time.perf_counter() - began + 1e-6)
    return sorted(rules, key=lambda r: -worth[r.name])


def judge(document: Document, cascade: list[Rule]) -> str | None:
    """The name of the first rule of the cascade that rejects, or None."""
    return next((rule.name for rule in cascade if rule.rejects(document)), None)


def measure(docs: DataFrame) -> DataFrame:
    """One row per document with its base features, base_failed and kept.

    Null text has no words. An empty table gives no rows; repeated rows are measured one by one.
    """
    cascade = ordered_rules(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in texts(batch):
                d = Document(data)
                repeats = d.n_repeat_words
                failed = base_failed(d.n_words, repeats)
                out.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, repeats, failed, not failed and judge(d, cascade) is None))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that pass the base test and every rule; a null text has no words and fails."""
    cascade = ordered_rules(docs, BASE_RULES + RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(Document(x), cascade) is None for x in texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
