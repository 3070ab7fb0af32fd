"""Language-model scoring by deleted interpolation of a bigram, a unigram and a uniform model.

    p(w | v) = a_b * c(v w) / c(v) + (1 - a_b) * ((1 - u) * c(w) / N + u / (V + 1))

b is the bucket of the context's frequency c(v), in powers of two. The weights are learned by
expectation-maximisation on held-out counts: the training documents are halved by a hash of doc_id, and
each half's tokens are judged by the other half's counts over the whole corpus, bucketed by how
often the context was seen there. How far an estimate from n sightings of a context can be
trusted depends on n alone, so the weights carry over to the counts of both halves together.

Words are known by 64-bit hashes. The rows are dealt into blocks by a hash. A block counts its n-grams with numpy and asks, in sorted arrays,
the buckets of the hash range for the corpus counts; a bucket adds up what all blocks
counted and answers each block, which is then written once as numbers of its words with the counts. A frequent n-gram weighs one
array cell a block, so there is no hot key. There is a row for each block and bucket that have an n-gram in
common, so no more rows than n-grams that the blocks tell. Scores don't depend on how the rows are dealt.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from math import ceil, log10
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fold

#: Text bytes in a block, about.
BLOCK_BYTES = 8 << 20
LEVELS = 64
#: Estimates of held-out tokens are kept to a quarter of a power of two, down to 2 ** -48.
STEPS, GRID = 4, 4 * 48 + 1
START, STOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of a key inside its bucket's range. The range shrinks as buckets grow in number, so that the chance that
#: a key meets another one by its hash alone is about one in a million at every size, and one in 10^8 for a word.
KEY_BYTES = 5


class Block:
    """Texts as ids of their own vocabulary; id 0 starts a text, id 1 ends it. flags: 1 in training, 2 in the second half."""

    def __init__(self, hashes: np.ndarray, word: np.ndarray, sizes: np.ndarray, flags: np.ndarray):
        self.hashes, self.word, self.sizes, self.flags = hashes, word, sizes, flags
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.before = np.zeros_like(word)
        self.before[1:] = word[:-1]
        self.before[np.cumsum(sizes)[:-1]] = 0
        self.training, self.half = (flags[self.row] & 1).astype(bool), flags[self.row] >> 1
        pairs, self.pair_of = np.unique(self.before.astype(np.int64) * len(hashes) + word, return_inverse=True)
        left, right = np.divmod(pairs, len(hashes))
        self.pair_hashes = mixed(hashes[left], hashes[right])

    @classmethod
    def of(cls, rows: list[tuple[bytes, int]]) -> Block:
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        ids[b" start"], ids[b" stop"]
        word, sizes = [], []
        for data, _ in rows:
            words = data.lower().split()
            word += map(ids.__getitem__, words)
            word.append(1)
            sizes.append(len(words) + 1)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(map(digest, ids), np.uint64, len(ids))
        hashes[:2] = START, STOP
        return cls(hashes, np.array(word, np.int32), np.array(sizes, np.int64), np.array([f for _, f in rows], np.uint8))

    @classmethod
    def of_table(cls, texts_of: pa.Table) -> Block:
        data = texts_of.column("text").cast(pa.large_binary()).to_pylist()
        return cls.of([(x or b"", f) for x, f in zip(data, texts_of.column("flags").to_pylist())])

    def packed(self) -> bytes:
        """All but the hashes, which are needed no more once the counts are known."""
        return joined([planes(self.word), planes(self.sizes), zlib.compress(self.flags.tobytes(), 1), len(self.hashes).to_bytes(4, "little")])

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        word, sizes, flags, n = parted(data)
        return cls(np.zeros(int.from_bytes(n, "little"), np.uint64), from_planes(word, np.int32), from_planes(sizes, np.int64), np.frombuffer(zlib.decompress(flags), np.uint8))

    def own_counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hashes, counts in the two halves' training texts) of the words, then of the pairs; the start's count is that of texts."""
        found = []
        for place, hashes in ((self.word, self.hashes), (self.pair_of, self.pair_hashes)):
            found.append((hashes, np.stack([np.bincount(place[self.training & (self.half == h)], minlength=len(hashes)) for h in (0, 1)])))
        found[0][1][:, 0] = [((self.flags & 1) & (self.flags >> 1 == h)).sum() for h in (0, 1)]
        return found


def joined(parts: list[bytes]) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<u4").tobytes(), *parts])


def parted(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def planes(x: np.ndarray) -> bytes:
    """An array of numbers, compressed byte by byte of equal rank."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def dealt(docs: DataFrame, training: Column, n: int) -> DataFrame:
    """(doc_id, text, flags, block): the rows dealt into n blocks by a hash of id and text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    flags = F.coalesce(training, F.lit(False)).cast("int") + 2 * F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)).cast("int")
    return docs.select("doc_id", "text", flags.alias("flags"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")).repartition(n, "block")


def edges(buckets: int) -> list[int]:
    """The least key of each bucket, the hash range dealt evenly, and the range's end."""
    return [(i << 64) // buckets for i in range(buckets + 1)]


def kept_bits(buckets: int) -> np.uint64:
    """How many low bits a key's place in its bucket's range loses."""
    return np.uint64(max(0, 65 - buckets.bit_length() - 8 * KEY_BYTES))


def pack_keys(keys: np.ndarray, low: int, buckets: int) -> bytes:
    return ((keys - np.uint64(low)) >> kept_bits(buckets)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """Counts in two halves (2 x n), in as few bytes each as the largest one needs."""
    wide = 8 if x.max(initial=0) >= 1 << 32 else 4
    return bytes([wide]) + planes(x.astype(f"<u{wide}").ravel())


def unpack_counts(data: bytes) -> np.ndarray:
    return from_planes(data[1:], np.dtype(f"<u{data[0]}")).astype(np.int64).reshape(2, -1)


def requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, keys, counts) of every block's words, in buckets from `buckets` on, and pairs, in those before."""
    bounds = edges(buckets)
    lows = np.array(bounds[:-1], np.uint64)

    def run(texts_of: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for first, (hashes, counts) in zip((buckets, 0), Block.of_table(texts_of).own_counts()):
            order = np.argsort(hashes)
            keys, counts = hashes[order], counts[:, order]
            at = [*np.searchsorted(keys, lows).tolist(), len(keys)]
            rows += [(first + k, texts_of.column("block")[0].as_py(), pack_keys(keys[a:b], bounds[k], buckets), pack_counts(counts[:, a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "block", "keys", "counts"])

    return blocks.groupBy("block").applyInArrow(run, "bucket int, block int, keys binary, counts binary")


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, counts, first, second, words): the corpus counts of what each block asked for, in its order.

    One row of each bucket also has the bucket's tokens in each half and its distinct words, starts left out; the others have zeros.
    """

    def run(bucket: pa.Table) -> pa.Table:
        of = bucket.column("bucket")[0].as_py()
        keys = [unpack_keys(x) for x in bucket.column("keys").to_pylist()]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack_counts(x) for x in bucket.column("counts").to_pylist()], 1)
        total = np.stack([np.bincount(place, half, len(distinct)).astype(np.int64) for half in counts])
        out = [pack_counts(total[:, p]) for p in np.split(place, np.cumsum([len(k) for k in keys])[:-1])]
        told = [0, 0, 0]
        if of >= buckets:
            start = start_key(of, buckets)
            words = total if start is None else total[:, distinct != start]
            told = [*words.sum(1).tolist(), int((words.sum(0) > 0).sum())]
        return pa.table({"block": bucket.column("block"), "bucket": bucket.column("bucket"), "counts": pa.array(out, pa.binary())} | {k: pa.array([v] + [0] * (len(out) - 1), pa.int64()) for k, v in zip(("first", "second", "words"), told)})

    return asked.groupBy("bucket").applyInArrow(run, "block int, bucket int, counts binary, first long, second long, words long")


def start_key(bucket: int, buckets: int) -> np.uint64 | None:
    """The start's key in a bucket of words, if it is in its range."""
    bounds = edges(buckets)[bucket - buckets : bucket - buckets + 2]
    return unpack_keys(pack_keys(np.array([START]), bounds[0], buckets))[0] if bounds[0] <= int(START) < bounds[1] else None


def told(block: Block, replies: list[bytes], buckets: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts (2 x n) by word id and by pair, from a block's replies."""
    found = []
    for hashes, pick in ((block.hashes, lambda k: k >= n), (block.pair_hashes, lambda k: k < n)):
        counts = [unpack_counts(x) for k, x in sorted(zip(buckets, replies), key=lambda x: x[0]) if pick(k)]
        back = np.empty((2, len(hashes)), np.int64)
        back[:, np.argsort(hashes)] = np.concatenate(counts, 1)
        found.append(back)
    return found[0], found[1]


def level(contexts: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency; contexts never seen are in bucket 0."""
    return np.minimum(np.frexp(contexts.astype(np.float64))[1], LEVELS - 1)


def cell(p: np.ndarray) -> np.ndarray:
    """Place on the grid: 0 for no chance, GRID - 1 for certainty."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(GRID - 1 + STEPS * np.log2(p)), 1, GRID - 1), 0).astype(np.int64)


def centre(cells: np.ndarray) -> np.ndarray:
    return np.where(cells > 0, 2.0 ** ((cells - (GRID - 1)) / STEPS), 0.0)


def held_out(block: Block, words: np.ndarray, pairs: np.ndarray, tokens: tuple[int, int]) -> np.ndarray:
    """A cell (level, bigram estimate, unigram estimate) for each training token, by the other half's counts."""
    pick = block.training
    other, word, before, pair = 1 - block.half[pick], block.word[pick], block.before[pick], block.pair_of[pick]
    seen = words[other, before]
    p2 = pairs[other, pair] / np.maximum(seen, 1)
    p1 = words[other, word] / np.maximum(np.array(tokens)[other], 1)
    return (level(seen) * GRID + cell(p2)) * GRID + cell(p1)


def mixture_weights(statistics: dict[int, int], vocabulary: int, rounds: int = 60) -> tuple[np.ndarray, float]:
    """(bigram weight by level, share of the uniform model in the rest) by EM over tokens by held-out cell.

    A level that no held-out token reached takes the weight of the next lower one that was.
    """
    cells = np.array(sorted(statistics), np.int64)
    n = np.array([statistics[c] for c in cells.tolist()], float)
    at, rest = np.divmod(cells, GRID * GRID)
    p2, p1, p0 = centre(rest // GRID), centre(rest % GRID), 1.0 / (vocabulary + 1)
    bigram, uniform = np.full(LEVELS, 0.5), 0.05
    bigram[0] = 0.0
    seen = np.bincount(at, n, LEVELS)
    for _ in range(rounds if len(cells) else 0):
        a = bigram[at]
        total = a * p2 + (1 - a) * ((1 - uniform) * p1 + uniform * p0)
        from_bigram = n * a * p2 / total
        from_uniform = n * (1 - a) * uniform * p0 / total
        bigram = np.minimum(0.999, np.where(seen > 0, np.bincount(at, from_bigram, LEVELS) / np.maximum(seen, 1), bigram))
        uniform = min(0.999, max(1e-12, from_uniform.sum() / max(1e-9, (n - from_bigram).sum())))
    for k in range(1, LEVELS):
        if not seen[k]:
            bigram[k] = bigram[k - 1]
    return bigram, uniform


class Learned(NamedTuple):
    """What a scorer needs besides counts: training tokens in each half, distinct words, mixture weights."""

    tokens: tuple[int, int]
    vocabulary: int
    bigram: np.ndarray
    uniform: float


def settled(blocks: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """(doc_ids, data, first, second, words) of every block: its texts with the corpus counts of their words and pairs."""

    def run(texts_of: pa.Table, replies_to: pa.Table) -> pa.Table:
        block = Block.of_table(texts_of)
        words, pairs = told(block, replies_to.column("counts").to_pylist(), replies_to.column("bucket").to_pylist(), buckets)
        ids = texts_of.column("doc_id").combine_chunks()
        sums = {c: pa.array([sum(replies_to.column(c).to_pylist())], pa.int64()) for c in ("first", "second", "words")}
        return pa.table({"doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "data": [joined([block.packed(), pack_counts(words), pack_counts(pairs)])]} | sums)

    schema = T.StructType().add("doc_ids", T.ArrayType(blocks.schema["doc_id"].dataType)).add("data", "binary").add("first", "long").add("second", "long").add("words", "long")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def known(data: bytes) -> tuple[Block, np.ndarray, np.ndarray]:
    """A settled block, with the counts (2 x n) of its words and pairs."""
    block, words, pairs = parted(data)
    return Block.unpacked(block), unpack_counts(words), unpack_counts(pairs)


def learn(met: DataFrame) -> Learned:
    """Corpus size and mixture weights, from settled blocks."""
    first, second, words = (x or 0 for x in met.agg(F.sum("first"), F.sum("second"), F.sum("words")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict[int, int] = defaultdict(int)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                cells, n = np.unique(held_out(*known(data), (first, second)), return_counts=True)
                for c, k in zip(cells.tolist(), n.tolist()):
                    found[c] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["cell", "n"])

    # at most LEVELS x GRID x GRID cells, however large the input
    statistics = dict(met.select("data").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    return Learned((first, second), words, *mixture_weights(statistics, words))


def scored(docs: DataFrame, training: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A token is a word (A-Z in lower case) or the text's end; null text is an end alone. base_score
    adds log10((c + 1) / (N + V + 1)); score is the interpolated model's log10 probability. If no
    row is for training, c and N are 0 and both models are uniform. Repeated rows count again. A null doc_id
    is in training if `training` says so, and comes back as null. A text of any length is in one block.
    """
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil(volume / block_bytes))
    blocks = dealt(docs, training, n)  # one exchange: both who asks and who is answered read it
    replies = answers(requests(blocks, n).repartition(2 * n, "bucket"), n)
    met = checkpointed(settled(blocks, replies.repartition(n, "block"), n))
    m = learn(met)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in enumerate(batch.column(1).to_pylist()):
                block, words, pairs = known(data)
                words, pairs = words.sum(0), pairs.sum(0)
                tokens, rows = sum(m.tokens), len(block.sizes)
                seen = words[block.before]
                words[0] = 0  # the start is no token
                c = words[block.word]
                base = np.log10(c + 1.0) - log10(tokens + m.vocabulary + 1)
                a = m.bigram[level(seen)]
                low = (1 - m.uniform) * c / tokens + m.uniform / (m.vocabulary + 1) if tokens else np.full(len(c), 1 / (m.vocabulary + 1))
                p = a * pairs[block.pair_of] / np.maximum(seen, 1) + (1 - a) * low
                add = lambda x: pa.array(np.bincount(block.row, x, rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at].values, pa.array(block.sizes), pa.array(np.bincount(block.row, c > 0, rows).astype(np.int64)), pa.array(np.full(rows, tokens, np.int64)), add(base), add(np.log10(p))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return met.select("doc_ids", "data").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def contract_training(folds: int = 7, held: int = 2) -> Column:
    """Training rows: crc32 of doc_id as text leaves another remainder than `held`."""
    return fold(folds) != held
