"""SentencePiece encoding (BPE with byte fallback) by vectorised merge rounds, and decoding.

A text is cut between two characters that no piece holds side by side; no merge can cross such a place, so the words between cuts
are encoded alone, and one that was met before is looked up. New words become one flat array of symbols. In a round every pair of
neighbours has the rank of the piece that it would make; the least rank of each word is found by a segmented minimum whose ties go
to the leftmost pair, all words merge theirs at once, and the array is compacted. A word without a pair is done and leaves.
One merge a word and round keeps the order in which the library merges, also where a later piece has a better rank than an earlier one.

A word of over LONG symbols (text in which every two neighbours occur in some piece) would need as many rounds; it is merged
with a heap instead, to the same result in n log n. Memory is bounded by the texts of one batch, MEMO words and the vocabulary.
Null and empty texts have no ids; repeated rows are encoded again; other columns of the table aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Symbols of a word from which on a heap takes the place of rounds; words that a process remembers; characters encoded at once.
LONG, MEMO, AT_ONCE = 256, 200_000, 4 << 20
NONE = np.iinfo(np.int64).max
#: Texts on which a model must agree with its library, else it normalises or splits in a way that isn't supported.
PROBES = ("", " ", "  a  b", "Café ① ﬁ\n\tx", "日本語 \U0001f642 ก", "é Ａ　z", "1234 <s> ab")


class Pieces:
    """A model's vocabulary as symbols, pairs and their merges. Symbols are piece ids; characters that are no piece but part of one have ids above them."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = library.get_piece_size()
        kinds = (library.is_control, library.is_unknown, library.is_byte)
        special = [any(kind(i) for kind in kinds) for i in range(self.size)]
        if any(library.is_unused(i) for i in range(self.size)):
            raise ValueError("models with unused pieces aren't supported")
        pieces = {library.id_to_piece(i): i for i in range(self.size) if not special[i]}
        self.byte = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        symbols = dict(pieces)
        for piece in pieces:
            for c in piece:
                symbols.setdefault(c, self.size + len(symbols))
        scores = np.array([library.get_score(i) for i in range(self.size)])
        rank = np.unique(-scores, return_inverse=True)[1]
        merges = sorted(
            (symbols[p[:k]] << 32 | symbols[p[k:]], int(rank[i]), i)
            for p, i in pieces.items() if len(p) > 1
            for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        )
        self.pairs, self.ranks, self.made = (np.array([m[j] for m in merges] + [NONE if j < 2 else 0], np.int64) for j in range(3))
        self.merge = {m[0]: m[1:] for m in merges}
        self.symbol = np.full(0x110000, -1, np.int64)
        for text, i in symbols.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        # neighbours inside pieces, by numbers of the characters in pieces of two or more; 0 for any other character
        inner = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.number = np.zeros(0x110000, np.uint16 if len(inner) < 65535 else np.uint32)
        self.number[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in pieces:
            at = self.number[[ord(c) for c in p]]
            self.beside[at[:-1], at[1:]] = True
        self.surface = [b"" if special[i] else library.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.size)]
        for b, i in enumerate(self.byte):
            self.surface[i] = bytes([b])
        unknown = library.unk_id()
        self.surface[unknown] = library.decode([unknown]).encode()
        self.spaced = {i for i in range(self.size) if library.id_to_piece(i).startswith(SPACE)}
        self.skipped = {i for i in range(self.size) if library.is_control(i)}
        self.memo: dict[str, bytes] = {}
        for text, ids in zip(PROBES, self.encode(PROBES)):
            if ids.tolist() != library.encode(text):
                raise ValueError(f"{path} isn't a BPE model with byte fallback, a space before the text and no normalisation")

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair's merge; rank NONE if it makes no piece."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        found = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], NONE), self.made[at]

    def rounds(self, symbols: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
        """The merged symbols of each word; word numbers symbols' words from 0, without gaps."""
        out: list[np.ndarray] = [symbols[:0]] * (int(word[-1]) + 1 if len(word) else 0)
        rank, made = self.ranked(symbols, np.append(symbols[1:], -1)[: len(symbols)])
        rank[np.append(word[1:] != word[:-1], True)[: len(word)]] = NONE
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            place = np.arange(len(symbols))
            keyed = np.where(rank == NONE, NONE, rank << 31 | place)
            least = np.minimum.reduceat(keyed, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done = least == NONE
            for k in np.flatnonzero(done).tolist():
                out[word[starts[k]]] = symbols[starts[k] : starts[k] + sizes[k]]
            at = least[~done] & (1 << 31) - 1
            symbols[at] = made[at]
            stay = np.repeat(~done, sizes)
            stay[at + 1] = False
            # the pair of a merged symbol and its new neighbour, and that of the symbol before it
            rank[at] = rank[at + 1]
            kept = np.cumsum(stay) - 1
            at = kept[at]
            symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
            for side in (at, at[at > 0] - 1):
                right = np.minimum(side + 1, len(symbols) - 1)
                same = (right > side) & (word[right] == word[side])
                rank[side], made[side] = self.ranked(symbols[side], np.where(same, symbols[right], -1))
        return out

    def heaped(self, symbols: list[int]) -> list[int]:
        """One word's merged symbols, the best pair first, of equal ones the leftmost."""
        n, merge = len(symbols), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> tuple[int, int, int] | None:
            j = after[i]
            found = merge.get(symbols[i] << 32 | symbols[j]) if j < n and symbols[i] >= 0 and symbols[j] >= 0 else None
            return found and (found[0], i, found[1])

        heap = [x for x in map(pair, range(n)) if x]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x[1]
            if symbols[i] is None or pair(i) != x:
                continue
            j = after[i]
            symbols[i], symbols[j], after[i] = x[2], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := pair(k)):
                    heappush(heap, x)
        return [s for s in symbols if s is not None]

    def ids_of(self, word: str, symbols: Iterable[int]) -> bytes:
        """Ids of a word's symbols as 32-bit numbers; what is no piece becomes its UTF-8 bytes' pieces."""
        symbols = np.asarray(symbols, np.int64)
        if len(symbols) and symbols.max() < self.size and symbols.min() >= 0:
            return symbols.astype(np.int32).tobytes()
        out, at = [], 0
        for s in symbols.tolist():
            if 0 <= s < self.size:
                out.append(s)
                at += len(self.surface[s].decode())
            else:
                out += self.byte[list(word[at].encode("utf-8", "replace"))].tolist()
                at += 1
        return np.array(out, np.int32).tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words."""
        found, short = {}, []
        for w in words:
            if len(w) > LONG:
                found[w] = self.ids_of(w, self.heaped(self.symbol[points(w)].tolist()))
            else:
                short.append(w)
        flat = self.symbol[points("".join(short))]
        for w, merged in zip(short, self.rounds(flat, np.repeat(np.arange(len(short)), [len(w) for w in short]))):
            found[w] = self.ids_of(w, merged)
        return found

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text; the words of all of them that are new are learned together."""
        words = [[w for part in self.parts(SPACE + text.replace(" ", SPACE)) for w in self.words(part)] if text else [] for text in texts]
        met = set().union(*words)
        fresh = [w for w in met if w not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo, fresh = {}, list(met)
        self.memo |= self.learn(fresh)
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, some)), np.int32) for some in words]

    def parts(self, text: str) -> Iterator[str]:
        """The text in stretches of about AT_ONCE characters, parted at places that no piece crosses."""
        start = 0
        while len(text) - start > AT_ONCE:
            end = start + AT_ONCE
            while end < len(text) and self.beside[self.number[ord(text[end - 1])], self.number[ord(text[end])]]:
                end += 1
            yield text[start:end]
            start = end
        yield text[start:]

    def words(self, text: str) -> list[str]:
        number = self.number[points(text)]
        ends = [*(np.flatnonzero(~self.beside[number[:-1], number[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library tells it: begin and end ids go, so does the space before the text; bytes that are no UTF-8 become U+FFFD each."""
        runs = [ids] if self.skipped.isdisjoint(ids) else [list(run) for skip, run in groupby(ids, self.skipped.__contains__) if not skip]
        texts = []
        for k, run in enumerate(runs):
            data = b"".join(map(self.surface.__getitem__, run))
            data = data[1:] if k == 0 and run and run[0] in self.spaced else data
            try:
                texts.append(data.decode())
            except UnicodeDecodeError:
                texts.append(self.mended(data))
        return "".join(texts)

    def mended(self, data: bytes) -> str:
        """Bytes in which some sequence is broken, one U+FFFD a byte that begins no whole character."""
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of docs (doc_id, text): ids without begin and end, and the text that they decode to."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: told(batches, path, False), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): `encoded` as digests, of the decimal ids joined by commas and of the decoded text."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: told(batches, path, True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def told(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    decimal = [str(i).encode() for i in range(model.size)]
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = batch.slice(start, 256)
            ids = [x.tolist() for x in model.encode(x or "" for x in rows.column(1).to_pylist())]
            texts = map(model.decode, ids)
            if digest:
                columns = [pa.array(map(len, ids), pa.int64()), pa.array([sha(b",".join(map(decimal.__getitem__, x))) for x in ids], pa.string()), pa.array([sha(x.encode()) for x in texts], pa.string())]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
