"""Packing of token streams into fixed-length sequences, in order, by dynamic programming.

Documents keep their order. Windows are cut at document ends or sentence ends (anywhere only
inside a sentence longer than a window). With prefix lengths P and a penalty for each kind of
cut, the least cost of a packing that ends at boundary j is

    best[j] = min over i, P[j] - P[i] <= size, of best[i] + (size - (P[j] - P[i])) + penalty[j]

The minimum is that of best[i] + P[i] over a sliding window of boundaries, kept in a monotone
queue, so a pass takes linear time. Each partition of the input packs its own documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from struct import pack
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

SIZE = 4096
END = 2
#: Cost, in padding tokens, of a cut inside a document, and of one inside a sentence.
CUT_DOCUMENT, CUT_SENTENCE = 24.0, 400.0
#: Tokens that one pass of the dynamic programming takes in; the last window is carried over.
BLOCK_TOKENS = 1 << 20
#: Encoded pieces that a memory turns over at, and the bytes of text that are encoded at once.
CACHE, AT_ONCE = 100_000, 2 << 20
#: Words that the model takes in at once.
WORDS_AT_ONCE = 8192
#: A word of Latin letters and the marks after it, which are a unit each. `<|` begins a special token, so neither is among the marks.
WORD = "^(?P<word>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)(?P<marks>[!-/:;=-@\\[-`{}~]*)$"
#: How a piece ends that ends a sentence.
STOPS = "[.!?][\"')]?$"
#: Fixed values of the tokenizer: its rules, the units that they cut a text into (letters, a digit, an
#: English ending, marks), and the characters for which this pattern is sure to agree with them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
UNIT = re.compile(r"[^\W\d_]+|\d|'(?:[stmd]|re|ve|ll)|(?:[^\s\w]|_)+")
UNSURE = re.compile(r"[^\u0000-\u001B\u0020-\u00B1\u00B4-\u00B8\u00BA\u00BB\u00BF-\u012F\u0131-\u024F\u0400-\u0481\u048A-\u052F\u2000-\u206F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]")


class Memory(dict):
    """Values of a function by key. When full, what it holds becomes the older half, which is
    forgotten at the next turn but for the keys asked for meanwhile."""

    def __init__(self, function: Callable, size: int):
        super().__init__()
        self.function, self.size, self.older = function, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def several(self, keys: list, function: Callable[[list], list]) -> list:
        """Values of the keys; `function` gives those that aren't known together."""
        values = list(map(self.get, keys))
        gaps = [i for i, value in enumerate(values) if value is None]
        for i in gaps:
            values[i] = self.older.get(keys[i])
        unknown = [i for i in gaps if values[i] is None]
        for i, value in zip(unknown, function([keys[i] for i in unknown])):
            values[i] = value
        for i in gaps:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[keys[i]] = values[i]
        return values


class Encoder:
    """Token ids of a text, by the pieces between white space, which recur and so are remembered, within bounds.

    The tokenizer lower-cases, drops white space, cuts the text into runs of letters, single digits
    and runs of marks, and applies its byte-level BPE model to each of these units; no token spans
    white space. Most pieces are a word and marks: the words that aren't remembered are lower-cased and given to the model together,
    as one text. A piece with a special token's marks, or with characters whose class or case isn't
    settled, goes through the whole tokenizer. So does every text if the file's rules aren't these.
    """

    def __init__(self, path: str, memory: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        marked = all(t["special"] and t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in rules["added_tokens"])
        self.by_pieces = marked and (rules["normalizer"], rules["pre_tokenizer"], rules["post_processor"], rules["model"]["type"]) == (NORMALIZER, PRE_TOKENIZER, None, "BPE")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [c for c in range(256) if c not in visible]
        self.shown = {c: chr(c) for c in visible} | {c: chr(256 + k) for k, c in enumerate(hidden)}
        self.pieces = Memory(self.piece, memory)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, data: bytes) -> bytes:
        if data.isalpha() and data.islower():  # ASCII letters
            return self.unit(data.decode())
        text = data.decode("utf-8", "replace")
        if "<|" in text or UNSURE.search(text):
            return self.whole(text)
        units = UNIT.findall((text if text.isascii() else normalize("NFC", text)).lower())
        if len(units) != 1:
            return b"".join([self.pieces[u.encode()] for u in units])
        return self.unit(units[0] if data.isalnum() else "".join(map(self.shown.__getitem__, units[0].encode())))

    def unit(self, shown: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return pack(f"<{len(ids)}I", *ids)

    def words(self, known: list[bytes]) -> list[bytes]:
        """Ids of units without white space, by one call of the model for many."""
        out = []
        for at in range(0, len(known), WORDS_AT_ONCE):
            some = [w.decode() if w.isascii() else "".join(map(self.shown.__getitem__, w)) for w in known[at : at + WORDS_AT_ONCE]]
            found = self.model.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def codes(self, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all of the pieces in a row, and how many each has."""
        parts = pc.extract_regex(known, WORD)
        plain = parts.is_valid()
        word, marks = (pc.struct_field(parts, [k]).filter(plain) for k in ("word", "marks"))
        word, marks = pc.utf8_lower(word).dictionary_encode(), marks.dictionary_encode()
        of_word = self.pieces.several(listed(word.dictionary), self.words)
        of_marks, others = (list(map(self.pieces.__getitem__, listed(x))) for x in (marks.dictionary, known.filter(pc.invert(plain))))
        parts_ids = [*of_word, *of_marks, *others, b""]
        size = np.fromiter(map(len, parts_ids), np.int64, len(parts_ids)) // 4
        held = np.full((len(known), 2), len(parts_ids) - 1)  # the one or two of them that make up a piece
        is_plain = plain.to_numpy(zero_copy_only=False)
        held[is_plain] = np.stack([word.indices.to_numpy(), len(of_word) + marks.indices.to_numpy()], 1)
        held[~is_plain, 0] = len(of_word) + len(of_marks) + np.arange(len(others))
        return gathered(np.frombuffer(b"".join(parts_ids), "<u4"), size, held.ravel()), size[held].sum(1)

    def encode(self, column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """Of each text: little-endian 32-bit ids, and how many ids there are up to each sentence's end."""
        if not self.by_pieces:
            yield from ((self.whole(text), np.zeros(0, np.int64)) for text in column.fill_null("").to_pylist())
            return
        split = pc.ascii_split_whitespace(column.fill_null(""))
        flat = split.flatten().dictionary_encode()
        codes, code_size = self.codes(flat.dictionary)
        at = flat.indices.to_numpy()
        ends = np.cumsum(code_size[at])
        ids = gathered(codes, code_size, at)
        stops = ends[pc.match_substring_regex(flat.dictionary, STOPS).to_numpy(zero_copy_only=False)[at]]
        bounds = np.append(0, ends)[split.offsets.to_numpy()]
        stop_at = np.searchsorted(stops, bounds, "right")
        for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), stop_at[:-1].tolist(), stop_at[1:].tolist()):
            yield ids[a:b].tobytes(), stops[i:j] - a


def listed(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def gathered(values: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs at the places `at` one after another; `size` has the lengths of the runs that make up values."""
    wanted = size[at]
    first = (np.cumsum(size) - size)[at] - (np.cumsum(wanted) - wanted)
    return values[np.repeat(first, wanted) + np.arange(wanted.sum())]


def portions(column: pa.Array, most: int = AT_ONCE) -> Iterator[pa.Array]:
    """The column in slices of about `most` bytes of text; a longer text is a slice of its own."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, upto - at)
        at = upto


def cuts(ends: np.ndarray, kinds: np.ndarray, size: int = SIZE, penalties: tuple[float, float] = (CUT_DOCUMENT, CUT_SENTENCE)) -> list[int]:
    """Positions after which a window ends, of the cheapest packing of a stream.

    ends: increasing positions where cuts are allowed, at most `size` apart, the last one the
    stream's end. kinds: 0 a document's end, 1 a sentence's, 2 neither.
    """
    at = [0, *ends.tolist()]
    penalty = [0.0, *np.array([0.0, *penalties])[kinds].tolist()]
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        best[j] = best[i] + at[i] + size - here + penalty[j]
        value = best[j] + here
        while queue and best[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts and their kinds: document ends, sentence ends, and for stretches longer than
    a quarter window without either, positions inside."""
    ends = merged(doc_ends, sentence_ends)
    gaps = np.diff(ends, prepend=0)
    step = max(1, size // 4)
    inner = [np.arange(e - g + step, e, step) for e, g in zip(ends[gaps > step].tolist(), gaps[gaps > step].tolist())]
    if inner:
        ends = merged(ends, np.concatenate(inner))
    kinds = np.full(len(ends), 2)
    kinds[np.searchsorted(ends, sentence_ends)] = 1
    kinds[np.searchsorted(ends, doc_ends)] = 0
    return ends, kinds


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct numbers of both in order."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


class Packer:
    """Takes documents in order and gives pieces as soon as their windows are settled."""

    def __init__(self, prefix: int, size: int = SIZE):
        self.prefix, self.size, self.made = prefix, size, 0
        self.open: list[list] = []  # doc_id, ids, tokens already placed, sentence ends
        self.waiting = 0

    def add(self, doc_id, ids: bytes, sentence_ends: np.ndarray) -> Iterator[tuple]:
        self.open.append([doc_id, ids, 0, sentence_ends])
        self.waiting += len(ids) // 4
        if self.waiting >= BLOCK_TOKENS:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple]:
        """All but the last window of what is waiting, or everything."""
        if not self.open:
            return
        left = np.array([len(ids) // 4 - done for _, ids, done, _ in self.open])
        doc_ends = np.cumsum(left)
        sentences = [start - done + stops[(stops > done) & (stops < len(ids) // 4)] for start, (_, ids, done, stops) in zip((doc_ends - left).tolist(), self.open)]
        ends, kinds = boundaries(doc_ends, np.concatenate(sentences).astype(np.int64), self.size)
        windows = cuts(ends, kinds, self.size)
        if not last:
            windows = windows[:-1]
        d, at = 0, 0
        for end in windows:
            sequence, offset = (self.prefix << 33) + self.made, 0
            self.made += 1
            while at < end:
                doc_id, ids, done, _ = self.open[d]
                total = len(ids) // 4
                n = min(end - at, total - done)
                yield doc_id, done, n, zlib.crc32(ids[4 * done : 4 * (done + n)]), total, sequence, offset
                at, offset = at + n, offset + n
                self.open[d][2] = done + n
                d += done + n == total
        del self.open[:d]
        self.waiting -= at


#: One encoder a Python worker, so that its cache outlives a task.
ENCODERS: dict[tuple[str, int], Encoder] = {}


def packed(docs: DataFrame, tokenizer_path: str, size: int = SIZE, memory: int = CACHE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then END; null and empty texts are END alone. Every row of
    docs is packed, so a repeated row is packed again, and a null doc_id comes back as null. A
    window holds at most `size` tokens; only a partition's last window and windows that a sentence
    would overflow are short. The input's partitions are packed in their order, without a shuffle.
    memory: pieces that a process remembers, about 200 bytes each and twice as many at most; it has no effect on the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer_path, memory) not in ENCODERS:
            ENCODERS[tokenizer_path, memory] = Encoder(tokenizer_path, memory)
        encoder = ENCODERS[tokenizer_path, memory]
        packer = Packer(TaskContext.get().partitionId(), size)
        kind, end = None, np.array([END], "<u4").tobytes()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.column(0).type
            ids_of, at = batch.column(0).to_pylist(), 0
            for part in portions(batch.column(1)):
                rows = []
                for doc_id, (ids, stops) in zip(ids_of[at : at + len(part)], encoder.encode(part)):
                    rows += packer.add(doc_id, ids + end, stops)
                at += len(part)
                yield table(rows)
        if kind is not None:
            yield table(list(packer.pack(last=True)))

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
