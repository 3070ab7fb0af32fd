"""Prefix trie, SentencePiece and phrases: against the library, plain loops and hand-made cases."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from lumenseq.llm import phrases, prefix_trie, sentence_pieces
from lumenseq.llm.queries import PIECES, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


def odd_texts(library, n: int) -> list[str]:
    rng = random.Random(7)
    chars = "aaabbbeeettthhh   \n\t▁éß日本語\U0001f642①ﬁ́​.,<>0x1A\x00"
    vocabulary = [library.id_to_piece(i) for i in range(300, 32000)]
    loose = lambda: "".join(rng.choice(chars) for _ in range(rng.randint(0, 60)))
    joined = lambda: "".join(rng.choice(vocabulary)[: rng.randint(1, 9)] for _ in range(rng.randint(1, 14))).replace("▁", rng.choice(["", " "]))
    return ["", " ", "   ", "a" * 700, " " * 300, "ab" * 400 + "é"] + [rng.choice([loose, joined])() for _ in range(n)]


@pytest.mark.parametrize("longest, at_once", [(256, 4 << 20), (3, 4 << 20), (256, 17)])
def test_pieces_encode_as_the_library_does(library, monkeypatch, longest, at_once):
    monkeypatch.setattr(sentence_pieces, "LONG", longest)
    monkeypatch.setattr(sentence_pieces, "AT_ONCE", at_once)
    model = sentence_pieces.Pieces(tokenizer_path(PIECES))
    texts = odd_texts(library, 2000)
    assert [x.tolist() for x in model.encode(texts)] == library.encode(texts)


def test_pieces_decode_as_the_library_does(library):
    model, rng = sentence_pieces.pieces(tokenizer_path(PIECES)), random.Random(3)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999), 259, 28705]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_pieces_of_a_table(spark, library):
    docs = spark.createDataFrame([(1, "Hello  world", 5), (1, "Hello  world", 5), (2, None, 1), (None, "", 1), (3, "x " * 30000, 0)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, sentence_pieces.digests(docs, tokenizer_path(PIECES)).collect()), key=str)
    told = lambda i, t: (i, len(x := library.encode(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest())
    assert rows == sorted([told(1, "Hello  world"), told(1, "Hello  world"), told(2, ""), told(None, ""), told(3, "x " * 30000)], key=str)
    found = {r.doc_id: r for r in sentence_pieces.encoded(docs, tokenizer_path(PIECES)).collect()}
    assert found[3].decoded == "x " * 30000 and found[2].ids == []
    assert sentence_pieces.digests(docs.limit(0), tokenizer_path(PIECES)).count() == 0


def plain_trie(conversations: list[tuple]) -> set[tuple]:
    """The contract's rows, by walking every conversation's prefixes."""
    turns: dict[int, list] = {}
    for c, turn, role, text in conversations:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in turns.items()}
    built = {c: tuple(own.get(c - c % 100, [])[: (h := crc32(str(c).encode()) % 6)] + x[h:]) for c, x in own.items()}
    members: dict[tuple, list[int]] = {}
    for c, x in sorted(built.items()):
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    kids = Counter(x[:-1] for x in members if x)
    leaves, saved = Counter(), Counter()
    for x, m in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += not kids[x]
            saved[x[:d]] += (len(m) - 1) * len(x[-1][1]) if x else 0
    ends = lambda x: hashlib.sha256(",".join(str(c) for c in members[x] if len(built[c]) == len(x)).encode()).hexdigest()
    return {(m[0], len(x), members[x[:-1]][0] if x else None, len(m), kids[x], leaves[x], saved[x], ends(x)) for x, m in members.items()}


@pytest.mark.parametrize("most", [1, 2, 7, 4096])
def test_trie_equals_a_plain_walk(spark, monkeypatch, most):
    monkeypatch.setattr(prefix_trie, "MOST_CONVERSATIONS", most)
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", None, "bot"]), rng.choice(["hi", "", None, "hé", "a\tb"])) for c in rng.sample(range(900), 250) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "same") for c in range(1000, 1090) for t in (0, 1)]  # copies of one conversation, in several blocks
    rows += [(205, None, "user", "first"), (205, 3, "a", "tie"), (205, 3, "a", "tie"), (205, 3, "a", "eit"), (None, 1, "user", "lost"), (301, 1, "x", "y" * 5000)]
    rows += [(700, t, "user", f"turn {t}") for t in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumnRenamed("x", "y")
    found = prefix_trie.nodes(prefix_trie.grafted(prefix_trie.sequences(table.repartition(5))))
    assert found.columns == prefix_trie.COLUMNS
    got = [tuple(r) for r in found.collect()]
    want = plain_trie(rows)
    assert len(got) == len(want) and set(got) == want
    if most == 1:
        assert prefix_trie.nodes(prefix_trie.grafted(prefix_trie.sequences(table.limit(0)))).count() == 0


def plain_phrases(rows: list[tuple], least: int, most: int) -> list[tuple]:
    import re

    f: Counter = Counter()
    n: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = {}
    for p, a in candidates.items():
        if len(p) == 4:
            for q in (p[:3], (p[0], *p[2:])):
                longer[q] = max(longer.get(q, 0), a)
    best: dict[str, list] = {}
    for p, a in candidates.items():
        if 100 * longer.get(p, 0) >= 50 * a:
            continue
        cuts = [(1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        best.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return [(lang, i, w.decode(), -a, l, r, n[lang], -s) for lang, some in best.items() for i, (s, a, w, l, r) in enumerate(sorted(some)[:most], 1)]


@pytest.mark.parametrize("few, hot", [(2_000_000, 100_000), (0, 100_000), (2_000_000, 5)])
def test_phrases_equal_plain_counts(spark, monkeypatch, few, hot):
    monkeypatch.setattr(phrases, "FEW", few)
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    rng = random.Random(5)
    words = ["der", "DER", "und", "É", "é", "New", "york", "city", "a b", "x\x1cy", "ß"] + [f"w{i}" for i in range(20)]
    text = lambda: "".join(rng.choice(words[: rng.choice([5, 12, 31])]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", "!"]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "en", "en", "und", None, "", "fr"]), text() + rng.choice(["", "new york city", "New York"])) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, "..."), ("xx", "alone")] + rows[:40] + [("en", "la la la la " * 3000)]
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "phrase long, lang string, text string, rank int").repartition(4)
    got = sorted(map(tuple, phrases.collocations(docs, most=50).collect()))
    assert got == sorted(plain_phrases(rows, 10, 50)) and len(got) > 100
    if not few:
        assert phrases.collocations(docs.limit(0)).count() == 0


def test_double_array_holds_its_rows_and_no_other():
    rng = np.random.default_rng(0)
    draw = lambda n: np.minimum(rng.zipf(1.3, n), 50_000)
    rows = np.unique(np.stack([draw(20_000), draw(20_000)], 1), axis=0).tolist()
    trie = phrases.Trie(pa.array(["en"] * len(rows)), pa.array([f"{a} {b}" for a, b in rows]))
    known, asked = set(map(tuple, rows)), draw(20_000)
    state = trie.states("en", np.array([trie.words.get(str(x).encode(), -1) for x in asked]), 2)
    assert (state >= 0).tolist() == [pair in known for pair in zip(asked.tolist(), [*asked[1:].tolist(), -1])]
    assert (trie.states("fr", np.array([0, 1]), 1) < 0).all()
