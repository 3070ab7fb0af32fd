"""The training-data operators against brute force, and on odd input."""

import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenseq.llm import decontaminate, html_text, language_id, license_scan, line_dedup, lm_score, packing, quality_rules, queries, simhash, toxicity
from lumenseq.llm.components import forest
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, gram int, fp string, _found int"
LONG = "One fine long line of words " * 12
ODD = [
    (1, None, None, None, None, 1, "x", 2), (2, "", "en", "s", 0, 1, "x", 2), (2, "", "en", "s", 0, 1, "x", 2), (3, LONG, "en", None, None, 1, None, 2),
    (4, LONG, "en", "s", 9, None, "x", None), (None, LONG, None, "s", 9, 1, "x", 2), (5, "... \x0b\t", "en", "s", 9, 1, "x", 2), (6, "word " * 30000, "de", "s", 9, 1, "x", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


def test_quality(spark, odd, empty):
    found = quality_rules.measure(odd).collect()
    assert len(found) == len(ODD) and {r.n_words for r in found if r.doc_id in (1, 2)} == {0} and not any(r.kept for r in found if r.doc_id in (1, 2, 6))
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.measure(empty).count() == quality_rules.keep_good(empty).count() == 0
    words = [random.Random(5).choice([b"a", b"b"]) for _ in range(300)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(293))
    assert quality_rules.repeat_words(words) == len({p for i in range(293) if grams[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)})


def test_similar_texts(spark, odd, empty):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    changed = lambda n: " ".join(f"x{i}" if i % (400 // n) == 7 and i // (400 // n) < n else w for i, w in enumerate(base))
    texts = {1: " ".join(base), 2: changed(2), 3: changed(4), 4: changed(20), 5: " ".join(base).upper(), 6: "other words " + changed(50)}
    shingles = {k: set(simhash.shingles(v.encode(), 5).tolist()) for k, v in texts.items()}
    near = {(a, b) for a in texts for b in texts if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])}
    assert (1, 3) in near and (1, 4) not in near
    found = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    assert {(a, b) for a in found for b in found if found[a] == found[b]} == near
    assert simhash.similar(odd).count() == len(ODD) and simhash.similar(empty).count() == simhash.keep_one(empty).count() == 0


def test_similar_tests_every_candidate_between_classes(spark):
    """Two groups of near copies that only two texts between them join; the other pairs across are about 0.65 to 0.76 alike."""
    rng, texts = random.Random(2), {}
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(400)]
        turned = {at: f"g{g}t{at}" for at in range(5, 400, 28)}
        for side in range(2):
            for _ in range(40):
                words = [turned.get(i, w) if side else w for i, w in enumerate(base)]
                words[rng.randrange(400)] = f"u{rng.random()}"
                texts[len(texts) + 1] = " ".join(words)
        for n in (5, 10):
            some = list(turned)[:n]
            texts[len(texts) + 1] = " ".join(turned[i] if i in some else w for i, w in enumerate(base))
    found = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    assert found == {i: (i - 1) // 82 * 82 + 1 for i in texts}


@pytest.mark.parametrize("few", [16, 1])
def test_similar_is_exact_beside_the_limit(spark, few):
    """Pairs 0.75 to 0.85 alike, and groups of variants of one text, as by comparison of all shingle sets."""
    rng, texts = random.Random(6), {}
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(400)]
        for n in (0, 7 + g % 5) if g < 120 else [rng.randrange(1, 7) for _ in range(12)]:
            changed = {(start + 400 // n * k) % 400 for start in [rng.randrange(400)] for k in range(n)} if n else ()
            texts[len(texts) + 1] = " ".join(f"u{rng.random()}" if i in changed else w for i, w in enumerate(base))
    sets = {k: set(simhash.shingles(v.encode(), 5).tolist()) for k, v in texts.items()}
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    want = forest((a, b) for a in sets for b in sets if a <= b and b - a < 12 and alike(sets[a], sets[b]))
    found = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), few=few).collect()}
    assert found == want and 180 < len(set(want.values())) < len(texts)


def test_similar_takes_what_fingerprints_bring_together(spark):
    """Two texts 0.8 alike that share no band of their sketches, but all 64 bits of their fingerprints but four."""
    seed = 324735
    words = [f"w{seed}n{i}" for i in range(22)]
    texts = [" ".join(words), " ".join([*words[:20], f"x{seed}", f"y{seed}"])]
    hashes = [simhash.shingles(x.encode(), 5) for x in texts]
    first, second = (simhash.minima(np.unique(x), simhash.MINIMA)[:252].reshape(36, 7) for x in hashes)
    assert not (first == second).all(1).any() and (simhash.majority(hashes[0]) ^ simhash.majority(hashes[1])).bit_count() <= 4
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, "a text of other words")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]


@pytest.mark.parametrize("limits", [{}, {"hot": 2}, {"hot": 2, "block": 8}, {"hot": 2, "block": 2, "midpoints_from": 1}, {"hot": 9, "block": 4, "midpoints_from": 0}])
def test_simhash_links_all(spark, limits):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres[:6]:
        for _ in range(40):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in values)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(frame, 4, **limits), few=0).collect()}
    assert found == {r.node: r.root for r in simhash.components(simhash.links(frame, 4, **limits)).collect()}
    want = forest((a, b) for a in signed for b in signed if a <= b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert all(found.get(x, x) == want[x] for x in signed)


def test_near_duplicates(spark, odd, empty):
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (5, 5), (3, 3), (4, 3), (None, 3)} - found <= {(5, 5)}
    assert sorted(r.doc_id for r in simhash.keep_one(odd).where("doc_id is not null").collect()) in ([1, 3, 5, 6], [1, 3, 6])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.fingerprint(b"") == 0


def test_lines(spark, odd, empty):
    cut = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.without_repeats(odd).collect()}
    assert {(3, LONG, 0), (4, "", 1), (None, LONG, 0), (1, None, 0)} <= cut and len(line_dedup.without_repeats(odd).columns) == len(odd.columns) + 1
    assert line_dedup.without_repeats(empty).count() == 0
    shared = "\n".join(f"shared line {i} with some more words in it" for i in range(9))
    docs = spark.createDataFrame([(1, "top a\n" + shared + "\nend a"), (2, "top b\n\n" + shared + "\nend b"), (3, "just one\nshared line 3 with some more words in it")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()} == {1: "top a\n" + shared + "\nend a", 2: "top b\n\nend b", 3: "just one\nshared line 3 with some more words in it"}


def test_clashing_columns(spark):
    names = ["doc_id", "text", "cut", "row", "id", "_cut_id", "_cuts", "n_removed", "d", "_id", "_key", "fp", "root"]
    docs = spark.createDataFrame([(i, LONG, *"abcdefghijk") for i in (1, 2)], names)
    found = line_dedup.without_repeats(docs)
    assert sorted(found.columns) == sorted(names) and sorted((r.doc_id, r.text, r.n_removed, r.root) for r in found.collect()) == [(1, LONG, 0, "k"), (2, "", 1, "k")]
    assert [tuple(r) for r in line_dedup.without_repeats(docs, count=None).where("doc_id = 1").collect()] == [(1, LONG, *"abcdefghijk")]
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, LONG, *"abcdefghijk")]


def test_texts_with_one_id_are_different_documents(spark):
    docs = spark.createDataFrame([(1, "one text of some words here"), (1, "quite another text with other words"), (2, "one text of some words here"), (1, "one text of some words here")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(docs).collect()) == ["one text of some words here", "quite another text with other words"]


def test_whole_passages_go(spark):
    long, short = ("\n".join(" ".join(f"{k}{i}" for i in range(n)) for k, n in ks) for ks in ([("a", 100), ("b", 20)], [("c", 20), ("d", 40), ("e", 8)]))
    docs = spark.createDataFrame([(1, f"{long}\n{short}\none"), (2, long), (3, f"two\n{short}\nthree")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SF).collect()} == {1: f"{long}\n{short}\none", 2: "", 3: "two\nthree"}
    rng = random.Random(8)
    pool = [" ".join(f"v{i}_{k}" for k in range(rng.choice([0, 3, 12, 20, 60]))) for i in range(60)]
    texts = {}
    for i in range(40):
        starts = [rng.randrange(50) for _ in range(5)]
        texts[i] = [x for s in starts for x in [*pool[s : s + rng.randrange(1, 10)], f"own {i} {s}"]]
    found = {r.doc_id: r.text for r in line_dedup.without_repeats(spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string")).collect()}
    seen, want = set(), {}
    for i, x in texts.items():  # every run of full lines with 50 words or more, against all that start before
        full, gone = [k for k, line in enumerate(x) if line], set()
        for s in range(len(full)):
            runs = [tuple(x[k] for k in full[s:e]) for e in range(s + 1, len(full) + 1) if sum(len(x[k].split()) for k in full[s:e]) >= 50]
            for run in runs:
                gone |= set(range(full[s], full[s + len(run) - 1] + 1)) if run in seen else set()
            seen.update(runs)
        want[i] = [line for k, line in enumerate(x) if line and k not in gone]
    assert {i: [line for line in x.split("\n") if line] for i, x in found.items()} == want


@pytest.mark.parametrize("limit", [10, 0])
def test_contained(spark, odd, empty, limit):
    item = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, None), (3, "too Short"), (4, ". !"), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " * 500 + item.upper() + " after"), (2, item.replace("w15", "other")), (3, " ".join(item.split()[:20])), (4, None), (5, "far too  short, that is"), (6, "too little and short"), (None, item)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.n_found for r in decontaminate.contained(docs, items, broadcast_rows=limit).collect()}
    assert found == {(1, 1): 26, (2, 1): 21, (5, 3): 1}
    assert decontaminate.clean(docs, items).count() == 4 and decontaminate.clean(empty, items).count() == 0 and decontaminate.clean(odd, items.limit(0)).count() == len(ODD)


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    found = packing.packed(odd, path, 64).toPandas()
    assert found.length.sum() == sum(len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)
    by_sequence = found.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_sequence.length.sum() <= 64).all() and all((g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() for _, g in by_sequence)
    assert packing.packed(empty, path).count() == 0
    encoder = packing.Encoder(path)
    for text in ("It's <|endoftext|> A_b--c 12½ É ΣΑΣ 日本 don't!", "a\x1cb\x85c", "İstanbul é"):
        assert np.frombuffer(next(encoder.encode(pa.array([text])))[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    encoder.by_pieces = False
    assert np.frombuffer(next(encoder.encode(pa.array(["Any text"])))[0], "<u4").tolist() == whole.encode("Any text", add_special_tokens=False).ids


@pytest.mark.parametrize("memory", [packing.CACHE, 3])
def test_new_words_are_encoded_together(memory, monkeypatch):
    """Words that aren't remembered go to the model in one text; ids are the whole tokenizer's."""
    rng, alone = random.Random(4), []
    monkeypatch.setattr(packing.Encoder, "unit", lambda self, shown, unit=packing.Encoder.unit: alone.append(shown) or unit(self, shown))
    encoder = packing.Encoder(queries.tokenizer_path(), memory)
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250))]
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 12))) + rng.choice(["", "", ".", ",", '."', "***", "_", "'", "<|", "|>"]) for _ in range(20000)]
    odd = [f.format(chr(c)) for c in (*range(0x21, 0x250), 0x3B1, 0x301, 0x4E2D) for f in ("{}", "a{}", "{}B.", "A{}b", "a{}'s", "ab{0}{0}", "ab.{}!", "<|{}|>x")]
    texts = [" ".join(words), " ".join(odd), None, "", " \n", *odd[:300], " ".join(reversed(words[:99]))]
    found = [np.frombuffer(ids, "<u4").tolist() for ids, _ in encoder.encode(pa.array(texts))]
    assert found == [encoder.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    del alone[:]
    assert sum(len(ids) for ids, _ in encoder.encode(pa.array([" ".join(f"{w}q" for w in words if w.isalpha())]))) and len(alone) < 100


@pytest.mark.parametrize("size", [4096, 100])
def test_packed_pieces_are_the_tokens(spark, size):
    """start, length, ids_crc32, doc_tokens of every piece against the whole tokenizer; each id once, sequences without gaps."""
    from tokenizers import Tokenizer

    whole, docs = Tokenizer.from_file(queries.tokenizer_path()), spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    found = packing.packed(docs, queries.tokenizer_path(), size).toPandas()
    for r in found.itertuples():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids[r.doc_id]))
    taken = found.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert all((g.start.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() == len(ids[i]) for i, g in taken)
    sequences = found.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= size for _, g in sequences)
    if size == 4096:
        assert found.length.sum() > 0.9 * size * found.sequence_id.nunique()


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(40):
        ends = sorted(rng.sample(range(1, 40), 12))
        ends = [e for e in ends] + [40]
        kinds = [rng.randrange(3) for _ in ends]
        penalty, size = [0, 24, 400], 16
        best = {0: 0.0}
        for e, k in zip(ends, kinds):
            options = [best[s] + size - (e - s) + penalty[k] for s in best if e - s <= size]
            if options:
                best[e] = min(options)
        if 40 not in best or any(b - a > size for a, b in zip([0, *ends], ends)):
            continue
        got = packing.cuts(np.array(ends), np.array(kinds), size)
        cost = sum(size - (b - a) + penalty[kinds[ends.index(b)]] for a, b in zip([0, *got], got))
        assert cost == best[40]


def test_lm(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lm_score.scored(docs, lm_score.contract_training()).collect()
    texts = {r.doc_id: r.text.encode().lower().split() + [b" stop"] for r in docs.collect()}
    train = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    for r in found:
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in texts[r.doc_id]))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(texts[r.doc_id]), sum(w in train for w in texts[r.doc_id]), n)
    out = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    # the model by its definition: corpus counts of both halves, held-out cells, EM, interpolation
    key = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id").cast("string")), F.lit(2))
    half = {r.doc_id: r.half for r in docs.select("doc_id", key.alias("half")).collect()}
    pairs = {i: list(zip([b" start", *ws], ws)) for i, ws in texts.items()}
    trained = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi, ctx = ([Counter() for _ in (0, 1)] for _ in range(3))
    for i in trained:
        uni[half[i]].update(texts[i])
        bi[half[i]].update(pairs[i])
        ctx[half[i]].update(x for x, _ in pairs[i])
    cells, level = Counter(), lambda c: c.bit_length()
    for i in trained:
        o = 1 - half[i]
        for x, w in pairs[i]:
            c = ctx[o][x]
            p2, p1 = (int(lm_score.cell(np.array([p]))[0]) for p in (bi[o][x, w] / max(c, 1), uni[o][w] / sum(uni[o].values())))
            cells[level(c), p2, p1] += 1
    weight, uniform = lm_score.mixture_weights({(k * lm_score.GRID + p2) * lm_score.GRID + p1: n for (k, p2, p1), n in cells.items()}, v)
    assert 0 < uniform < 1 and 0 < weight[1] < 1
    for r in found[::7]:
        score = 0.0
        for x, w in pairs[r.doc_id]:
            c, both, single = (sum(y[k] for y in z) for z, k in ((ctx, x), (bi, (x, w)), (uni, w)))
            a = weight[level(c)]
            score += math.log10(a * both / max(c, 1) + (1 - a) * ((1 - uniform) * single / n + uniform / (v + 1)))
        assert r.score == pytest.approx(score, rel=1e-9)
    again = lm_score.scored(docs.repartition(7), lm_score.contract_training(), block_bytes=60_000).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in found}, rel=1e-12)
    assert lm_score.scored(odd, F.lit(True)).count() == len(ODD) and lm_score.scored(empty, F.lit(True)).count() == 0
    assert all(math.isfinite(r.score) for r in lm_score.scored(odd, F.lit(False)).collect())


def test_em_finds_the_likeliest_weights():
    """Against a search over the weights of one context level and the uniform share."""
    g = lm_score.GRID
    cells = {(3 * g + p2) * g + p1: n for p2, p1, n in ((0, g - 40, 50), (g - 1, g - 30, 30), (g - 5, 0, 15), (0, 0, 5))}
    weight, uniform = lm_score.mixture_weights(cells, 1000, rounds=3000)

    def likelihood(a, u):
        value = 0.0
        for c, n in cells.items():
            p2, p1 = (float(lm_score.centre(np.array([x]))[0]) for x in (c // g % g, c % g))
            value += n * math.log(a * p2 + (1 - a) * ((1 - u) * p1 + u / 1001))
        return value

    best = likelihood(weight[3], uniform)
    assert all(likelihood(a, u) <= best + 1e-6 for a in np.linspace(0.01, 0.99, 60) for u in np.linspace(0.001, 0.99, 60))


def test_language(spark, odd, empty):
    found = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (found[found.held_out].lang == found[found.held_out].lang_pred).mean() > 0.95 and found.score.between(0, 1).all()
    x, k = language_id.to_windows("été à la plage ".encode() * 40), language_id.Network(language_id.train(np.random.default_rng(1).integers(32, 127, (40, 256)).astype(np.uint8), np.arange(40) % 2, ["a", "b"], epochs=1))
    pooled = [np.array([[max(float(sum(t[o, w[i + o], f] for o in range(len(t)))) for i in range(256 - len(t) + 1)) for f in range(t.shape[2])] for w in x]) for t in k.model.filters]
    logits = np.maximum(np.concatenate(pooled, 1) + k.model.bias, 0) @ k.model.dense + k.model.dense_bias
    assert np.allclose(k.log_probabilities(x), np.log(language_id.softmax(logits)), atol=1e-4)  # the network by its definition
    assert [p for p, _ in k.predict(["½ ² Ⅷ ① 12 _ !".encode(), b""])] == ["und", "und"] and k.predict(["é".encode()])[0][0] != "und"
    net = language_id.learn(odd)
    assert {r.lang_pred for r in language_id.identify(odd, net).where("doc_id in (1, 2, 5)").collect()} == {"und"}
    assert language_id.learn(empty) is None and {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_html_parts_inside_the_article():
    kept = "<h1>Head</h1><p class=byline>By A <time>1 May</time></p><p>A long text of the article that says much and more, and then some more for all.</p>"
    want = html_text.main_text(f"<body><article>{kept}</article></body>")
    for name in ("comment-body", "user-comments", "reader-comments", "comment__author", "adsbygoogle", "cookie-banner", "comments-section", "newsletter-signup-form", "google-ads", "cookie-notice"):
        assert html_text.main_text(f"<body><article>{kept}<div class='{name}'><p>gone</p></div></article></body>") == want, name
    for name in ("related-work", "ad-hoc", "no-comments", "entry-content", "author-bio", "commentary"):
        assert html_text.main_text(f"<body><article>{kept}<div class='{name}'><p>stays</p></div></article></body>") == want + "\nstays", name
    unit = "<{0}><b class=user>Ann</b><p>Good one</p><a href=#>{1}</a></{0}>"
    for tag, around, word in (("li", "ul", "Reply"), ("section", "div", "Antworten"), ("div", "div", "(Répondre)")):
        units = unit.format(tag, word) * 2
        assert html_text.main_text(f"<body><article>{kept}<h3>2 Comments</h3><{around}>{units}</{around}><p>Advertisement</p></article></body>") == want
    alone = html_text.main_text(f"<body><article>{kept}{unit.format('div', 'Reply')}</article></body>")
    assert "Good one" in alone  # one such part may be the author's own


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; tail</h1><p>One  two<br>three.<p>Four</p><div id=comments><p>Nice!</p></div></article><footer>f</footer>"
    assert html_text.main_text(page) == "Head & tail\nOne two three.\nFour"
    kept = "<section id='discussion'><p>All of this is said here.</p></section><h2 id='related-work'>Related work</h2><p class='share-price'>The price.</p><h3 id='notice-of-terms'>Terms</h3><p>A <math><mi>x</mi></math> and a <label>label</label></p>"
    gone = "<div class='ad-slot left'>Buy it</div><ul class='related'><li><a href=1>One</a><li><a href=2>Two</a></ul><section class='comment-list'><p>First!</p></section>"
    assert html_text.main_text(f"<body><article>{kept}{gone}</article></body>") == "All of this is said here.\nRelated work\nThe price.\nTerms\nA x and a label"
    long = "A sentence of an article that goes on for a while, with words and more words. " * 5
    both = f"<body><nav><a href=1>Home</a></nav><div><h1>Head</h1><article><p>{long}</p></article><article><p>{long}</p></article></div><div><a href=2>more</a> links</div></body>"
    assert html_text.main_text(both) == "\n".join(["Head", long.strip(), long.strip()])
    began = time.time()
    assert html_text.main_text("<div>" * 40000 + "deep") == "deep" and time.time() - began < 5
    frame = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 1), (2, "u", page, 1), (3, "u", "<p" * 2000 + "x", 1), (4, "u", "<div>" * 3000 + "deep", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_text.extracted(frame).collect()}
    assert got[1] == got[None] == "" and got[4] == "deep" and html_text.extracted(frame.limit(0)).count() == 0


def test_density_by_its_definition():
    """Characters, tags, link characters and density of every node of random trees, recursively."""
    rng = random.Random(3)

    def tree(depth):
        tag = rng.choice(["div", "section", "b", "a", "span"])
        inner = "".join(rng.choice([lambda: " ".join(["word"] * rng.randrange(9)), lambda: tree(depth - 1)])() for _ in range(rng.randrange(4))) if depth else "text here"
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(40):
        root = html_text.parse("<body>" + tree(5) + tree(5) + "</body>")
        scored = {id(x): x for x in html_text.score(root)}

        def measure(node, in_link=False):
            in_link = in_link or node.tag == "a"
            own = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
            found = [own, own * in_link, 0, 0]
            for child in node.parts:
                if not isinstance(child, str):
                    c, lc, t, lt = measure(child, in_link)
                    found = [found[0] + c, found[1] + lc, found[2] + t + 1, found[3] + lt + (child.tag == "a")]
            sizes[id(node)] = found
            return found

        sizes = {}
        c0, lc0, _, _ = measure(root)
        for key, (c, lc, t, lt) in sizes.items():
            want = c / max(t, 1) * math.log(max(1, c / max(lc, 1) * max(t, 1) / max(lt, 1))) / math.log(max(1 + 1e-9, math.log(c / max(1, c - lc) * lc + lc0 / max(c0, 1) * c + math.e))) if c else 0.0
            assert scored[key].density == pytest.approx(want, rel=1e-6, abs=1e-6)
            assert scored[key].total == pytest.approx(sum(scored[id(x)].density for x in scored[key].parts if not isinstance(x, str)))


def test_license_fields_need_a_sign():
    scan = lambda text: license_scan.Scanner().scan(text.encode())[5]
    for text in ("Die License mit guten Wörtern", "driver license ruby and vim", "He has the php license", "a license mit\nguten Wörtern", "my license vim", ""):
        assert scan(text) == "", text
    for text, label in (
        ("License: MIT", "mit"), ('"license": "MIT",', "mit"), ("# License\n\nMIT\n", "mit"), ("License (Ruby)", "ruby"), ("license = 'Vim'", "vim"), ("under the PHP License", "php-3"), ("the PHP License version 3.01", "php-3"),
        ("Lizenz steht hier. License: BSD-3-Clause", "bsd-3-clause"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"), ("See https://opensource.org/licenses/MIT.", "mit"), ("Apache License v2.0 with LLVM Exceptions", "apache-2-llvm"),
        ("GPL-2.0 WITH Linux-syscall-note", "gpl-2-linux"), ("Mulan PSL v2", "mulan"), ("Gemma Terms of Use", "gemma"),
    ):
        assert label in scan(text).split(","), (text, scan(text))
    began = time.time()
    assert scan("license mit und license: MIT " * 40000) == "mit" and time.time() - began < 10


def detected(scanner, text):
    """All that the rules find in a text, before suppression."""
    words = " ".join(re.findall("[a-z0-9]+", text.lower()))
    found = [(m, r) for r in scanner.rules if all(need & set(words.split()) for need in r.keywords) for m in r.pattern.finditer(words)]
    return [(m.start(), m.end(), r.label) for m, r in found]


def test_license_signatures_stand_by_their_words():
    kept, scanner = license_scan.SIGNATURES.strip().split("\n"), license_scan.Scanner()
    assert len(kept) >= 190
    for line in kept:  # each keyword is a word that the pattern can't do without
        label, needs, priority, score, pattern = line.split(" | ")
        assert any(re.search(rf"(?<![a-z]){k}(?![a-z])", pattern) for k in needs.split("|")) and 0 < float(score) <= 1, line
        plain = re.sub(r"\((?:\?:|\?P<field>)([^()|]*)\|?[^()]*\)", r"\1", re.sub(r"\(\?:[^()]*\)[?*]", "", pattern.replace(r"(?:\w+ ){1,8}", "some ")))
        if re.fullmatch("[a-z0-9 ]+", plain):  # the first wording of a signature without further operators is found in a text
            assert label in {x[2] for x in detected(scanner, f"So: {plain.replace('license ', 'license: ', 1) if 'field' in pattern else plain}.")}, line


def test_licenses(spark, odd, empty):
    scan = license_scan.Scanner().scan
    assert scan(b"x under the MIT License, under the MIT license")[:5] == (9, 2, 1, 5, "mit")
    assert scan(b"GNU Lesser General Public License, version 3 or later")[5] == "lgpl-3"
    assert scan(b"SPDX-License-Identifier: BSD-3-Clause")[5] == "bsd-3-clause"
    assert "cc-by-nc" in scan(b"CC BY-NC 4.0")[4] and scan(b"mit der Katze")[5] == ""
    grants = b"licensed under the apache license version 2 or under the mit license " * 4000
    assert scan(grants)[:4] == (48000, 8000, 3, 47996)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():  # the base columns word by word
        words = [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if w]
        places = sorted((i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        got = scan((r.text or "").encode())
        assert got[:5] == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert {x for x in got[4].split(",") if x} <= set(got[5].split(",")) and 0 <= got[6] <= 1
    assert license_scan.scanned(odd).count() == len(ODD) and license_scan.scanned(empty).count() == 0 and len(license_scan.rules()) > 200


def test_suppression_by_containment():
    """What stays, against the definition: by falling priority, and inside no kept interval."""
    scanner, rng = license_scan.Scanner(), random.Random(4)
    phrases = ["licensed under the gnu lesser general public license version 3 or later", "gnu general public license", "cc by nc sa 4 0", "mit license", "apache license version 2 0", "bsd 3 clause license", "all rights reserved", "some other words"]
    for _ in range(60):
        text = " ".join(rng.choice(phrases) for _ in range(rng.randrange(1, 9)))
        found = [(m.start(), m.end(), r) for r in scanner.rules if all(need & set(text.split()) for need in r.keywords) for m in r.pattern.finditer(text)]
        kept = []
        for start, end, rule in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0])):
            if not any(a <= start and end <= b for a, b, _, _ in kept):
                kept.append((start, end, rule.label, rule.score))
        assert scanner.detections(text, set(text.split())) == kept


def test_toxicity(spark, odd, empty):
    model = toxicity.Model(toxicity.SEED, *toxicity.fit([], np.zeros(0)))
    assert model.score("You are a stupid idiot and a worthless clown.") > 0.7
    assert model.score("") == model.score("A calm and friendly text.") < 0.3 and model.score("He said idiot.") < model.score("You idiot.")
    rng = random.Random(7)
    for _ in range(300):  # the compiled grammar, and its transducers one after another
        symbols, state = [rng.randrange(toxicity.N_SYMBOLS) for _ in range(25)], 0
        want, weights = symbols, [0.0] * 25
        for machine in (toxicity.negation(), toxicity.report(), toxicity.clause(), toxicity.afterwards()):
            at, written = machine.start, []
            for k, symbol in enumerate(want):
                at, x, w = machine.step(at, symbol)
                written.append(x)
                weights[k] += w
            want = written
        for symbol, out, w in zip(symbols, want, weights):
            state, x, y = toxicity.GRAMMAR[state][symbol]
            assert (x, y) == (out, w)
    labels = spark.createDataFrame([(1, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judged(odd, toxicity.learn(odd, labels, F.lit(True))).count() == len(ODD)
    assert toxicity.judged(empty, toxicity.learn(empty, labels.limit(0), F.lit(True))).count() == 0


def patterns_plainly(text):
    """How many clauses show each pattern, word by word; for texts without commas and quotation marks."""
    counts = [0] * len(toxicity.PATTERNS)
    for words in (re.findall(r"[^\W\d_]+", x) for x in re.split(r"[.!?;\n]", text.lower())):
        seen, told = set(), False
        for i, w in enumerate(words):
            kind = "insult" if w in toxicity.INSULTS else "threat" if w in toxicity.THREATS else "target" if w in toxicity.TARGETS else None
            if kind in ("insult", "threat"):
                kind = "doubtful" if w in toxicity.DOUBTFUL_INSULTS else kind
                if any(x in toxicity.NEGATIONS for x in words[max(0, i - toxicity.REACH) : i]):
                    kind = "negated"
                elif told:
                    kind = "reported"
            told = told or w in toxicity.REPORTS
            seen.add(kind)
        insult = "insult" in seen or ("doubtful" in seen and "target" in seen)
        if "threat" in seen and ("target" in seen or "insult" in seen):
            counts["target" not in seen] += 1
        elif insult:
            counts[3 - ("target" in seen)] += 1
        elif "reported" in seen or "negated" in seen:
            counts[5 - ("reported" in seen)] += 1
    return counts


def test_toxic_patterns_by_definition():
    rng = random.Random(8)
    pool = "idiot moron pig worm kill stab you they not never said calls tree walks : . ! the a of".split()
    for _ in range(500):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))
        got, want = toxicity.features(text, toxicity.SEED), patterns_plainly(text)
        assert (got is None and not sum(want)) or np.allclose(np.expm1(got[: len(want)]), want), text


def test_toxic_clauses_not_words():
    score = toxicity.Model(toxicity.SEED, *toxicity.fit([], np.zeros(0))).score
    for clean in ("He said: you are an idiot.", "He said you are an idiot.", "You are an idiot, he said.", '"You are an idiot!" he said.', "„Du bist ein Idiot!“ sagte er.", "You are not an idiot.", "idiot", "nobody came", "The pig and the worm.", "kill the process", ""):
        assert score(clean) < 0.3, clean
    for toxic in ("You are an idiot.", "I will kill you.", '"You are an idiot!" She left.', "Ich werde dich umbringen, du Idiot."):
        assert score(toxic) > 0.7, toxic


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.op10_toxicity(spark, sf).where("held_out").join(known, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.9 * sum(r.predicted for r in rows) and hits >= 0.7 * sum(r.toxic for r in rows)
