"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints within tau bits agree to within t_i bits on one of m bit groups at least,
whenever the thresholds t_i add up to tau - m + 1 (a group with t_i = -1 is not searched).
Correlated bits share a group, so that the other groups stay selective, and the thresholds
come from dynamic programming over the candidates that each choice is estimated to bring.
Fingerprints are indexed by all values within t_i // 2 bits of theirs on each group, probed with
all values within the rest of t_i, so that values t_i bits apart meet halfway, and verified on
all 64 bits.

Large groups of near copies fill many buckets. So first each fingerprint is held against the least
and the greatest one with the same value on each group, which joins most of a large group, and what
is joined is one class. The buckets then only compare members of different classes. A bucket with many
members is compared inside tasks of bounded size: its most frequent class in blocks against the
members of other classes, and those among each other, but the class not with itself. If the other
classes have over `MIDPOINTS_FROM` blocks, each member names all midpoints within reach: two
fingerprints are at most four bits apart exactly if some value lies within two bits of both, so members
that share a midpoint are linked and the work is linear in the bucket.

Near duplicates by a set similarity (`similar`, `keep_one`) are first what this search links and an exact
comparison confirms. Fingerprints can't bring together all pairs of a similarity of 0.8, so bands of
sketches then name the pairs between the classes found so far, which are compared alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, few_or_none, looked_up, release, texts
from .components import components

BITS = 64
SEED = 42
SHINGLE = 4
TAU = 4
HOT = 400
BLOCK = 1024
MIDPOINTS_FROM = 24
#: Midpoints that one member may name; with a tau that asks for more, all hot buckets are compared by blocks.
BALL = 5000
#: Multipliers of a text's sketch. The share of bytes that two texts have in common is about their
#: similarity; at 0.8 the standard deviation is 0.025.
MINIMA = 256
#: Jaccard similarity of near duplicates, and the share of sketch bytes from which on it is computed.
ALIKE = 0.8
LOOSE = 0.7
#: Bytes of a sketch that candidates have in common, in one of its 36 bands. At a similarity of 0.8, 1 pair
#: in 4,800 shares no band.
BAND = 7
#: Members of a band that are paired by a join; more are compared inside tasks.
FEW = 16
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1)
MIXER = np.uint64(0x9E3779B97F4A7C15)
#: From a text's shingle hashes to its 64 bits.
Bits = Callable[[np.ndarray], int]


def shingles(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; of the whole if there are fewer."""
    words = data.lower().split()
    n = len(words)
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(text, SEED)] if n else [], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """SimHash: bit j is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """Byte j comes from the hash that is least under the j-th of n multipliers; 0 without hashes.

    The share of equal bytes of two texts is about their shingles' Jaccard similarity.
    """
    if not len(hashes):
        return np.zeros(n, np.uint8)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * MULTIPLIERS[:n]).min(0))
    return (least * MIXER >> np.uint64(56)).astype(np.uint8)


def fingerprint(data: bytes, width: int = SHINGLE, bits: Bits = majority) -> int:
    """64 bits of a text's shingles; zero if it has no word."""
    return bits(shingles(data, width))


def fingerprints(docs: DataFrame, width: int = SHINGLE, bits: Bits = majority) -> DataFrame:
    """(doc_id, fp long) of every row. Null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, width, bits) for x in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long")


def together(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many bits i and j are both set (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float64)
            total, n = total + bits.T @ bits, n + len(bits)
        if n:
            cells = np.append(total.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    cells = dict(prints.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    return cells.get(BITS * BITS, 0), np.array([cells.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def bit_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy grouping: each group starts at the bit most correlated with those left and takes
    the bits most correlated with the group so far."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = list(range(BITS)), []
    for k in range(parts):
        want = len(left) // (parts - k)
        group = [max(left, key=lambda b: related[b, left].sum())]
        left.remove(group[0])
        while len(group) < want:
            group.append(max(left, key=lambda b: related[b, group].mean()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def near_shares(p: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs within t = 0..most bits on a group, from each bit's frequency."""
    ways = np.zeros(len(group) + 1)
    ways[0] = 1
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        ways[1:] = ways[1:] * (1 - q) + ways[:-1] * q
        ways[0] *= 1 - q
    return np.cumsum(ways)[: most + 1]


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Dynamic programming: spends exactly `units` over the groups, costs[i][u] for u units."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, taken) in best.items():
            for u, cost in enumerate(row):
                if used + u <= units and total + cost < step.get(used + u, (np.inf, []))[0]:
                    step[used + u] = (total + cost, [*taken, u])
        best = step
    return best.get(units, (np.inf, []))


def plan(prints: DataFrame, tau: int = TAU, most: int = 2) -> list[tuple[list[int], int]]:
    """The bit groups to search, each with its threshold, of the cheapest split in 2 to 6 parts.

    All statistics are of all fingerprints: bit frequencies, and exact collision counts that
    correct the estimates for what the bits have in common.
    """
    if tau >= 6 * (most + 1):
        raise ValueError(f"no six groups with thresholds up to {most} cover {tau} bits")
    n, both = together(prints)
    p = np.diag(both) / max(n, 1)
    splits = {m: bit_groups(n, both, m) for m in range(2, 7)}
    masks = [(m, i, mask_of(g)) for m, groups in splits.items() for i, g in enumerate(groups)]
    keys = F.explode(F.array(*[F.struct(F.lit(m * 100 + i).alias("at"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for m, i, mask in masks])).alias("x")
    same = dict(prints.select(keys).groupBy("x.at", "x.key").count().groupBy("at").agg(F.sum(F.col("count").cast("double") ** 2)).collect())
    choices = []
    for m, groups in splits.items():
        costs = []
        for i, group in enumerate(groups):
            shares = near_shares(p, group, most)
            met = same.get(m * 100 + i, 0.0) / max(shares[0], 1e-300)
            ball = [sum(comb(len(group), r) for r in range(t + 1)) for t in range(most + 1)]
            # pairs within t bits meet at a common key once at least, and equal ones at each key that both name
            meet = [shares[0] * ball[t // 2] + 2 * (shares[t] - shares[0]) for t in range(most + 1)]
            costs.append([0.0] + [n * (ball[t - t // 2] + ball[t // 2]) + 0.1 * met * meet[t] for t in range(most + 1)])
        cost, units = allocate(costs, tau + 1)
        choices.append((cost, [(g, u - 1) for g, u in zip(groups, units) if u]))
    return min(choices, key=lambda x: x[0])[1]


def mask_of(bits: list[int] | tuple[int, ...]) -> int:
    """The bits as a signed 64-bit number."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> 63 else value


def flips(value: Column, bits: list[int], most: int) -> Column:
    """Array of (key, far): value with each set of at most `most` of the bits flipped."""
    one = F.array(*[F.lit(mask_of([b])) for b in bits])
    masks = F.array(F.lit(0).cast("long"))
    if sum(comb(len(bits), r) for r in range(most + 1)) <= 400:
        masks = F.array(*[F.lit(mask_of(s)) for r in range(most + 1) for s in combinations(bits, r)])
    else:
        for _ in range(most):
            masks = F.array_distinct(F.concat(masks, F.flatten(F.transform(masks, lambda x: F.transform(one, lambda y: x.bitwiseOR(y))))))
    return F.transform(masks, lambda x: F.struct(value.bitwiseXOR(x).alias("key"), F.bit_count(x).cast("int").alias("far")))


def small(keys: DataFrame) -> tuple[DataFrame, bool]:
    """Keys to join by, broadcast if their checked number allows it, and whether there are any."""
    keys = checkpointed(keys)
    return few_or_none(keys), keys.limit(1).count() > 0


def by_mask(prints: DataFrame, groups: list[list[int]], *more: str) -> DataFrame:
    """(part, key, fp, more): each fingerprint's value on each of the groups."""
    keys = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("key")) for i, g in enumerate(groups)]
    return prints.select("fp", *more, F.explode(F.array(*keys)).alias("x")).select("x.part", "x.key", "fp", *more)


def star(prints: DataFrame, groups: list[list[int]], tau: int, hot: int) -> DataFrame:
    """Links (a, b) of each fingerprint with the least and the greatest one of the same value on a group."""
    keys = by_mask(prints, groups)
    ends = keys.groupBy("part", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n")).where("n > 1")
    pairs = looked_up(keys, ends, ["part", "key"], hot).select(F.col("fp").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    return checkpointed(pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)).distinct())


def links(prints: DataFrame, tau: int = TAU, hot: int = HOT, block: int = BLOCK, midpoints_from: int = MIDPOINTS_FROM) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose closure is that of all pairs within tau.

    prints has distinct values fp long. tau is at most 17.
    """
    found = plan(prints, tau)
    first = star(prints, [group for group, _ in found], tau, hot)
    prints = checkpointed(prints.join(components(first).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    everything: list[list[DataFrame]] = []
    for i, (group, t) in enumerate(found):
        value = F.col("fp").bitwiseAND(F.lit(mask_of(group)))
        everything.append([prints.select(F.lit(i).alias("part"), "fp", "root", F.explode(flips(value, group, reach)).alias("x")) for reach in (t - t // 2, t // 2)])
    probes, owned = (reduce(DataFrame.union, side).select("part", "x.key", "fp", "root", "x.far") for side in zip(*everything))
    crowded, any_hot = small(owned.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("part", "key"))
    cold = owned.join(crowded, ["part", "key"], "left_anti") if any_hot else owned
    differ = F.col("p.fp").bitwiseXOR(F.col("o.fp"))
    close = (F.col("p.root") != F.col("o.root")) & (F.bit_count(differ) <= tau)
    for i, (group, t) in enumerate(found):  # a pair counts in the first part that brings it together, equal values at their own key
        part, here = F.col("p.part"), differ.bitwiseAND(F.lit(mask_of(group)))
        close &= F.when(part == i, (F.col("p.far") == 0) | (here != 0)).when(part > i, F.bit_count(here) > t).otherwise(True)
    joined = probes.alias("p").join(cold.alias("o"), (F.col("p.part") == F.col("o.part")) & (F.col("p.key") == F.col("o.key")) & close)
    edges = first.union(joined.select(F.col("p.fp").alias("a"), F.col("o.fp").alias("b")))
    if not any_hot:
        return edges
    members = split_up(probes.join(crowded, ["part", "key"]), ["part", "key"], block)
    far = F.lit(False) if comb(BITS, tau // 2) > BALL or tau % 2 else F.col("others") > midpoints_from
    edges = edges.union(block_links(members.where(~far), tau))
    for i in [r.part for r in members.where(far).select("part").distinct().collect()]:  # of at most six groups
        edges = edges.union(midpoint_links(members.where(far & (F.col("part") == i)), [b for b in range(BITS) if b not in found[i][0]], tau))
    return edges


def split_up(members: DataFrame, bucket: list[str], block: int) -> DataFrame:
    """members (bucket, fp, root, ...) of the buckets that hold several classes, each with its place.

    main: whether in the bucket's most frequent class; mains, others: the blocks that it and the rest are dealt into; mine: the
    member's block, others first.
    """
    kinds = members.groupBy(*bucket, "root").agg(F.count("*").alias("size"))
    sizes = kinds.groupBy(*bucket).agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("n")).where("top.size < n")
    sizes = sizes.select(*bucket, "n", F.col("top.root").alias("top"), *(F.ceil(x / block).cast("int").alias(k) for k, x in (("mains", F.col("top.size")), ("others", F.col("n") - F.col("top.size")))))
    known = looked_up(members, sizes, bucket, block).withColumn("main", F.col("root") == F.col("top"))
    at = F.xxhash64("fp")
    return checkpointed(known.withColumn("mine", F.when(known.main, F.col("others") + F.pmod(at, F.col("mains"))).otherwise(F.pmod(at, F.col("others"))).cast("int")).drop("top"))


def dealt(members: DataFrame) -> DataFrame:
    """members of split_up, once for each pair of blocks (i, j) that they are compared in; the main class isn't with itself."""
    met = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    pairs = F.transform(F.sequence(F.lit(0), met - 1), lambda x: F.struct(F.least(x, "mine").alias("i"), F.greatest(x, "mine").alias("j")))
    return members.withColumn("x", F.explode(pairs)).withColumns({"i": F.col("x.i"), "j": F.col("x.j")}).drop("x")


def block_links(members: DataFrame, tau: int) -> DataFrame:
    """Each pair of a bucket's blocks is compared in one task; it returns links that join what all its links join."""

    def run(bucket: pa.Table) -> pa.Table:
        values, labels, taken = bucket.column("fp").to_numpy().view(np.uint64), np.unique(bucket.column("root").to_numpy(), return_inverse=True)[1], []
        for i in range(len(values)):
            for j in (i + 1 + np.flatnonzero((labels[i + 1 :] != labels[i]) & (np.bitwise_count(values[i + 1 :] ^ values[i]) <= tau))).tolist():
                if labels[i] != labels[j]:
                    taken.append((i, j))
                    labels[labels == labels[j]] = labels[i]
        ends = values.view(np.int64)[np.array(taken, np.int64).reshape(-1, 2)]
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return dealt(members).select("part", "key", "i", "j", "fp", "root").groupBy("part", "key", "i", "j").applyInArrow(run, "a long, b long")


def midpoint_links(members: DataFrame, rest: list[int], tau: int) -> DataFrame:
    """All members within tau // 2 bits of a common midpoint, linked to the least of them.

    tau is even. A midpoint has the bucket's key on the group's bits, so a member that differs
    from it in `far` bits of the group may differ in tau // 2 - far of the others.
    """
    balls = None
    for far in range(tau // 2 + 1):
        ball = members.where(F.col("far") == far).select("key", "fp", F.explode(flips(F.col("fp").bitwiseAND(F.lit(mask_of(rest))), rest, tau // 2 - far)).alias("x"))
        balls = ball if balls is None else balls.union(ball)
    balls = balls.select("fp", F.col("key").bitwiseOR(F.col("x.key")).alias("middle"))
    least = balls.groupBy("middle").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").drop("most")
    return balls.join(least, "middle").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def classes(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """(fp, root): distinct fingerprints that are linked to another, with their class's root."""
    return components(links(prints, tau)).select(F.col("node").alias("fp"), "root")


def with_least(own: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): own (doc_id, fp), distinct (fp, low), roots (fp, root) of linked ones."""
    known = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    return own.join(known.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, tau: int = TAU, bits: Bits = majority) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the least doc_id that links of at most tau bits reach.

    Equal texts have equal fingerprints and so one class. A null doc_id is nobody's least id
    (component_id is null only if the whole class has none). Repeated rows are returned each.
    """
    own = checkpointed(fingerprints(docs, width, bits))
    distinct = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    return with_least(own, distinct, classes(distinct.select("fp"), tau))


def fingerprint_pairs(distinct: DataFrame, tau: int, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct (fp, bits), bits a SimHash fingerprint: of equal bits each with the least one, and of
    bits within tau those that the search returns, by their least ones."""
    named = checkpointed(distinct.groupBy("bits").agg(F.min("fp").alias("low"), F.count("*").alias("n")))
    equal = looked_up(distinct.select("fp", "bits"), named.where("n > 1"), ["bits"], hot).where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    near = links(named.select(F.col("bits").alias("fp")), tau)
    for k in "ab":
        near = near.withColumnRenamed(k, "bits").join(named.select("bits", F.col("low").alias(k)), "bits").drop("bits")
    return checkpointed(equal.union(near.select("a", "b")).distinct())


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different classes, roots (fp, root) of the linked ones."""
    known = pairs
    for k in "ab":
        known = known.join(roots.select(F.col("fp").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
    return known.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def meetings(distinct: DataFrame) -> DataFrame:
    """(key, fp, low): fingerprints that share a band of their sketches with another, and each band's least one."""
    keys = [F.xxhash64(F.lit(k), F.substring("sketch", BAND * k + 1, BAND)) for k in range(MINIMA // BAND)]
    named = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = named.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("most")).where("low < most").drop("most")
    return checkpointed(named.join(shared, "key").select("key", "fp", "low"))


def matching(x: np.ndarray, y: np.ndarray, alike: float) -> bool:
    """Whether two sets of shingle hashes, sorted and distinct, have a Jaccard similarity of alike or more."""
    if len(x) < len(y):
        x, y = y, x
    if len(y) < alike * len(x) - 1e-9:
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return both >= alike * (len(x) + len(y) - both) - 1e-9


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, hashes binary) of the wanted (fp, text_key): the sorted distinct shingle hashes, from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [np.unique(shingles(x, width)).tobytes() for x in texts(batch)]
            fps = np.array([xxhash.xxh64_intdigest(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(sets, pa.binary())], ["fp", "hashes"])

    keys, _ = small(wanted.select("text_key").distinct())
    chosen = docs.select("text", F.xxhash64("text").alias("text_key")).join(keys, "text_key", "left_semi").dropDuplicates(["text_key"])
    return checkpointed(chosen.select("text").mapInArrow(run, "fp long, hashes binary"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of `rows`, so that what is unpacked at once is small."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, width: int, alike: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose texts' shingle sets are alike; the sketches rule out most others first."""

    def loosely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= min(LOOSE, alike - 0.1)))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = ([np.frombuffer(h, np.uint64) for h in batch.column(c).to_pylist()] for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array([matching(x, y, alike) for x, y in zip(*sets)], pa.bool_()))

    ends = lambda table, column: [table.select(F.col("fp").alias(k), F.col(column).alias(v)) for k, v in (("a", "x"), ("b", "y"))]
    known = pairs
    for k, end in zip("ab", ends(distinct, "sketch")):
        known = known.join(end, k)
    likely = checkpointed(known.select("a", "b", "x", "y").mapInArrow(loosely, "a long, b long"))
    named = likely.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    known = likely
    for k, end in zip("ab", ends(shingle_sets(docs, named.join(distinct, "fp"), width), "hashes")):
        known = known.join(end, k)
    return checkpointed(known.select("a", "b", "x", "y").mapInArrow(exactly, "a long, b long"))


def untested(met: DataFrame, roots: DataFrame, few: int) -> DataFrame:
    """(key, fp, low, root, n, top) of the bands whose members are in several classes, roots (fp, root) of the linked ones.

    n: members, top: their most frequent class.
    """
    known = checkpointed(met.join(roots, "fp", "left").select("key", "fp", "low", F.coalesce("root", "fp").alias("root")))
    kinds = known.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("n"))
    mixed = kinds.where("n > 2 and top.size < n").select("key", "n", F.col("top.root").alias("top"))
    return checkpointed(looked_up(known, mixed, ["key"], few * few))


def crowded_links(members: DataFrame, filled: DataFrame, alike: float, block: int) -> DataFrame:
    """Links (a, b) between the classes that meet in a bucket: a forest, but no pair between two trees is left untested, but for
    those inside the bucket's most frequent class.

    members: key, fp, root; filled: fp, sketch, hashes, which join the members when they have been dealt out. Each pair of
    a bucket's blocks is compared in one task.
    """
    least = min(LOOSE, alike - 0.1)

    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("fp")
        fps, labels = bucket.column("fp").to_pylist(), np.unique(bucket.column("root").to_numpy(), return_inverse=True)[1]
        sketches = np.frombuffer(b"".join(bucket.column("sketch").to_pylist()), np.uint8).reshape(-1, MINIMA)
        sets, taken = [np.frombuffer(h, np.uint64) for h in bucket.column("hashes").to_pylist()], []
        mains = np.array(bucket.column("main").to_pylist())
        for i in np.argsort(mains, kind="stable").tolist():  # those of the frequent class come last, when they have been met
            if mains[i]:
                break
            others = np.flatnonzero((labels != labels[i]) & (mains | (np.arange(len(fps)) > i)))
            share = (sketches[others] == sketches[i]).mean(1)
            for at in np.argsort(-share, kind="stable").tolist():
                j = int(others[at])
                if share[at] < least:
                    break
                if labels[i] != labels[j] and matching(sets[i], sets[j], alike):
                    taken.append((fps[i], fps[j]))
                    labels[labels == labels[j]] = labels[i]
        return pa.table({"a": pa.array([a for a, _ in taken], pa.int64()), "b": pa.array([b for _, b in taken], pa.int64())})

    tasks = dealt(split_up(members, ["key"], block)).select("key", "i", "j", "fp", "root", "main")
    # the links meet another Python step next; in one stage with it a task would hold two Python processes, which stay for the session
    return checkpointed(tasks.join(filled, "fp").groupBy("key", "i", "j").applyInArrow(run, "a long, b long"))


def similar(docs: DataFrame, width: int = 5, alike: float = ALIKE, few: int = FEW, block: int = BLOCK, tau: int = TAU) -> DataFrame:
    """(doc_id, component_id) of every row, by links between texts with a Jaccard similarity of `alike` or more.

    A text stands for all with the same set of shingles. A pair is a link if their sets of shingle hashes have
    a Jaccard similarity of `alike`; what is linked is one class. The first candidates are those that SimHash
    fingerprints bring together, of at most tau bits' difference. Then those that share a band of their sketches,
    BAND bytes; either kind has 0.7 of the whole sketches in common. Each member of a band is tested against the
    band's least one, if that is in another class.
    In every band whose members are still in several classes all pairs between those are tested. With at most
    `few` members the pairs are joined. With more, the members of its most frequent class, in all its bands
    at once, and those outside that share a band with it are compared inside tasks; so a text's set travels
    once for its class, and not in every band. So each candidate pair is tested or its
    ends are in one class by tested links, however the rows are dealt out. Nulls and
    repeated rows are taken as in near_duplicates.
    """
    own, roots = alike_classes(docs, width, alike, few, block, tau)
    return with_least(own.select("doc_id", "fp"), own.groupBy("fp").agg(F.min("doc_id").alias("low")), roots).select("doc_id", "component_id")


def alike_classes(docs: DataFrame, width: int, alike: float, few: int = FEW, block: int = BLOCK, tau: int = TAU) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_key, sketch, bits) of every row, and (fp, root) of the linked ones; see similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for x in texts(batch):
                hashes = shingles(x, width)
                distinct = np.unique(hashes)
                rows.append((xxhash.xxh64_intdigest(distinct.tobytes()), minima(distinct, MINIMA).tobytes(), majority(hashes)))
            fps, sketches, bits = zip(*rows) if rows else ((), (), ())
            fps, bits = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, batch.column(2), pa.array(sketches, pa.binary()), bits], ["doc_id", "fp", "text_key", "sketch", "bits"])

    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    own = checkpointed(narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long, text_key long, sketch binary, bits long"))
    distinct = checkpointed(own.groupBy("fp").agg(F.min("text_key").alias("text_key"), F.min("sketch").alias("sketch"), F.min("bits").alias("bits")))
    classes = lambda links: components(links).select(F.col("node").alias("fp"), "root")
    found = verified(fingerprint_pairs(distinct.select("fp", "bits"), tau), distinct, docs, width, alike)
    release(docs.sparkSession)
    met = meetings(distinct.select("fp", "sketch"))
    stars = met.where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    found = found.union(verified(between(stars, classes(found)), distinct, docs, width, alike))
    release(docs.sparkSession)
    rest = untested(met, classes(found), few)
    release(docs.sparkSession)
    one, other = (rest.where(F.col("n") <= few).alias(x) for x in ("one", "other"))
    apart = one.join(other, (F.col("one.key") == F.col("other.key")) & (F.col("one.fp") < F.col("other.fp")) & (F.col("one.root") != F.col("other.root")))
    pairs = apart.select(F.col("one.fp").alias("a"), F.col("other.fp").alias("b")).distinct()
    crowded = checkpointed(rest.where(F.col("n") > few).select(F.col("top").alias("key"), "fp", "root").distinct())  # a class and those outside that meet it
    sets = shingle_sets(docs, crowded.select("fp").distinct().join(distinct, "fp"), width)
    filled = distinct.select("fp", "sketch").join(sets, "fp")
    links = found.union(verified(pairs, distinct, docs, width, alike)).union(crowded_links(crowded, filled, alike, block))
    release(docs.sparkSession)
    return own, classes(links)


def keep_one(docs: DataFrame, width: int = 5, alike: float = ALIKE) -> DataFrame:
    """The rows of docs that stay: of each class of similar texts the row with the least doc_id, once.

    Rows with one doc_id but different texts are different documents. Rows without a doc_id are all kept: they
    can't be named as anybody's copy. Null and empty texts are one class.
    """
    own, roots = alike_classes(docs, width, alike)
    least = own.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    chosen = least.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    stay = chosen.select(F.col("least.doc_id").alias("_id"), F.col("least.text_key").alias("_key"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    named = docs.where("doc_id is not null").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    kept = named.join(stay, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return kept.select(*columns).unionByName(docs.where("doc_id is null"))
