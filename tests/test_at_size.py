"""What larger tables bring: large keys, long components, frequent seeds."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from lumenseq import queries
from lumenseq.operators import clusters, graph, mapping

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["redundancy_keep", "redundancy_losers"])
def test_products_of_large_keys(spark, tmp_path, name):
    """Keys of the 21st copy of sf0.1, whose products pass an int; the SQL passes it too, so it is asked with a wider type."""
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + 400_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    sql = queries.ORACLE_SQL[name]
    assert "(x * y)" in sql
    want = {x for (x,) in con.sql(sql.replace("(x * y)", "(x::bigint * y)")).fetchall()}
    assert {r.id for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} == want and want


def test_components_write_stars_and_no_overlaps(spark, monkeypatch, tmp_path):
    """What is written on the way is far less than the overlaps, with links left to join beyond those that one task takes, and without rounds."""
    for k in range(8):
        part = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + 200 * k)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    checkpoint = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a: written.append((out := checkpoint(self, *a)).count()) or out)
    monkeypatch.setattr(graph, "components", lambda links, few=1000, known=graph.components: known(links, few))
    monkeypatch.setattr(graph, "rounds", lambda links: pytest.fail("rounds over all links"), raising=False)
    found = queries.QUERIES["overlap_components"](spark, str(tmp_path)).collect()
    assert len(found) > 1600 and {r.root for r in found} == {"r0"} and max(written) < 5000  # of 48,000 overlaps


def test_components_by_seams_equal_one_task(spark):
    rng = random.Random(7)
    links = [(a, rng.choice([a + 1, a + 2, rng.randrange(a, a + 40)])) for a in range(0, 6000, 1) if a % 500 not in range(450, 500) for _ in range(2)]
    links = [(min(a, 5999), min(b, a // 500 * 500 + 499)) for a, b in links]
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    want = {r.node: r.root for r in graph.components(frame).collect()}
    for n in (1, 6):  # links beside their like, and dealt out
        some = frame.repartitionByRange(n * 4, "a") if n == 1 else frame.repartition(4 * n)
        assert {r.node: r.root for r in graph.components(some, 600).collect()} == want


def test_visiting_order_takes_numbers_to_its_task(spark):
    """Components in one task and batches that split them; ids and overlaps aren't gathered as frames."""
    rng = random.Random(12)
    rows = [(k % 3, rng.randrange(150), rng.randrange(150), rng.choice("+-"), k) for k in range(2400)]
    links = [(f"{'xyz'[c]}{a}", f"{'xyz'[c]}{b}", s, k) for c, a, b, s, k in rows]
    ids = sorted({x for r in links if r[0] != r[1] for x in r[:2]})
    reads = [(x, rng.randrange(90), rng.randrange(10**6)) for x in ids]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = graph.ordered_reads(spark.createDataFrame(reads, "id string, len int, ord long"), spark.createDataFrame(links, "qn string, tn string, strand string, ord long").repartition(3))
        assert "CoGroups" not in found._jdf.queryExecution().toString()
        got = {}
        for r in found.orderBy("component", "rank").collect():
            got.setdefault(r.component[0], []).append((r.id, r.strand))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in "xyz":
        near = {}
        for a, b, s, _ in links:
            if a != b and a[0] == c:
                near.setdefault(a, {}).setdefault(b, s)
                near.setdefault(b, {}).setdefault(a, s)
        length, first = {x: n for x, n, _ in reads}, min((o, x) for x, _, o in reads if x[0] == c)[1]
        strand, met, order = {first: "+"}, [], [first]
        while True:
            for x, s in near[order[-1]].items():
                if x not in strand:
                    strand[x] = "+" if strand[order[-1]] == s else "-"
                    met.append(x)
            if not met:
                break
            order.append(max(met, key=lambda x: length[x]))
            met.remove(order[-1])
        assert got[c] == [(x, strand[x]) for x in order]


def first_leasts(x, w):
    return sorted({s + int(x[s : s + w].argmin()) for s in range(len(x) - w + 1)})


def test_least_places_equal_a_window_by_window_search():
    rng = np.random.default_rng(1)
    for k in range(400):
        x = rng.integers(0, rng.choice([2, 4, 50, 2**62]), rng.integers(12, 80)).astype(np.uint64)
        w = int(rng.integers(1, 12))
        x = np.concatenate([x, np.tile(x[:3], 15)]) if k % 2 else x
        assert mapping.least_places(x, w).tolist() == first_leasts(x, w)


def test_frequent_seeds_are_chosen_without_dealing_out_all(spark, monkeypatch):
    """Reads of repeats and of none: the same anchors as by counts of all seeds, whose stretches aren't dealt out."""
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common = some(120)
    rows = [(f"r{k:02}", some(200) + common * (k % 4) + some(90) + "AC" * (20 * (k % 3)) + common) for k in range(30)]
    reads, settings = spark.createDataFrame(rows, "id string, seq string").repartition(3), mapping.Settings(k=15, w=5, most=20)
    counts = mapping.seeds(reads, settings).groupBy("hash").count()
    assert "Window" not in mapping.asked(reads, counts, settings._replace(most=10**6))._jdf.queryExecution().toString()
    got = sorted(mapping.anchors(reads, reads, settings).collect())
    monkeypatch.setattr(mapping, "MARKED", 0)
    assert got == sorted(mapping.anchors(reads, reads, settings).collect()) and got


def test_runs_without_places_for_a_chain():
    p = mapping.Settings(least=3, gap=10)
    runs = [[0, 5, 9], [0, 0, 5, 5], [0, 5, 30, 35], [9, 0, 40, 5, 41], [7]]
    at, starts = np.concatenate(runs), np.cumsum([0, *map(len, runs[:-1])])
    assert mapping.long_enough(at, starts, p).tolist() == [True, False, False, True, False]


def named_sequences(spark, rng):
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = some(2600)
    rows = [(f"r{k}", some(300 * k) + base[100 * k : 100 * k + 1500] + "AC" * 40) for k in range(5)] + [("r", base), ("r1x", some(700)), ("e", "")]
    return spark.createDataFrame(rows, "id string, seq string").repartition(3)


def test_sketches_are_distinct_where_they_are_made(spark):
    """Against sets of k-mers; the k-mers, their bins and numbers aren't dealt out before they meet."""
    frame, k, share, size = named_sequences(spark, random.Random(6)), 16, 4, 500
    found = mapping.sketch_identities(mapping.fragments(frame, size), frame, size, k, share, 0.5)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 6
    cut = {r.id: r.seq.encode() for r in mapping.fragments(frame, size).collect()}
    want = {}
    for q, a in cut.items():
        own = set(mapping.sampled(a, k, share)[0].tolist())
        for t, b in ((r.id, r.seq.encode()) for r in frame.collect()):
            there = [(h, p // size) for h, p in zip(*(x.tolist() for x in mapping.sampled(b, k, share)))]
            n = max((len(own & {h for h, bin in there if bin in (at, at + 1)}) for at in range(-1, len(b) // size + 1)), default=0)
            if n and (n / len(own)) ** (1 / k) >= 0.5:
                want[q, t] = (n / len(own)) ** (1 / k)
                assert mapping.told_identity(a, b, size) == pytest.approx(want[q, t])
    got = {(r.qn, r.tn): r.identity for r in found.collect()}
    assert got.keys() == want.keys() and list(got.values()) == pytest.approx([want[x] for x in got])


def test_identities_one_way_only(spark, monkeypatch):
    """Pairs x < y alone are met, and only those that align are sketched."""
    frame, settings = named_sequences(spark, random.Random(8)), mapping.Settings(k=15, w=5)
    rows = lambda pairs: sorted((r.x, r.y, round(r.ani, 9), r.n) for r in pairs.collect() if r.x < r.y)
    for made in (lambda once: mapping.nucleotide_identity(frame, frame, 500, settings, once=once), lambda once: mapping.sketched_identity(frame, frame, 500, once=once)):
        one_way = made(True)
        assert one_way.where("x >= y").count() == 0 and rows(one_way) == rows(made(False)) and rows(one_way)
    monkeypatch.setattr(mapping, "sketch_identities", lambda *a, **k: pytest.fail("all pairs sketched"))
    assert mapping.nucleotide_identity(frame, frame, 500, settings).count()


def test_all_reads_are_mapped_once_where_seeds_suffice(spark):
    """Twenty seeds, each of which covers one more read: one batch finds them."""
    reads = spark.createDataFrame([(f"r{k:02}", 1000 - k, k + 1, "A") for k in range(40)], "id string, len int, rank long, seq string")
    calls = []

    def pairs(seeds):
        calls.append(1)
        return seeds.where("rank <= 20").selectExpr("concat('r', cast(rank + 19 as string)) qn", "id tn", "500 alnlen")

    members, _ = clusters.seed_clusters(reads, pairs, topk=20, min_seed_len=10)
    assert {(r.cluster, r.seed, r.member) for r in members.collect()} == {(k, f"r{k:02}", x) for k in range(20) for x in (f"r{k:02}", f"r{k + 20}")} and len(calls) == 1
