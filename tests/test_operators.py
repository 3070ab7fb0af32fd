"""Small hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from lumenseq.functions import sequences as seqs
from lumenseq.operators import alignments, depth, divergence, evaluation, overlaps

OVERLAP = "qn string, ql int, qs int, qe int, strand string, tn string, tl int, ts int, te int, nmatch int, alnlen int, ord long"


@pytest.mark.parametrize(
    "row, over, inside",
    [
        (("a", 1000, 10, 1000, "+", "b", 1200, 0, 990, 900, 990, 1), 0, False),
        (("a", 1000, 10, 1000, "-", "b", 1200, 0, 990, 900, 990, 1), 10, False),
        (("a", 1000, 100, 600, "+", "b", 1200, 100, 600, 500, 500, 1), 500, True),
    ],
)
def test_overhang(spark, row, over, inside):
    found = spark.createDataFrame([row], OVERLAP).select(overlaps.overhang().alias("o"), overlaps.internal(30, 0.8).alias("i")).first()
    assert (found.o, found.i) == (over, inside)


def test_first_of_the_longest_overlaps_stays(spark):
    rows = [(q, 9, 0, 9, "+", t, 9, 0, 9, 9, n, k) for q, t, n, k in (("a", "b", 500, 1), ("b", "a", 700, 2), ("a", "b", 700, 3))]
    assert [r.ord for r in overlaps.longest_per_pair(spark.createDataFrame(rows, OVERLAP)).collect()] == [2]


def test_divergence_and_losers(spark):
    pair = spark.createDataFrame([("A", "B", 950, 1000, 1000, 1200, 1000, 1000)], "x string, y string, m int, l int, l1 int, l2 int, cov1 int, cov2 int")
    found = divergence.divergence(pair, 5, 0.1).first()
    assert (found["global"], found["local"], found["contained"]) == (0.2083, 0.05, 1)
    pairs = spark.createDataFrame([("A", "B", 9, 9, 0, 0.001), ("B", "C", 9, 9, 0, 0.001)], "x string, y string, l1 int, l2 int, contained int, gdiv double")
    assert sorted(r.id for r in divergence.losers(pairs).collect()) == ["A", "B"]


def test_n50(spark):
    assert evaluation.nx(spark.createDataFrame([(n,) for n in (5, 4, 3, 2, 1)], "len int")).first().nx == 4


def test_short_window_is_divided_by_the_width(spark):
    rows = spark.createDataFrame([("c", p, 10) for p in range(1, 8)], "contig string, pos int, depth int")
    assert [r.mean for r in depth.window_means(depth.as_runs(rows)).orderBy("win").collect()] == [10.0, 4.0]


def test_clip_points(spark):
    rows = [("q", 0, "h", 50, c, "A" * n) for c, n in (("25S100M2S", 127), ("2S100M50S", 152), ("100M50S", 150), ("*", 0))]
    found = alignments.clip_points(spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, cigar string, seq string"))
    assert sorted(r.bp for r in found.collect()) == [50, 150, 152]


def test_sequences(spark):
    row = spark.createDataFrame([("ACGTNacgtn",)], "s string").select(seqs.reverse_complement_strict(F.col("s")).alias("a"), seqs.reverse_complement(F.lit("AXG")).alias("b"), seqs.wrapped(F.lit("ACGTAC"), 3).alias("w")).first()
    assert (row.a, row.b, row.w) == ("nacgtNACGT", "CXT", "ACG\nTAC")
    with pytest.raises(Exception, match="no base"):
        spark.createDataFrame([("AXG",)], "s string").select(seqs.reverse_complement_strict(F.col("s"))).collect()


def test_relative_error_and_abundance(spark):
    rows = spark.createDataFrame([(10.0, 10.0), (10.0, 30.0), (0.0, 0.0)], "t double, e double")
    assert rows.agg((100 * F.avg(evaluation.relative_error(F.col("t"), F.col("e")))).alias("x")).first().x == pytest.approx(100 / 3)
    heads = spark.createDataFrame([("id freq=0.123", "id ab=12.5x")], "a string, b string")
    assert tuple(heads.select(seqs.abundance(F.col("a")), seqs.abundance(F.col("b"), "ab=", "x")).first()) == (0.123, 12.5)


@pytest.mark.parametrize(
    "contig, truth, pos, cigar, want",
    [
        ("ACGTACGT", "ACGTACGT", 0, "8M", (0.0, 0, 0, 0, 0, 0, 0, 0, 8)),
        ("ACGAACNT", "ACGTACGT", 0, "8M", (1 / 8, 1, 0, 0, 0, 0, 1, 0, 8)),  # N is unknown, no mismatch
        ("TTACGT", "GACGT", 1, "2S4M", (1 / 5, 1, 0, 0, 0, 0, 0, 0, 5)),  # the clip counts as far as the truth reaches: 1 base of 2
        ("ACGTGG", "ACGTCC", 0, "4M2S", (2 / 6, 2, 0, 0, 0, 0, 0, 0, 6)),
        ("ACGTGGC", "ACGTC", 0, "4M3S", (0.0, 0, 0, 0, 0, 0, 0, 0, 5)),  # the clip's last base is compared with the truth's next
        ("ACGGTACGT", "ACGTACGT", 0, "3M1I5M", (1 / 9, 0, 1, 1, 0, 0, 0, 0, 8)),
        ("ACGTCGT", "ACGTACGT", 0, "4M1D3M", (1 / 7, 0, 0, 0, 1, 1, 0, 0, 8)),
        ("GGACGT", "ACGT", 0, "2I4M", (0.0, 0, 0, 0, 0, 0, 0, 0, 4)),  # an insertion at an end isn't counted
        ("ACGT", "ACGA", 0, "3=1X", (1 / 4, 1, 0, 0, 0, 0, 0, 0, 4)),
    ],
)
def test_alignment_scores(spark, contig, truth, pos, cigar, want):
    aligned = spark.createDataFrame([("m", "c", "t", 0, pos + 1, cigar, 1), ("m", "c", "t", 4, 0, "*", 2)], "method string, contig_id string, truth_id string, flag int, pos int, cigar string, ord long")
    found = evaluation.score_alignments(aligned, spark.createDataFrame([("m", "c", contig)], "method string, contig_id string, seq string"), spark.createDataFrame([("t", truth)], "truth_id string, seq string"))
    row = found.collect()
    assert len(row) == 1 and tuple(row[0])[4:] == pytest.approx((*want, len(truth)))


def test_reversed_alignment_is_scored_on_its_strand(spark):
    aligned = spark.createDataFrame([("m", "c", "t", 16, 1, "4M", 1)], "method string, contig_id string, truth_id string, flag int, pos int, cigar string, ord long")
    found = evaluation.score_alignments(aligned, spark.createDataFrame([("m", "c", "AACC")], "method string, contig_id string, seq string"), spark.createDataFrame([("t", "GGTT")], "truth_id string, seq string"))
    assert found.first().score == 0


@pytest.mark.parametrize(
    "rows, best",
    [
        ([("t", 0, 50, 100, 0.2)], [0]),
        ([("t", 0, 50, 100, 0.2), ("u", 0, 100, 100, 0.1)], [1]),
        ([("t", 0, 50, 100, 0.2), ("u", 0, 100, 100, 0.2)], [0, 1]),  # equal on two truths: both
        ([("t", 0, 50, 100, 0.2), ("t", 50, 100, 100, 0.0), ("u", 0, 100, 100, 0.15)], [0, 1]),  # a pair counts by its mean
        ([("t", 0, 60, 100, 0.2), ("t", 45, 100, 100, 0.0)], [1]),  # they overlap by over a tenth
        ([("t", 0, 50, 100, 1.0)], [0]),
        ([("t", 0, 50, 100, 0.1), ("t", 60, 90, 100, 0.9), ("t", 92, 100, 100, 0.3)], [0, 2]),
    ],
)
def test_best_placements(spark, rows, best):
    assert chosen(spark, {"c": rows}) == {"c": best}


PLACEMENT = "method string, contig_id string, truth_id string, ord long, score double, mismatches long, ins_count long, ins_len long, del_count long, del_len long, unknown long, start long, end long, ref_len long"


def chosen(spark, contigs):
    rows = [("m", c, t, k, s, 0, 0, 0, 0, 0, 0, a, b, size) for c, some in contigs.items() for k, (t, a, b, size, s) in enumerate(some)]
    found = {}
    for r in evaluation.assigned(spark.createDataFrame(rows, PLACEMENT)).collect():
        found.setdefault(r.contig_id, []).append(r.ord)
    return {c: sorted(x) for c, x in found.items()}


def one_by_one(rows):
    """The rule of the best placements, told as a walk."""
    least, best = 1.0, []
    for i, one in enumerate(rows):
        partners = [j for j, other in enumerate(rows) if j > i and other[0] == one[0] and (other[2] <= one[1] or other[1] >= one[2] or one[2] - other[1] <= 0.1 * one[3])]
        value, j = min([((one[4] + rows[j][4]) / 2, j) for j in partners] or [(one[4], i)])
        if one in [rows[k] for k in best]:
            continue
        if value < least:
            least, best = value, sorted({i, j})
        elif value == least and one[0] not in [rows[k][0] for k in best]:
            best = best + sorted({i, j})
    return sorted(best)


def test_assignment_equals_a_walk(spark):
    rng = random.Random(8)
    span = lambda: (a := rng.randrange(0, 90, 10), a + rng.randrange(10, 60, 10))
    contigs = {f"c{k}": [(rng.choice("tuv"), *span(), 100, rng.choice([0.0, 0.1, 0.2, 0.3, 0.9, 1.0])) for _ in range(rng.randrange(1, 9))] for k in range(300)}
    want = {c: x for c, rows in contigs.items() if (x := one_by_one(rows))}
    assert chosen(spark, contigs) == want


def test_scores_of_random_alignments_equal_a_walk():
    rng = random.Random(9)
    for _ in range(300):
        ops = [(rng.randrange(1, 6), rng.choice("MMM=XID")) for _ in range(rng.randrange(1, 7))]
        ops = [(rng.randrange(1, 8), "S")] * rng.randrange(2) + ops + [(rng.randrange(1, 8), rng.choice("SH"))] * rng.randrange(2)
        pos = rng.randrange(0, 6)
        own = "".join(rng.choice("ACGTN") for _ in range(sum(n for n, o in ops if o != "D")))
        truth = "".join(rng.choice("ACGTN") for _ in range(pos + sum(n for n, o in ops if o in "M=XD") + rng.randrange(0, 6)))
        pairs, at, on, left, right, unaligned = [], 0, pos, 0, 0, 0
        counts = dict.fromkeys("ID", (0, 0)) | {"N": 0}
        for k, (n, o) in enumerate(ops):
            if o in "SH":
                reach = min(n, pos if k == 0 else len(truth) - on)
                shift = pos - reach if k == 0 else on
                pairs += list(zip(own[at + n - reach : at + n], truth[shift : shift + reach]))
                left, right, unaligned = (reach, right, unaligned + n - reach) if k == 0 else (left, reach, unaligned + n - reach)
            elif o in "M=X":
                pairs += list(zip(own[at : at + n], truth[on : on + n]))
            elif o == "D" or 0 < k < len(ops) - 1:
                counts[o] = (counts[o][0] + 1, counts[o][1] + n)
            counts["N"] += own[at : at + n].count("N") if o == "I" else 0
            at, on = at + n * (o != "D"), on + n * (o in "M=XD")
        unknown = sum("N" in p for p in pairs)
        wrong = sum(a != b for a, b in pairs if "N" not in (a, b))
        got = evaluation.measured(own.encode(), truth.encode(), pos, "".join(f"{n}{o}" for n, o in ops))
        assert got[1:] == (wrong, *counts["I"], *counts["D"], unknown + counts["N"], pos - left, on + right)
        assert got[0] == pytest.approx((wrong + counts["I"][1] + counts["D"][1]) / (len(own) - unaligned) if len(own) > unaligned else 0)


def test_assignment_by_contig(spark):
    rows = [("m", c, t, o, s, 0, 0, 0, 0, 0, 0, a, b, 100) for c, t, o, s, a, b in (("c", "t", 1, 0.2, 0, 50), ("c", "t", 2, 0.0, 50, 100), ("d", "u", 3, 0.3, 0, 100), ("d", "t", 4, 0.1, 0, 100))]
    frame = spark.createDataFrame(rows, "method string, contig_id string, truth_id string, ord long, score double, mismatches long, ins_count long, ins_len long, del_count long, del_len long, unknown long, start long, end long, ref_len long")
    assert sorted((r.contig_id, r.ord) for r in evaluation.assigned(frame).collect()) == [("c", 1), ("c", 2), ("d", 4)]


def test_frequency_rules(spark):
    truth = spark.createDataFrame([("z", 0, 100, 0.5), ("a", 1, 100, 0.3), ("b", 2, 300, 0.2)], "truth_id string, ord int, len int, freq double")
    contigs = spark.createDataFrame([("m", "k", 120, 6.0), ("m", "l", 90, 4.0), ("m", "s", 40, 2.0)], "method string, contig_id string, len int, ab double")
    # k is placed on z and a: z comes first in order though a does by name; l only on a; s is short for b and used up by it
    placed = spark.createDataFrame([("m", "k", "a", 1), ("m", "k", "z", 2), ("m", "l", "a", 3), ("m", "s", "b", 4)], "method string, contig_id string, truth_id string, ord int")
    found = {r.truth_id: r for r in evaluation.frequency_errors(placed, truth, contigs).collect()}
    assert set(found) == {"z", "a"}
    assert (found["z"].estimated, found["a"].estimated) == pytest.approx((100 * 6 / 16, 100 * 4 / 16))  # k counts once a truth in the total
    assert (found["z"].true, found["a"].true) == pytest.approx((100 * 0.5 / 0.8, 100 * 0.3 / 0.8))
    one = evaluation.error_summary(evaluation.frequency_errors(placed.where("contig_id = 'l'"), truth, contigs), "absolute").first()
    assert one["mean"] is None and one["median"] is None
    two = evaluation.error_summary(evaluation.frequency_errors(placed, truth, contigs), "absolute").first()
    assert two["most"] == pytest.approx(25.0)


def test_assembly_stats_rules(spark):
    truth = spark.createDataFrame([("t", 100), ("u", 200), ("v", 50)], "truth_id string, len int")
    contigs = spark.createDataFrame([("m", "c", 90), ("m", "d", 150), ("m", "e", 60)], "method string, contig_id string, len int")
    cols = "method string, contig_id string, truth_id string, start long, end long, mismatches long, ins_count long, ins_len long, del_count long, del_len long, unknown long"
    placed = spark.createDataFrame([("m", "c", "t", 0, 60, 0, 0, 0, 0, 0, 1), ("m", "d", "t", 50, 100, 2, 1, 3, 0, 0, 0), ("m", "d", "u", 0, 100, 0, 0, 0, 1, 4, 0)], cols)
    r = evaluation.assembly_stats(placed, contigs, truth).first()
    assert (r.assembly, r.aligned, r.unaligned, r.covered, r.target, r.breakpoints, r.n50, r.n50_aligned, r.n_contigs) == (300, 210, 90, 200, 350, 1, 150, 60, 3)
    assert (r.sensitivity, r.ppv, r.edit_rate) == pytest.approx((1 / 3, 1 / 3, 9 / 210))
    assert {x.truth_id: x.distance for x in evaluation.min_distances(placed, truth).collect()} == pytest.approx({"t": 0.0, "u": 4.0, "v": 100.0})


def test_windows_of_runs_are_those_of_bases(spark):
    """Against a loop over single bases."""
    import random

    rng = random.Random(5)
    for _ in range(4):
        bases, pos = {}, 1
        while pos < 400:
            n, d = rng.choice([1, 2, 3, 7, 30, 61]), rng.randrange(0, 12)
            bases |= {p: d for p in range(pos, pos + n) if d}
            pos += n
        rows = [("c", p, d) for p, d in sorted(bases.items())]
        inside = [k for k, r in enumerate(rows) if r[2] >= 5]
        cut = rows[inside[0] : inside[-1] + 1]
        want = [(k, w[0][1], w[-1][1], sum(x[2] for x in w) / 5) for k, w in ((i // 5, cut[i : i + 5]) for i in range(0, len(cut), 5))]
        runs = []
        for _, p, d in rows:
            if runs and runs[-1][2] == p and runs[-1][3] == d:
                runs[-1][2] = p + 1
            else:
                runs.append(["c", p, p + 1, d])
        frame = spark.createDataFrame(runs, "contig string, p int, nx int, depth long")
        assert [tuple(r)[1:] for r in depth.window_means(frame).orderBy("win").collect()] == want
        islands, kept = [], [w for w in want if w[3] >= 5]
        for w in kept:
            if islands and islands[-1][2] == w[0] - 1:
                islands[-1] = (islands[-1][0], w[2], w[0])
            else:
                islands.append((w[1], w[2], w[0]))
        assert sorted((r.start, r.end) for r in depth.islands(frame, min_len=20).collect()) == [(a, b) for a, b, _ in islands if b - a >= 20]


def test_numbers_over_ranges(spark):
    from lumenseq.operators.numbering import numbered

    frame = spark.range(1000).select((F.col("id") * 7919 % 100).alias("x"), "id").repartition(7)
    got = numbered(frame, [F.desc("x"), F.asc("id")], "k").orderBy("k").collect()
    assert [r.k for r in got] == list(range(1, 1001)) and [(-r.x, r.id) for r in got] == sorted((-r.x, r.id) for r in got)
    assert numbered(frame.limit(0), [F.asc("x")], "k").count() == 0


def test_package_stands_without_its_llm_part(tmp_path):
    """In a copy without the subpackage, its tests and corpus_pipeline.py the entry still lists the other queries; a broken import inside it shows."""
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(x.startswith('op1') for x in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy).returncode == 0
    (copy / "lumenseq" / "llm").mkdir()
    (copy / "lumenseq" / "llm" / "__init__.py").write_text("")
    (copy / "lumenseq" / "llm" / "queries.py").write_text("import lumenseq.no_such_module")
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True).returncode == 1
