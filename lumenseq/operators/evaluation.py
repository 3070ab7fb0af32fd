"""Scores of assemblies against ground truth.

Placements are alignments of contigs to truths: method, contig_id, truth_id, ord (their order), start, end
(0-based, half open, on the truth), ref_len, score and the error counts of `score_alignments`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .depth import covered_bases

OPERATION = re.compile(r"(\d+)(\D)")
TURN = bytes.maketrans(b"ACGT", b"TGCA")
COUNTS = ["mismatches", "ins_count", "ins_len", "del_count", "del_len", "unknown"]


def nx(lengths: DataFrame, share: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """The largest length such that contigs as long or longer hold `share` of all bases.

    lengths: len, and the grouping columns. Equal lengths are summed before the running sum, so
    the window sees distinct lengths only.
    """
    by = by or []
    sums = lengths.groupBy(*by, "len").agg(F.sum("len").alias("bases"))
    w = Window.partitionBy(*by)
    running = sums.withColumn("run", F.sum("bases").over(w.orderBy(F.desc("len")))).withColumn("all", F.sum("bases").over(w))
    return running.where(F.col("run") >= F.col("all") * share).groupBy(*by).agg(F.max("len").alias("nx"))


def report_means(report: DataFrame, stats: str = "stat") -> DataFrame:
    """(stat, mean) over a wide report's other columns, missing values left out; a stat without
    any value is absent."""
    strains = [c for c in report.columns if c != stats]
    long = report.unpivot(stats, strains, "strain", "value")
    return long.where("value is not null").groupBy(stats).agg(F.avg("value").alias("mean"))


def error_rate(unknown: Column, mismatch: Column, indel: Column) -> Column:
    """Percent, from counts per 100 kbp."""
    return (unknown + mismatch + indel) / 1000


def measured(contig: bytes, truth: bytes, pos: int, cigar: str) -> tuple:
    """(score, *COUNTS, start, end) of one alignment; pos is 0-based, contig on the alignment's strand.

    The alignment is laid out as columns: each one's operation, place on the contig and place on the truth. Clipped ends count as
    aligned as far as the truth reaches; the rear one is compared by its own last bases, also where the truth is the shorter one. A symbol N of either is
    unknown; insertions at an alignment's ends aren't counted as such.
    """
    parts = OPERATION.findall(cigar)
    sizes, kind = np.array([int(n) for n, _ in parts]), np.frombuffer("".join(o for _, o in parts).encode(), np.uint8)
    clip, both, alone, gone = (np.isin(kind, np.frombuffer(x, np.uint8)) for x in (b"SH", b"M=X", b"I", b"D"))
    if not (clip | both | alone | gone).all():
        raise ValueError(f"no rule for an operation of {cigar}")
    front = clip & (np.arange(len(kind)) == 0)
    rear = clip & ~front
    end = pos + int(sizes[both | gone].sum())
    reached = np.where(front, np.minimum(sizes, pos), np.where(rear, np.minimum(sizes, max(0, len(truth) - end)), 0))
    of = np.repeat(np.arange(len(kind)), sizes)  # a column's operation
    within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    on_contig = (np.cumsum(np.where(gone, 0, sizes)) - np.where(gone, 0, sizes))[of] + within
    shift = np.where(front, pos - sizes, pos + np.cumsum(np.where(both | gone, sizes, 0)) - np.where(both | gone, sizes, 0)) - np.where(rear, sizes - reached, 0)
    on_truth = shift[of] + within
    compared = both[of] | (front[of] & (on_truth >= 0)) | (rear[of] & (within >= (sizes - reached)[of]))
    own, ref = np.frombuffer(contig, np.uint8), np.frombuffer(truth, np.uint8)
    a, b = own[on_contig[compared]], ref[on_truth[compared]]
    unknown = (a == 78) | (b == 78)
    mismatched, inner = int(((a != b) & ~unknown).sum()), alone.copy()
    inner[[0, -1]] = False
    ins_len, del_len = int(sizes[inner].sum()), int(sizes[gone].sum())
    length = len(contig) - int((sizes - reached)[clip].sum())
    score = (mismatched + ins_len + del_len) / length if length > 0 else 0.0
    n_unknown = int(unknown.sum() + (own[on_contig[alone[of]]] == 78).sum())
    return score, mismatched, int(inner.sum()), ins_len, int(gone.sum()), del_len, n_unknown, pos - int(reached[front].sum()), end + int(reached[rear].sum())


def score_alignments(alignments: DataFrame, contigs: DataFrame, truths: DataFrame, max_score: float = 1.0) -> DataFrame:
    """Placements of score max_score or less, from alignments (method, contig_id, truth_id, flag, pos 1-based, cigar, ord).

    contigs: method, contig_id, seq; truths: truth_id, seq. Unmapped rows are left out; a reversed one is
    compared by its contig's reverse complement. The score is the edited share of the contig's aligned bases.
    """
    mapped = alignments.where("cigar <> '*' and (flag & 4) = 0").select("method", "contig_id", "truth_id", "ord", (F.col("flag").bitwiseAND(16) != 0).alias("back"), (F.col("pos") - 1).alias("pos"), "cigar")
    both = mapped.join(contigs.select("method", "contig_id", F.col("seq").alias("own")), ["method", "contig_id"]).join(truths.select("truth_id", F.col("seq").alias("ref")), "truth_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ref = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("own", "ref"))
            rows = [
                measured(o.translate(TURN)[::-1] if back else o, r, pos, cigar)
                for o, r, back, pos, cigar in zip(own, ref, *(batch.column(c).to_pylist() for c in ("back", "pos", "cigar")))
            ]
            columns = list(zip(*rows)) or [()] * 9
            arrays = [batch.column(c) for c in ("method", "contig_id", "truth_id", "ord")] + [pa.array(columns[0], pa.float64()), *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array(map(len, ref), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["method", "contig_id", "truth_id", "ord", "score", *COUNTS, "start", "end", "ref_len"])

    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("method", "contig_id", "truth_id", "ord"))
    found = both.select("method", "contig_id", "truth_id", "ord", "back", "pos", "cigar", "own", "ref").mapInArrow(run, f"{kinds}, score double, {', '.join(c + ' long' for c in COUNTS)}, start long, end long, ref_len long")
    return found.where(F.col("score") <= max_score)


def assigned(placements: DataFrame) -> DataFrame:
    """Each contig's best placements, alone or in pairs on one truth; ord is distinct in a contig.

    A placement's options are its pairs with later ones on its truth that it doesn't overlap by over a tenth of the truth, at the mean of
    both scores; one without any stands alone. Each placement's first least option is one row, and a contig's rows, one a placement, are folded in
    their order: the least from 1 on wins, equal ones stay as long as their truth is new, and a placement that the best option so far has makes no own.
    """
    key = ["method", "contig_id"]
    one = placements.select(*key, "truth_id", "ord", "start", "end", "ref_len", "score")
    later = one.select(*key, "truth_id", *(F.col(c).alias(f"{c}2") for c in ("ord", "start", "end", "score")))
    apart = (F.col("end2") <= F.col("start")) | (F.col("start2") >= F.col("end")) | (F.col("end") - F.col("start2") <= 0.1 * F.col("ref_len"))
    options = one.join(later, [*key, "truth_id"]).where((F.col("ord2") > F.col("ord")) & apart)
    mean = (F.col("score") + F.col("score2")) / 2
    pair = options.groupBy(*key, "ord").agg(F.min(F.struct(mean.alias("value"), F.col("ord2"), F.struct("truth_id", F.col("start2").alias("start"), F.col("end2").alias("end"), F.col("score2").alias("score")).alias("same"))).alias("pair"))
    placed = F.struct("ord", F.struct("truth_id", "start", "end", "score").alias("same"))
    second = F.struct(F.col("pair.ord2").alias("ord"), F.col("pair.same").alias("same"))
    steps = one.join(pair, [*key, "ord"], "left").select(*key, F.struct("ord", F.coalesce("pair.value", "score").alias("value"), F.when(F.col("pair").isNull(), F.array(placed)).otherwise(F.array(placed, second)).alias("taken")).alias("step"))
    by_contig = steps.groupBy(*key).agg(F.sort_array(F.collect_list("step")).alias("steps"))
    none = F.struct(F.lit(1.0).alias("least"), F.filter(F.flatten(F.transform("steps", lambda x: x["taken"])), lambda x: F.lit(False)).alias("best"))

    def fold(state, step):
        first = step["taken"][0]["same"]
        met = F.exists(state["best"], lambda x: x["same"] == first)
        told = F.exists(state["best"], lambda x: x["same"]["truth_id"] == first["truth_id"])
        better = F.struct(step["value"].alias("least"), step["taken"].alias("best"))
        longer = F.struct(state["least"].alias("least"), F.concat(state["best"], step["taken"]).alias("best"))
        return F.when(met, state).when(step["value"] < state["least"], better).when((step["value"] == state["least"]) & ~told, longer).otherwise(state)

    chosen = by_contig.select(*key, F.explode(F.array_distinct(F.transform(F.aggregate("steps", none, fold)["best"], lambda x: x["ord"]))).alias("ord"))
    return placements.join(chosen, [*key, "ord"], "left_semi")


def precision_recall(assignments: DataFrame, n_truth: int, most: int = 5, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(by, threshold, precision, recall, f) for edit distances up to 0 .. most percent.

    assignments: by, contig_id, truth_id, aln_len, edit_dist. The least rate of each contig and
    of each truth is aggregated first; thresholds then only look at these.
    """
    rate = F.try_divide(F.col("edit_dist"), F.col("aln_len"))
    thresholds = assignments.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("threshold"))

    def within(key: str) -> DataFrame:
        best = assignments.groupBy(*by, key).agg(F.min(rate).alias("rate"))
        met = best.crossJoin(F.broadcast(thresholds))  # most + 1 rows
        return met.groupBy(*by, "threshold").agg(F.count_if(F.col("rate") <= F.col("threshold") / 100).alias("hit"), F.count("*").alias("n"))

    contigs, truths = within("contig_id"), within("truth_id")
    both = contigs.select(*by, "threshold", (F.col("hit") / F.col("n")).alias("precision")).join(truths.select(*by, "threshold", (F.col("hit") / F.lit(n_truth)).alias("recall")), [*by, "threshold"])
    f = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.try_divide(F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return both.withColumn("f", f)


def mean_std(scores: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and population standard deviation of each value over samples: {value}_mean, {value}_std."""
    return scores.groupBy(*by).agg(*(x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"))))


def relative_error(true: Column, estimated: Column) -> Column:
    """|t - e| over their mean; 0 if both are 0."""
    return F.when(true + estimated == 0, 0.0).otherwise(F.try_divide(F.abs(true - estimated), 0.5 * (true + estimated)))


def true_contig_frequencies(assignments: DataFrame, truth: DataFrame) -> DataFrame:
    """(method, contig_id, freq): the summed frequency of a contig's truths, over what the method
    assembled in all. A truth that a contig is assigned to twice counts twice."""
    rows = assignments.select("method", "contig_id", "truth_id").join(truth, "truth_id")
    own = rows.groupBy("method", "contig_id").agg(F.sum("freq").alias("own"))
    assembled = rows.select("method", "truth_id", "freq").distinct().groupBy("method").agg(F.sum("freq").alias("assembled"))
    return own.join(assembled, "method").select("method", "contig_id", (F.col("own") / F.col("assembled")).alias("freq"))


def frequency_errors(placed: DataFrame, truth: DataFrame, contigs: DataFrame, min_share: float = 0.5) -> DataFrame:
    """(method, truth_id, estimated, true, absolute, relative), percent, of truths with an estimate.

    placed: method, contig_id, truth_id, ord; truth: truth_id, ord, len, freq; contigs: method, contig_id, len, ab. A
    contig is long for a truth if it is longer than min_share of it. The true total is that of truths with a long
    contig; the estimated one adds each contig once for every placement on a truth that it is long for. A contig
    is used up by the first of its truths, in their order, and credited there if it is long.
    """
    rows = placed.select("method", "contig_id", "truth_id", F.col("ord").alias("place")).join(contigs.select("method", "contig_id", F.col("len").alias("own"), "ab"), ["method", "contig_id"])
    rows = rows.join(truth.select("truth_id", F.col("ord").alias("rank"), "len", "freq"), "truth_id").withColumn("long", F.col("own") > min_share * F.col("len"))
    first = F.row_number().over(Window.partitionBy("method", "contig_id").orderBy("rank", "place")) == 1
    used = rows.withColumn("credit", F.when(first & F.col("long"), F.col("ab")).otherwise(0.0))
    per = used.groupBy("method", "truth_id", "freq").agg(F.sum("credit").alias("ab"), F.bool_or("long").alias("long"), F.sum(F.when(F.col("long"), F.col("ab")).otherwise(0.0)).alias("all_ab"))
    totals = per.groupBy("method").agg(F.sum(F.when(F.col("long"), F.col("freq"))).alias("all_freq"), F.sum("all_ab").alias("all_ab"))
    scored = per.drop("all_ab").join(totals, "method").where("ab > 0 and all_freq > 0 and all_ab > 0")
    est, true = 100 * F.col("ab") / F.col("all_ab"), 100 * F.col("freq") / F.col("all_freq")
    return scored.select("method", "truth_id", est.alias("estimated"), true.alias("true"), F.abs(est - true).alias("absolute"), (F.abs(est - true) / true).alias("relative"))


def error_summary(errors: DataFrame, value: str) -> DataFrame:
    """Median, least, largest and mean by method; null where only one strain was found."""
    told = lambda x: F.when(F.count("*") > 1, x)
    return errors.groupBy("method").agg(told(F.median(value)).alias("median"), told(F.min(value)).alias("least"), told(F.max(value)).alias("most"), told(F.avg(value)).alias("mean"))


#: Parts that truths are dealt to where each meets every method.
PARTS = 32


def min_distances(placed: DataFrame, truth: DataFrame) -> DataFrame:
    """(method, truth_id, distance): the least edited share of a truth's placements in percent; 100 without any.

    The result has every method with every truth. Truths are dealt to PARTS parts and methods, which are fewer, go to each of them.
    """
    distance = F.try_divide(F.col("mismatches") + F.col("ins_len") + F.col("del_len"), F.col("end") - F.col("start"))
    least = placed.groupBy("method", "truth_id").agg(F.min(distance).alias("least"))
    methods = placed.select("method").distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    every = truth.select("truth_id", F.pmod(F.hash("truth_id"), F.lit(PARTS)).alias("_part")).join(methods, "_part")
    return every.join(least, ["method", "truth_id"], "left").select("method", "truth_id", (100 * F.least(F.lit(1.0), F.coalesce("least", F.lit(1.0)))).alias("distance"))


def assembly_stats(placed: DataFrame, contigs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a method: lengths, summed errors and rates, target coverage, NX, breakpoints, exact contigs, sensitivity, PPV.

    contigs: method, contig_id, len, those without a placement too; truth: truth_id, len. A truth with n
    placements has n - 1 breakpoints. A contig is exact if a placement of it has no error; sensitivity is the share of
    truths with such a placement. Methods without contigs are absent; rates without aligned bases are 0.
    """
    dist = F.col("mismatches") + F.col("ins_len") + F.col("del_len")
    span = placed.withColumn("len", F.col("end") - F.col("start"))
    sums = span.groupBy("method").agg(
        F.sum("len").alias("aligned"), *(F.sum(c).alias(c) for c in COUNTS), F.countDistinct(F.when(dist == 0, F.col("contig_id"))).alias("n_exact"),
        F.countDistinct(F.when(dist == 0, F.col("truth_id"))).alias("n_truth_exact"), (F.count("*") - F.countDistinct("truth_id")).alias("breakpoints"),
    )
    targets = truth.agg(F.count("*").alias("n_truth"), F.sum("len").alias("target"))
    covered = covered_bases(placed.select(F.struct("method", "truth_id").alias("contig"), F.col("start").alias("s"), (F.col("end") - F.col("start")).alias("n")))
    covered = covered.groupBy(F.col("contig.method").alias("method")).agg(F.sum("covered").alias("covered"))
    assembly = contigs.groupBy("method").agg(F.count("*").alias("n_contigs"), F.sum("len").alias("assembly"))
    found = assembly.join(sums, "method", "left").join(covered, "method", "left").crossJoin(F.broadcast(targets))  # one row
    found = found.join(nx(contigs.select("method", "len"), by=["method"]).withColumnRenamed("nx", "n50"), "method").join(nx(span.select("method", "len"), by=["method"]).withColumnRenamed("nx", "n50_aligned"), "method", "left")
    found = found.na.fill(0)
    share = lambda x: F.coalesce(F.try_divide(x, F.col("aligned")), F.lit(0.0))
    return found.select(
        "method", "assembly", "aligned", (F.col("assembly") - F.col("aligned")).alias("unaligned"), "n_contigs", *COUNTS, "covered", "target", (F.col("covered") / F.col("target")).alias("target_coverage"),
        "n50", "n50_aligned", "breakpoints", "n_exact", "n_truth_exact", share(dist).alias("edit_rate"), share(F.col("mismatches")).alias("mismatch_rate"), share(F.col("unknown")).alias("unknown_rate"),
        share(F.col("ins_len")).alias("ins_rate"), share(F.col("del_len")).alias("del_rate"), (F.col("n_truth_exact") / F.col("n_truth")).alias("sensitivity"), (F.col("n_exact") / F.col("n_contigs")).alias("ppv"),
    )
