"""Registered queries of the sequence operators, and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequences as seqs
from .operators import alignments as aln
from .operators import clusters
from .operators import depth as dep
from .operators import divergence as div
from .operators import evaluation as ev
from .operators import graph, mapping
from .operators import overlaps as ov
from .operators.numbering import numbered
from .plans import evaluation, pipeline
from .plans.fixtures import fixture, with_clauses
from .session import materialized
from .sources import sequences, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *fixtures: str, columns: tuple[str, ...] | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of the named fixtures' DataFrames with its oracle; columns: all that it reads of them."""

    def register(function: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(*(fixture(spark, sf_dir, name, columns) for name in fixtures))

        QUERIES[function.__name__] = run
        if sql:
            ORACLE_SQL[function.__name__] = f"{with_clauses(*fixtures)} {sql}"
        return function

    return register


def lengths_of(reads: DataFrame) -> DataFrame:
    return reads.withColumn("len", F.length("seq"))


@query("select id, ord, length(seq) len from reads", "reads")
def reads_scan(reads):
    return lengths_of(reads).select("id", "ord", "len")


@query("select id, length(seq) len, row_number() over (order by length(seq) desc, ord) as rank from reads", "reads")
def reads_length_sort(reads):
    return numbered(materialized(lengths_of(reads).select("id", "ord", "len")), [F.desc("len"), F.asc("ord")], "rank").select("id", "len", "rank")


@query("select id, length(seq) len from reads order by length(seq) desc, ord limit 100", "reads")
def top_k_reads(reads):
    return lengths_of(reads).orderBy(F.desc("len"), "ord").limit(100).select("id", "len")


@query("select count(*) n, sum(length(seq)) bases from reads", "reads")
def reads_count(reads):
    return reads.agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"))


@query("select 'r' || cast(row_number() over (order by length(seq) desc, ord) as varchar) as name, id from reads", "reads")
def rename_by_rank(reads):
    ranked = numbered(materialized(lengths_of(reads).select("id", "ord", "len")), [F.desc("len"), F.asc("ord")], "rank")
    return ranked.select(seqs.numbered_name("r", F.col("rank")).alias("name"), "id")


@query("select id, reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) rc from reads", "reads")
def revcomp_strict(reads):
    return reads.select("id", seqs.reverse_complement_strict(F.col("seq")).alias("rc"))


@query("select id, reverse(translate(seq, 'ACGT', 'TGCA')) rc from reads", "reads")
def revcomp_permissive(reads):
    return reads.select("id", seqs.reverse_complement(F.col("seq")).alias("rc"))


@query("select id, rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) wrapped from reads", "reads")
def fasta_wrap(reads):
    return reads.select("id", seqs.wrapped(F.col("seq")).alias("wrapped"))


@query("select id, '>' || id || chr(10) || seq record from reads", "reads")
def fasta_format(reads):
    return reads.select("id", seqs.fasta_record(F.col("id"), F.col("seq")).alias("record"))


@query("select id, substring(seq, 11, 40) piece from reads", "reads")
def substring_slice(reads):
    return reads.select("id", seqs.bases(F.col("seq"), F.lit(11), F.lit(50)).alias("piece"))


@query("select id, length(seq) len from reads where length(seq) >= 1000", "reads")
def reads_min_length(reads):
    return lengths_of(reads).where("len >= 1000").select("id", "len")


@query("select max(len) as nx from (select len, sum(len) over (order by len desc) run, sum(len) over () total from (select length(seq) len from reads)) where run >= total * 0.5e0", "reads")
def nx50(reads):
    return ev.nx(lengths_of(reads))


@query(
    """select id, len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda p: p[1] <> 'N' and p[2] <> 'N' and p[1] <> p[2])) mismatched,
  len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda p: p[1] = 'N' or p[2] = 'N')) unknown
from (select id, translate(seq, 'T', 'N') a, substring(reverse(seq), 1, length(seq)) b from reads)""",
    "reads",
)
def hamming_n(reads):
    pair = reads.select("id", seqs.mismatches(F.translate("seq", "T", "N"), F.reverse("seq")).alias("x"))
    return pair.select("id", "x.mismatched", "x.unknown")


QUALITY = "alnlen >= 600 and nmatch * 1e0 / alnlen >= 0.95"
OVERHANG = "least(qs, case when strand = '-' then tl - te else ts end) + least(ql - qe, tl - case when strand = '-' then tl - ts else te end)"
INTERNAL = f"({OVERHANG}) > least(300e0, greatest(qe - qs, te - ts) * 0.8e0)"
PAIR = "partition by least(qn, tn), greatest(qn, tn) order by alnlen desc, ord"
CHAIN = f"select * from (select *, row_number() over ({PAIR}) k from ovl where {QUALITY} and not ({INTERNAL}) and qn <> tn) where k = 1"
LIMITS = {"min_len": 600, "min_identity": 0.95, "most": 300, "ratio": 0.8}


@query(f"select ord, qn, tn, alnlen from ovl where {QUALITY}", "ovl")
def overlap_quality(ovl):
    return ovl.where(ov.good(600, 0.95)).select("ord", "qn", "tn", "alnlen")


@query(f"select ord, {OVERHANG} overhang, {INTERNAL} internal from ovl", "ovl")
def overlap_internal(ovl):
    return ovl.select("ord", ov.overhang().alias("overhang"), ov.internal(300, 0.8).alias("internal"))


@query("select ord, qn, tn from ovl where qn <> tn", "ovl")
def overlap_self(ovl):
    return ovl.where("qn <> tn").select("ord", "qn", "tn")


@query(f"select ord, qn, tn, alnlen from (select *, row_number() over ({PAIR}) k from ovl) where k = 1", "ovl")
def overlap_dedup(ovl):
    return ov.longest_per_pair(ovl).select("ord", "qn", "tn", "alnlen")


@query(f"select ord, qn, tn, alnlen from ({CHAIN})", "ovl")
def overlap_chain(ovl):
    return ov.chain(ovl, **LIMITS).select("ord", "qn", "tn", "alnlen")


@query(
    f"""select distinct ord, qn, tn from (select *, row_number() over (partition by r order by alnlen desc, ord) j
from (select *, unnest([qn, tn]) r from ({CHAIN}))) where j <= 20""",
    "ovl",
)
def overlap_topn_union(ovl):
    return ov.top_n(ov.chain(ovl, **LIMITS), 20).select("ord", "qn", "tn")


@query("select ord, qn, tn from (select *, row_number() over (partition by tn order by alnlen desc, ord) k from ovl) where k <= 20", "ovl")
def overlap_topn_star(ovl):
    return ov.top_n_of_seed(ovl, 20).select("ord", "qn", "tn")


@query(
    f"""select count(*) filter (where {INTERNAL}) n_internal, count(*) filter (where not ({INTERNAL}) and qn = tn) n_self,
  count(*) filter (where not ({INTERNAL}) and qn <> tn) - count(distinct case when not ({INTERNAL}) and qn <> tn then least(qn, tn) || ' ' || greatest(qn, tn) end) n_duplicate
from ovl where {QUALITY}""",
    "ovl",
)
def overlap_counters(ovl):
    return ov.counters(ovl, **LIMITS)


@query("select qn src, tn dst, strand, alnlen from ovl union all select tn, qn, strand, alnlen from ovl", "ovl")
def overlap_edges(ovl):
    return ov.edges(ovl)


@query("select count(*) n_reads, count(*) filter (where id not in (select qn from ovl where alnlen >= 2500 union select tn from ovl where alnlen >= 2500)) n_lost from (select distinct 'r' || cast(ord as varchar) id from reads)", "reads", "ovl")
def lost_reads(reads, ovl):
    return ov.lost_reads(reads.select(F.concat(F.lit("r"), F.col("ord").cast("string")).alias("id")), ovl.where("alnlen >= 2500"))


@query(
    """, ends as (select qn seed, tn id, alnlen, ord, strand from ovl where qn <> tn union all select tn, qn, alnlen, ord, strand from ovl where qn <> tn),
star as (select * from (select *, row_number() over (partition by seed, id order by alnlen desc, ord) k from ends where cast(substring(seed, 2) as bigint) % 50 = 0) where k = 1)
select distinct seed, seed id, 1 as rank, '+' strand from star
union all select seed, id, row_number() over (partition by seed order by alnlen desc, ord) + 1, strand from star""",
    "ovl",
)
def star_order_strand(ovl):
    seeds = ovl.select(F.explode(F.array("qn", "tn")).alias("seed")).distinct().where(F.substring("seed", 2, 20).cast("long") % 50 == 0)
    return ov.star_orders(ovl, seeds)


@query("select qname, rname, flag & 16 <> 0 as reversed, flag & 4 <> 0 as unmapped from alignments", "alignments")
def flag_bits(alignments):
    return alignments.select("qname", "rname", seqs.has_flag(F.col("flag"), 16).alias("reversed"), seqs.has_flag(F.col("flag"), 4).alias("unmapped"))


@query("select qname, rname, pos - 1 as pos0 from alignments where (flag & 3584) = 0", "alignments")
def sam_flag_filter(alignments):
    return aln.without(alignments).select("qname", "rname", (F.col("pos") - 1).alias("pos0"))


@query(
    """select qname, rname, pos, len(regexp_extract_all(cigar, '[0-9]+[A-Z]')) n_ops, cast(list_sum(cast(regexp_extract_all(cigar, '[0-9]+') as int[])) as bigint) total,
  array_to_string(regexp_extract_all(cigar, '[A-Z]'), '') letters from alignments""",
    "alignments",
)
def cigar_ops(alignments):
    c = F.col("cigar")
    total = F.aggregate(seqs.cigar_lengths(c), F.lit(0).cast("long"), lambda a, n: a + n)
    return alignments.select("qname", "rname", "pos", F.size(seqs.cigar_letters(c)).cast("long").alias("n_ops"), total.alias("total"), F.array_join(seqs.cigar_letters(c), "").alias("letters"))


LC = "coalesce(try_cast(nullif(regexp_extract(cigar, '^([0-9]+)S', 1), '') as int), 0)"
RC = "coalesce(try_cast(nullif(regexp_extract(cigar, '([0-9]+)S$', 1), '') as int), 0)"
POINTS = f"select rname, case when {LC} >= 5 then pos else pos + length(seq) - {RC} end bp from alignments where (flag & 4) = 0 and ({LC} >= 5 or {RC} >= 5)"


@query(f"select qname, cut seq from (select qname, substring(seq, {LC} + 1, length(seq) - {LC} - {RC}) cut from alignments where (flag & 4) = 0) where length(cut) >= 200", "alignments")
def softclip_trim(alignments):
    return aln.clipped_off(alignments, 200)


@query(f"select rname, bp, count(*) n from ({POINTS}) group by 1, 2 having count(*) >= 10", "alignments")
def clip_breakpoints(alignments):
    return aln.breakpoints(alignments)


@query(
    f""", p as (select rname, bp from ({POINTS}) group by 1, 2 having count(*) >= 10), l as (select rname, max(pos + length(seq)) len from alignments group by 1),
s as (select distinct * from (select rname, len, 1 as a from l union all select p.rname, len, bp from p join l using (rname) where bp > 1 and bp <= len)),
t as (select rname, a, coalesce(lead(a) over (partition by rname order by a) - 1, len) b, count(*) over (partition by rname) n from s)
select rname, a as first, b as last from t where n = 1 or b - a + 1 >= 50""",
    "alignments",
)
def clip_split(alignments):
    lengths = alignments.groupBy("rname").agg(F.max(F.col("pos") + F.length("seq")).alias("len"))
    return aln.clip_split(lengths, aln.breakpoints(alignments), 50)


SWEEP = """, e as (select contig, p, sum(d) d from (select contig, s p, 1 d from intervals union all select contig, s + n, -1 from intervals) group by 1, 2),
r as (select * from (select contig, p, sum(d) over (partition by contig order by p) depth, lead(p) over (partition by contig order by p) nx from e) where depth > 0)"""
BASES = SWEEP + ", d as (select contig, unnest(range(p, nx)) pos, depth from r)"
MEANS = (
    BASES
    + """, n as (select *, row_number() over (partition by contig order by pos) rn from d),
b as (select contig, min(rn) lo, max(rn) hi from n where depth >= 5 group by 1),
w as (select n.contig, floor((rn - lo) / 5) win, min(pos) start, max(pos) "end", sum(depth) / 5e0 mean from n join b on n.contig = b.contig and rn between lo and hi group by 1, 2)"""
)
ISLANDS = (
    MEANS
    + """, g as (select *, win - row_number() over (partition by contig order by win) island from w where mean >= 5),
i as (select contig, min(start) start, max("end") "end" from g group by contig, island having max("end") - min(start) >= 100)"""
)


@query(BASES + " select contig, pos, cast(depth as bigint) depth from d", "intervals")
def depth_sweep(intervals):
    return dep.per_base(intervals)


@query(SWEEP + " select contig, cast(sum(nx - p) as bigint) covered from r group by 1", "intervals")
def covered_bases(intervals):
    return dep.covered_bases(intervals)


def contig_lengths(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("contig").agg(F.max(F.col("s") + F.col("n")).alias("len"))


LENGTHS = "(select contig, max(s + n) len, coalesce(sum(case when identity >= 0.97e0 then n end), 0) bases from intervals group by 1)"


@query(f"select contig, len, bases * 1e0 / len depth from {LENGTHS}", "intervals")
def mean_depth(intervals):
    return dep.mean_depth(intervals, contig_lengths(intervals))


@query(f"select contig, round(depth / sum(depth) over (), 9) freq from (select contig, bases * 1e0 / len depth from {LENGTHS})", "intervals")
def rel_abundance(intervals):
    return dep.relative_abundance(dep.mean_depth(intervals, contig_lengths(intervals))).select("contig", F.round("freq", 9).alias("freq"))


@query(
    f"""select contig, row_number() over (order by freq desc, contig) hap from (select contig, depth / sum(depth) over () freq
from (select contig, bases * 1e0 / len depth from {LENGTHS})) where freq >= 0.002""",
    "intervals",
)
def abundance_filter_rank(intervals):
    return dep.abundant(dep.relative_abundance(dep.mean_depth(intervals, contig_lengths(intervals))), 0.002).select("contig", "hap")


@query(MEANS + ' select contig, cast(win as bigint) win, start, "end", mean from w', "intervals")
def windowed_depth(intervals):
    return dep.window_means(dep.runs(intervals)).select("contig", "win", "start", "end", "mean")


@query(ISLANDS + ' select contig, start, "end" from i', "intervals")
def coverage_islands(intervals):
    return dep.islands(dep.runs(intervals), min_len=100)


@query(
    ISLANDS
    + f""", q as (select i.*, len, row_number() over (partition by contig order by start) piece, count(*) over (partition by contig) n from i join {LENGTHS} using (contig))
select contig, piece, case when n > 1 and piece = 1 then 1 else start end as first, case when n > 1 and piece = n then len else "end" end as last from q""",
    "intervals",
)
def coverage_split(intervals):
    return dep.coverage_split(dep.runs(intervals), contig_lengths(intervals), min_len=100)


LOSERS = "select distinct case when contained = 1 then x when contained = 2 then y when gdiv < 0.05 and l1 <= l2 then x when gdiv < 0.05 then y end id from pairs"


@query(", c as (select id, cast(floor(id / 6e1) as int) list from contig_lengths) select a.list, a.id a, b.id b from c a join c b on a.list = b.list and a.id < b.id", "contig_lengths")
def all_pairs(contig_lengths):
    return div.pairs_of_lists(contig_lengths.select("id", F.floor(F.col("id") / 60).cast("int").alias("list")), "list")


@query(f"select id from ({LOSERS}) where id is not null", "pairs")
def redundancy_losers(pairs):
    return div.losers(pairs, 0.05)


@query(f"select id from (select x id from pairs union select y from pairs) where id not in (select id from ({LOSERS}) where id is not null)", "pairs")
def redundancy_keep(pairs):
    return div.kept(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), pairs, 0.05)


DIVERGENCE = """, u as (select x, y, 1 side, xs s, xs + xn e from pair_alignments union all select x, y, 2, ys, ys + yn from pair_alignments),
v as (select *, max(e) over (partition by x, y, side order by s, e rows between unbounded preceding and 1 preceding) pe from u),
cov as (select x, y, sum(case when side = 1 then new end) cov1, sum(case when side = 2 then new end) cov2 from (select *, greatest(0, e - greatest(s, coalesce(pe, s))) new from v) group by 1, 2),
sums as (select x, y, sum(nmatch) m, sum(alnlen) l from pair_alignments group by 1, 2),
dv as (select x, y, round(1 - m * 1e0 / (l + a.len - cov1 + b.len - cov2), 4) as global, round(1 - m * 1e0 / l, 4) as local, l, a.len l1, b.len l2
  from sums join cov using (x, y) join contig_lengths a on a.id = x join contig_lengths b on b.id = y),
dc as (select x, y, global, local, case when l1 - l <= 5 and local < 0.05 then 1 when l2 - l <= 5 and local < 0.05 then 2 else 0 end contained from dv)"""


@query(DIVERGENCE + " select * from dc", "pair_alignments", "contig_lengths")
def divergence_formula(pair_alignments, contig_lengths):
    return div.divergence(div.pair_sums(pair_alignments, contig_lengths), 5, 0.05).select("x", "y", "global", "local", "contained")


@query(
    DIVERGENCE
    + """, c as (select id, cast(floor(id / 6e1) as int) list from contig_lengths)
select a.id x, b.id y, coalesce(global, 1e0) as global, coalesce(local, 1e0) as local, coalesce(contained, 0) contained
from c a join c b on a.list = b.list and a.id < b.id left join dc on dc.x = a.id and dc.y = b.id""",
    "pair_alignments",
    "contig_lengths",
)
def divergence_table(pair_alignments, contig_lengths):
    known = div.divergence(div.pair_sums(pair_alignments, contig_lengths), 5, 0.05)
    pairs = all_pairs(contig_lengths).select(F.col("a").alias("x"), F.col("b").alias("y"))
    return div.with_default(pairs, known)


RATES = "select method, {k}, min(edit_dist * 1e0 / aln_len) rate from assignments group by 1, 2"


@query(
    f""", c as ({RATES.format(k='contig_id')}), t as ({RATES.format(k='truth_id')}), th as (select unnest(range(6)) threshold),
p as (select method, threshold, count(*) filter (where rate <= threshold / 1e2) * 1e0 / count(*) prec from c, th group by 1, 2),
q as (select method, threshold, count(*) filter (where rate <= threshold / 1e2) / 12e0 rec from t, th group by 1, 2)
select method, threshold, prec as precision, rec recall, case when prec + rec = 0 then 0e0 else 2 * (prec * rec / (prec + rec)) end f from p join q using (method, threshold)""",
    "assignments",
)
def precision_recall_f(assignments):
    return ev.precision_recall(assignments, 12)


SAMPLES = RATES.replace("method", "method, sample").replace("1, 2", "1, 2, 3")


@query(
    f""", c as ({SAMPLES.format(k='contig_id')}), t as ({SAMPLES.format(k='truth_id')}), th as (select unnest(range(6)) threshold),
p as (select method, sample, threshold, count(*) filter (where rate <= threshold / 1e2) * 1e0 / count(*) prec from c, th group by 1, 2, 3),
q as (select method, sample, threshold, count(*) filter (where rate <= threshold / 1e2) / 12e0 rec from t, th group by 1, 2, 3),
f as (select *, case when prec + rec = 0 then 0e0 else 2 * (prec * rec / (prec + rec)) end f from p join q using (method, sample, threshold))
select method, threshold, round(avg(prec), 9) precision_mean, round(stddev_pop(prec), 9) precision_std, round(avg(rec), 9) recall_mean, round(stddev_pop(rec), 9) recall_std,
  round(avg(f), 9) f_mean, round(stddev_pop(f), 9) f_std from f group by 1, 2""",
    "assignments",
)
def prec_recall_mean_std(assignments):
    scores = ev.precision_recall(assignments, 12, by=("method", "sample"))
    found = ev.mean_std(scores, ["method", "threshold"], ["precision", "recall", "f"])
    return found.select("method", "threshold", *(F.round(c, 9).alias(c) for c in found.columns[2:]))


TRUE = """select method, contig_id, round(own / assembled, 9) freq from (select method, contig_id, sum(freq) own from assignments join truth using (truth_id) group by 1, 2)
join (select method, sum(freq) assembled from (select distinct method, truth_id, freq from assignments join truth using (truth_id)) group by 1) using (method)"""


@query("select * from (" + TRUE + ")", "assignments", "truth")
def true_contig_freq(assignments, truth):
    return ev.true_contig_frequencies(assignments, truth).select("method", "contig_id", F.round("freq", 9).alias("freq"))


# Each rule in the order of the survey: which contigs are long for a truth; the totals; who takes a contig; the errors.
ERRORS = """, placed as (select a.method, a.contig_id, a.truth_id, t.ord truth_ord, a.ord, t.freq, c.ab, c.len > 0.5e0 * t.len full_len
  from assignments a join contigs c on c.method = a.method and c.contig_id = a.contig_id join truth t on t.truth_id = a.truth_id),
tot as (select method, (select sum(freq) from (select distinct truth_id, freq from placed q where q.method = p.method and q.full_len)) all_freq, sum(case when full_len then ab else 0 end) all_ab from placed p group by method),
taken as (select * from (select *, row_number() over (partition by method, contig_id order by truth_ord, ord) k from placed) where k = 1 and full_len),
err as (select method, truth_id, 100 * sum(ab) / any_value(all_ab) e, 100 * any_value(freq) / any_value(all_freq) t from taken join tot using (method) group by 1, 2)"""


@query(ERRORS + " select method, truth_id, round(e, 9) estimated, round(t, 9) as true, round(abs(e - t), 9) absolute, round(abs(e - t) / t, 9) relative from err", "assignments", "truth", "contigs")
def freq_eval(assignments, truth, contigs):
    found = ev.frequency_errors(assignments, truth, contigs)
    return found.select("method", "truth_id", *(F.round(c, 9).alias(c) for c in ("estimated", "true", "absolute", "relative")))


@query(
    ERRORS
    + """ select method, case when n > 1 then a end median, case when n > 1 then b end least, case when n > 1 then c end most, case when n > 1 then d end mean
from (select method, count(*) n, round(median(abs(e - t)), 9) a, round(min(abs(e - t)), 9) b, round(max(abs(e - t)), 9) c, round(avg(abs(e - t)), 9) d from err group by 1)""",
    "assignments",
    "truth",
    "contigs",
)
def error_summary(assignments, truth, contigs):
    found = ev.error_summary(ev.frequency_errors(assignments, truth, contigs), "absolute")
    return found.select("method", *(F.round(c, 9).alias(c) for c in ("median", "least", "most", "mean")))


@query(
    f""", tr as ({TRUE}), es as (select method, contig_id, ab / sum(ab) over (partition by method) est from contigs)
select method, round(100 * avg(case when freq + est = 0 then 0e0 else abs(freq - est) / (0.5e0 * (freq + est)) end), 6) error from tr join es using (method, contig_id) group by 1""",
    "assignments",
    "truth",
    "contigs",
)
def abundance_rel_error(assignments, truth, contigs):
    estimated = contigs.join(contigs.groupBy("method").agg(F.sum("ab").alias("all")), "method").select("method", "contig_id", (F.col("ab") / F.col("all")).alias("est"))
    both = ev.true_contig_frequencies(assignments, truth.select("truth_id", "freq")).join(estimated, ["method", "contig_id"])
    return both.groupBy("method").agg(F.round(100 * F.avg(ev.relative_error(F.col("freq"), F.col("est"))), 6).alias("error"))


@query("select t.truth_id, count(a.contig_id) n_contigs, max(a.aln_len) longest from truth t left join (select * from assignments where edit_dist < 2) a using (truth_id) group by 1", "assignments", "truth")
def truth_outer(assignments, truth):
    near = assignments.where("edit_dist < 2")
    return truth.join(near, "truth_id", "left").groupBy("truth_id").agg(F.count("contig_id").alias("n_contigs"), F.max("aln_len").alias("longest"))


@query("select round(sum(freq), 9) freq from truth where truth_id in (select truth_id from assignments where edit_dist < 2)", "assignments", "truth")
def truth_semi(assignments, truth):
    return truth.join(assignments.where("edit_dist < 2"), "truth_id", "left_semi").agg(F.round(F.sum("freq"), 9).alias("freq"))


@query(
    """, ct as (select method, count(*) n_contigs, sum(len) assembly from contigs group by 1), tg as (select count(*) n_truth, sum(len) target from truth),
sm as (select method, sum(stop - start) aligned, sum(mismatches) mismatches, sum(ins_count) ins_count, sum(ins_len) ins_len, sum(del_count) del_count, sum(del_len) del_len, sum(unknown) unknown,
  count(distinct case when mismatches + ins_len + del_len = 0 then contig_id end) n_exact, count(distinct case when mismatches + ins_len + del_len = 0 then truth_id end) n_truth_exact from assignments group by 1),
br as (select method, sum(n - 1) breakpoints from (select method, truth_id, count(*) n from assignments group by 1, 2) group by 1),
cv as (select method, sum(greatest(0, stop - greatest(start, coalesce(pe, start)))) covered
  from (select *, max(stop) over (partition by method, truth_id order by start, stop rows between unbounded preceding and 1 preceding) pe from assignments) group by 1),
n1 as (select method, max(len) n50 from (select method, len, sum(len) over (partition by method order by len desc) run, sum(len) over (partition by method) total from contigs) where run >= total * 0.5e0 group by 1),
n2 as (select method, max(len) n50_aligned from (select method, len, sum(len) over (partition by method order by len desc) run, sum(len) over (partition by method) total from (select method, stop - start len from assignments)) where run >= total * 0.5e0 group by 1)
select method, cast(assembly as bigint) assembly, cast(aligned as bigint) aligned, cast(assembly - aligned as bigint) unaligned, n_contigs, cast(mismatches as bigint) mismatches, cast(ins_count as bigint) ins_count, cast(ins_len as bigint) ins_len,
  cast(del_count as bigint) del_count, cast(del_len as bigint) del_len, cast(unknown as bigint) unknown, cast(covered as bigint) covered, cast(target as bigint) target, covered * 1e0 / target target_coverage, n50, n50_aligned,
  cast(breakpoints as bigint) breakpoints, n_exact, n_truth_exact, (mismatches + ins_len + del_len) * 1e0 / aligned edit_rate, mismatches * 1e0 / aligned mismatch_rate, unknown * 1e0 / aligned unknown_rate,
  ins_len * 1e0 / aligned ins_rate, del_len * 1e0 / aligned del_rate, n_truth_exact * 1e0 / n_truth sensitivity, n_exact * 1e0 / n_contigs ppv
from ct join sm using (method) join br using (method) join cv using (method) join n1 using (method) join n2 using (method), tg""",
    "assignments",
    "contigs",
    "truth",
)
def assembly_stats(assignments, contigs, truth):
    return ev.assembly_stats(assignments.withColumnRenamed("stop", "end"), contigs, truth)


@query(
    """select m.method, t.truth_id, 100 * least(1e0, coalesce(min((mismatches + ins_len + del_len) * 1e0 / (stop - start)), 1e0)) distance
from (select distinct method from assignments) m cross join truth t left join assignments a on a.method = m.method and a.truth_id = t.truth_id group by 1, 2""",
    "assignments",
    "truth",
)
def min_distances(assignments, truth):
    return ev.min_distances(assignments.withColumnRenamed("stop", "end"), truth)


@query("select stat, avg(value) mean from (select method stat, unnest([nullif(mismatches, 7), ins_len, del_len]) value from (select method, max(mismatches) mismatches, max(ins_len) ins_len, min(del_len) del_len from assignments group by 1)) where value is not null group by 1", "assignments")
def report_average(assignments):
    wide = assignments.groupBy(F.col("method").alias("stat")).agg(F.nullif(F.max("mismatches"), F.lit(7)).cast("long").alias("s1"), F.max("ins_len").alias("s2"), F.min("del_len").alias("s3"))
    return ev.report_means(wide)


@query("select contig_id, (sum(mismatches) + sum(ins_len) + sum(del_len)) / 1e3 rate from assignments group by 1", "assignments")
def error_rate(assignments):
    return assignments.groupBy("contig_id").agg(ev.error_rate(F.sum("del_len"), F.sum("mismatches"), F.sum("ins_len")).alias("rate"))


@query("select contig_id, method, cast(aln_len as double) / 1e3 freq from assignments", "assignments")
def abundance_parse(assignments):
    headers = assignments.select("contig_id", "method", F.format_string("%s len=7 freq=%d.%03d", "contig_id", (F.col("aln_len") / 1000).cast("long"), F.col("aln_len") % 1000).alias("header"))
    return headers.select("contig_id", "method", seqs.abundance(F.col("header")).alias("freq"))


@query("select o.ord, length(r.seq) len from ovl o join reads r on r.ord = cast(substring(o.qn, 2) as bigint)", "ovl", "reads")
def seq_lookup(ovl, reads):
    keyed = reads.select((F.concat(F.lit("r"), F.col("ord").cast("string"))).alias("qn"), F.length("seq").alias("len"))
    return ovl.select("ord", "qn").join(keyed, "qn").select("ord", "len")


@query("select id from (select qn id from ovl union select tn from ovl)", "ovl")
def distinct_ids(ovl):
    return ovl.select("qn").union(ovl.select("tn")).distinct().toDF("id")


@query("select id, 1 as part from reads where length(seq) >= 2000 union all select id, 2 from reads where length(seq) < 500", "reads")
def union_all(reads):
    long_ones = lengths_of(reads).where("len >= 2000").select("id", F.lit(1).alias("part"))
    return long_ones.unionByName(lengths_of(reads).where("len < 500").select("id", F.lit(2).alias("part")))


def as_lines(rows: DataFrame, *columns: str, order: str = "ord") -> DataFrame:
    """Lines (file, ord, value) of a tab-separated file that holds the rows."""
    return materialized(rows.select(F.lit("f").alias("file"), F.col(order).cast("long").alias("ord"), tables.fields_line(*columns).alias("value")))


@query("select ord, id, id || ' len=' || length(seq) header, seq from reads where seq <> ''", "reads")
def fasta_scan(reads):
    header = F.concat("id", F.lit(" len="), F.length("seq").cast("string"))
    records = materialized(reads.select(F.lit("f").alias("file"), "ord", seqs.fasta_record(header, seqs.wrapped(F.col("seq"))).alias("value")))
    return sequences.parse_fasta(records).select("ord", "id", "header", "seq")


@query("select ord, id, seq, repeat('I', length(seq)) qual from reads", "reads")
def fastq_scan(reads):
    four = F.array(F.concat(F.lit("@"), F.col("id"), F.lit(" x")), F.col("seq"), F.lit("+"), F.expr("repeat('I', length(seq))"))
    lines = reads.select(F.col("ord").alias("r"), F.posexplode(four).alias("k", "value")).select(F.lit("f").alias("file"), (F.col("r") * 4 + F.col("k")).alias("ord"), "value")
    return sequences.parse_fastq(lines).select("ord", "id", "seq", "qual")


@query("select ord, qn, ql, qs, qe, strand, tn, tl, ts, te, nmatch, alnlen, mapq, 'tp:A:P' tag from ovl", "ovl")
def paf_scan(ovl):
    names = [c.split()[0] for c in tables.PAF.split(", ")]
    lines = as_lines(ovl.withColumn("tag", F.lit("tp:A:P")), *names, "tag")
    return tables.parse_paf(lines).select("ord", *names, F.get("tags", F.lit(0)).alias("tag"))


@query("select qname, flag, rname, pos, cigar, seq from alignments", "alignments")
def sam_scan(alignments):
    full = alignments.withColumns({"mapq": F.lit(60), "rnext": F.lit("*"), "zero": F.lit(0), "qual": F.lit("*"), "ord": F.lit(1)})
    body = as_lines(full, "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "zero", "zero", "seq", "qual")
    head = body.limit(1).withColumn("value", F.lit("@HD\tVN:1.6"))
    return tables.parse_sam(head.unionByName(body)).select("qname", "flag", "rname", "pos", "cigar", "seq")


@query(f"select contig, len, bases * 1e0 / len depth from {LENGTHS}", "intervals")
def contig_depth_scan(intervals):
    found = mean_depth(intervals).withColumn("ord", F.lit(1))
    head = found.limit(1).select(F.lit("f").alias("file"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("contigName\tcontigLen\ttotalAvgDepth"), F.substring("contig", 1, 0)).alias("value"))
    return tables.parse_contig_depth(head.unionByName(as_lines(found, "contig", "len", "depth"))).select("contig", "len", "depth")


@query("select truth_id, freq from truth", "truth")
def frequency_scan(truth):
    lines = truth.select(F.lit("f").alias("file"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit(" "), "truth_id", F.lit("  "), F.col("freq").cast("string")).alias("value"))
    return tables.parse_frequencies(lines).select("truth_id", "freq")


@query("select method, contig_id, truth_id, aln_len, edit_dist, mismatches, ins_len, del_len from assignments", "assignments")
def assignment_scan(assignments):
    names = [c.split()[0] for c in tables.ASSIGNMENT.split(", ")]
    return tables.parse_fields(as_lines(assignments, *names), tables.ASSIGNMENT).select(*names)


@query("select method stat, unnest(['a', 'b', 'c']) ref, unnest([nullif(max(mismatches), 7) * 1e0, max(ins_len), min(del_len)]) as value from assignments group by 1", "assignments")
def report_scan(assignments):
    wide = assignments.groupBy("method").agg(F.nullif(F.max("mismatches"), F.lit(7)).alias("a"), F.max("ins_len").alias("b"), F.min("del_len").alias("c")).withColumn("ord", F.lit(1))
    head = wide.limit(1).select(F.lit("f").alias("file"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("stat\ta\tb\tc"), F.substring("method", 1, 0)).alias("value"))
    return tables.parse_report(head.unionByName(as_lines(wide, "method", "a", "b", "c")))


@query("select contig, 'hap' || cast(contig_no as varchar) as name, length(seq) len from (select distinct contig, cast(substring(contig, 2) as bigint) contig_no from intervals) join reads on ord = contig_no", "intervals", "reads")
def depth_lookup(intervals, reads):
    depths = contig_lengths(intervals).select("contig")
    known = reads.select(F.concat(F.lit("c"), F.col("ord").cast("string")).alias("contig"), "seq")
    return depths.join(known, "contig").select("contig", seqs.numbered_name("hap", F.substring("contig", 2, 20)).alias("name"), F.length("seq").alias("len"))


@query(
    """, c as (select id, length(seq) n, length(seq) >= 8 long, substring(seq, 1, length(seq) // 2) half from reads where seq <> ''),
s as (select id, n, case when long then 1 + length(half) - length(replace(half, 'G', '')) else 0 end mismatches, case when long then length(half) - length(replace(half, 'T', '')) else 0 end unknown,
  case when long then 2 else 0 end ins_len, case when long then 3 else 0 end del_len, case when long then 0 else 1 end "start" from c)
select id contig_id, mismatches, unknown, ins_len, del_len, "start", n + 1 as "end", (mismatches + ins_len + del_len) * 1e0 / n score from s where (mismatches + ins_len + del_len) * 1e0 / n <= 0.6e0""",
    "reads",
)
def score_alignments(reads):
    """Whole reads behind an A are the truth; contigs have two clipped bases, a first half with changed and unknown bases, two bases too many and three too few."""
    own = sequences_of(reads).withColumns({"n": F.length("seq"), "h": F.floor(F.length("seq") / 2).cast("int")})
    long, text = F.col("n") >= 8, lambda c: F.col(c).cast("string")
    changed = F.concat(F.lit("GG"), F.translate(F.substring("seq", F.lit(1), F.col("h")), "GT", "CN"), F.lit("AC"), F.substring("seq", F.col("h") + 4, F.col("n")))
    cigar = F.concat(F.lit("2S"), text("h"), F.lit("M2I3D"), (F.col("n") - F.col("h") - 3).cast("string"), F.lit("M"))
    rows = own.select(F.lit("m").alias("method"), F.col("id").alias("contig_id"), F.col("id").alias("truth_id"), F.lit(1).alias("ord"), F.lit(0).alias("flag"), F.lit(2).alias("pos"),
                      F.when(long, cigar).otherwise(F.concat(text("n"), F.lit("M"))).alias("cigar"), F.when(long, changed).otherwise(F.col("seq")).alias("own"), F.concat(F.lit("A"), "seq").alias("ref"))
    found = ev.score_alignments(rows.drop("own", "ref"), rows.select("method", "contig_id", F.col("own").alias("seq")), rows.select("truth_id", F.col("ref").alias("seq")), max_score=0.6)
    return found.select("contig_id", "mismatches", "unknown", "ins_len", "del_len", "start", "end", "score")


@query(
    """, p as (select method, contig_id, truth_id, ord, start, stop, edit_dist * 1e0 / aln_len score from assignments),
pairs as (select a.method, a.contig_id, a.ord, (a.score + b.score) / 2 v, b.ord ord2, {'t': b.truth_id, 'a': b.start, 'b': b.stop, 's': b.score} same2
  from p a join p b on a.method = b.method and a.contig_id = b.contig_id and a.truth_id = b.truth_id and b.ord > a.ord and (b.stop <= a.start or b.start >= a.stop or a.stop - b.start <= 0.1 * 2000)),
best as (select * from pairs qualify row_number() over (partition by method, contig_id, ord order by v, ord2) = 1),
steps as (select p.method, p.contig_id, row_number() over (partition by p.method, p.contig_id order by p.ord) k, coalesce(b.v, p.score) v, p.truth_id t, {'t': p.truth_id, 'a': p.start, 'b': p.stop, 's': p.score} same,
  case when b.ord is null then [{'o': p.ord, 'x': {'t': p.truth_id, 'a': p.start, 'b': p.stop, 's': p.score}}] else [{'o': p.ord, 'x': {'t': p.truth_id, 'a': p.start, 'b': p.stop, 's': p.score}}, {'o': b.ord2, 'x': b.same2}] end taken
  from p left join best b on b.method = p.method and b.contig_id = p.contig_id and b.ord = p.ord),
folded as (with recursive f as (
    select method, contig_id, 0 k, 1e0 least, [x for x in taken if false] got from steps where k = 1
    union all
    select s.method, s.contig_id, s.k, case when met then f.least when s.v < f.least then s.v else f.least end,
      case when met then f.got when s.v < f.least then s.taken when s.v = f.least and not told then list_concat(f.got, s.taken) else f.got end
    from f join steps s on s.method = f.method and s.contig_id = f.contig_id and s.k = f.k + 1, lateral (select len([x for x in f.got if x.x = s.same]) > 0 met, len([x for x in f.got if x.x.t = s.t]) > 0 told))
  select * from f qualify row_number() over (partition by method, contig_id order by k desc) = 1),
chosen as (select distinct method, contig_id, unnest([x.o for x in got]) ord from folded)
select a.method, a.contig_id, truth_id, a.ord, edit_dist * 1e0 / aln_len score, mismatches, ins_count, ins_len, del_count, del_len, unknown, start, stop as "end", 2000 ref_len
from assignments a join chosen c on c.method = a.method and c.contig_id = a.contig_id and c.ord = a.ord""",
    "assignments",
)
def assign_contigs(assignments):
    placed = assignments.select("method", "contig_id", "truth_id", "ord", (F.col("edit_dist") / F.col("aln_len")).alias("score"), *ev.COUNTS, "start", F.col("stop").alias("end"), F.lit(2000).alias("ref_len"))
    return ev.assigned(placed)


#: Documents share many words, so only long seeds tell a copied passage.
SEEDS = mapping.Settings(k=24, w=10, most=200, least=8, gap=200, reach=100)


def sequences_of(reads: DataFrame) -> DataFrame:
    return reads.where("seq <> ''").select("id", "seq")


@query(None, "reads")
def read_overlaps(reads):
    found = mapping.overlaps(sequences_of(reads), sequences_of(reads), SEEDS, once=True)
    return found.select("qn", "tn", "strand", "qs", "qe", "ts", "te", "nmatch", "alnlen")


def turned_contigs(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(method, contig_id, seq) and (truth_id, seq)."""
    own, half = sequences_of(reads), F.floor(F.length("seq") / 2).cast("int")
    swapped = own.select(F.lit("halves").alias("method"), F.col("id").alias("contig_id"), F.concat(F.substring("seq", half + 1, F.length("seq")), F.substring("seq", F.lit(1), half)).alias("seq"))
    return own.select(F.lit("whole").alias("method"), F.col("id").alias("contig_id"), "seq").unionByName(swapped), own.select(F.col("id").alias("truth_id"), "seq")


def clusters_of(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    ranked = numbered(sequences_of(reads).withColumn("len", F.length("seq")), [F.desc("len"), F.asc("id")], "rank")
    ranked = materialized(ranked)

    def filtered(seeds: DataFrame) -> DataFrame:
        found = mapping.overlaps(sequences_of(reads), seeds, SEEDS).withColumn("ord", F.xxhash64("qn", "tn"))
        return ov.chain(found, 500, 0.9, 300)

    return clusters.seed_clusters(ranked, filtered, topk=100, min_seed_len=500)


@query(None, "reads")
def seed_clusters(reads):
    return clusters_of(reads)[0]


@query(None, "reads")
def cluster_consensus(reads):
    members, found = clusters_of(reads)
    return clusters.consensus(members, sequences_of(reads), SEEDS, found)


@query(None, "reads")
def corrected_reads(reads):
    made = clusters.corrected(sequences_of(reads), SEEDS, min_len=300, min_identity=0.9)
    return made.select("id", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


@query(None, "reads")
def haplotypes(reads):
    p = pipeline.Parameters(min_trimmed_len=500, min_overlap_len=500, min_identity=0.9, min_seed_len=500, max_overhang=300, min_abundance=0.001, rounds=2, correct=True, own_settings=SEEDS)
    return pipeline.haplotypes(sequences_of(reads), p).select("id", "name", "len", "freq")


@query(None, "reads")
def contig_placements(reads):
    """Contigs are the reads, and the reads with their halves in the other order, which have a placement for each half."""
    contigs, truths = turned_contigs(reads)
    return evaluation.placements(contigs, truths, SEEDS, 0.2).select("method", "contig_id", "truth_id", "ord", "start", "end", *ev.COUNTS, F.round("score", 6).alias("score"))


@query(None, "reads")
def assembly_evaluation(reads):
    return evaluation.evaluated(*turned_contigs(reads), SEEDS, 0.2)


@query(
    """, e as (select distinct qn a, tn b from ovl union select distinct tn, qn from ovl),
l as (with recursive r as (
    select a node, least(a, min(b)) root, 0 k from e group by 1
    union all
    select node, min(root) root, k + 1 from (select node, root, k from r union all select e.b, r.root, r.k from r join e on e.a = r.node) where k < 400 group by 1, 3)
  select node, min(root) root from r group by 1)
select node, root from l""",
    "ovl",
    columns=("qn", "tn"),
)
def overlap_components(ovl):
    return graph.components(ovl.select(F.col("qn").alias("a"), F.col("tn").alias("b")))


@query(
    """, e as (select * from ovl where qn <> tn),
s as (select r, min(ord * 2 + side) seen from (select ord, qn r, 0 side from e union all select ord, tn, 1 from e) group by 1)
select ord, qn, tn from (select e.ord, e.qn, e.tn, row_number() over (partition by least(a.seen, b.seen) order by alnlen desc, e.ord) k from e join s a on a.r = e.qn join s b on b.r = e.tn) where k <= 5""",
    "ovl",
)
def overlap_topn_in_turn(ovl):
    return graph.top_n_in_turn(ovl, 5).select("ord", "qn", "tn")


@query(None, "ovl", columns=("qn", "ql", "tn", "tl", "strand", "ord"))
def reads_in_visiting_order(ovl):
    ends = ovl.select("qn", "ql").union(ovl.select("tn", "tl")).distinct().toDF("id", "len")
    return graph.ordered_reads(ends.withColumn("ord", F.substring("id", 2, 20).cast("long")), ovl)


@query(None, "reads")
def genome_identity_by_sketches(reads):
    pairs = mapping.sketched_identity(sequences_of(reads), sequences_of(reads), 1000, k=24, once=True)
    return pairs.where("x < y").select("x", "y", F.round("ani", 6).alias("ani"), "n")


@query(None, "reads")
def genome_identity(reads):
    pairs = mapping.nucleotide_identity(sequences_of(reads), sequences_of(reads), 1000, SEEDS, once=True)
    return pairs.where("x < y").select("x", "y", F.round("ani", 6).alias("ani"), "n")
