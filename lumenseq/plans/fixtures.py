"""Record tables (reads, overlaps, alignments, ...) derived from the given tables.

Each is one SQL text that Spark and other SQL engines read alike, so that a query and its oracle
see the same rows. `{table}` stands for an input table, `{g}` for what makes another engine replace all matches, `{wide}` for Spark's cast to long
where a product of two ints would pass their range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import materialized

READS = """select 'd' || cast(doc_id as varchar(20)) id, doc_id ord, translate(regexp_replace(lower(text), '[^a-z]', ''{g}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') seq from {documents}"""

OVERLAPS = """select qn, ql, qs, qs + alnlen qe, strand, tn, tl, ts, ts + alnlen te, alnlen - cast(floor(alnlen * dp / 1e2) as int) nmatch, alnlen, 60 mapq,
  (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey ord
from (select *, case when l_suppkey % 2 = 0 then least(cast(l_suppkey % 25 as int), ql - alnlen) else ql - alnlen end qs,
        case when l_suppkey % 3 = 0 then tl - alnlen else least(l_linenumber * 3, tl - alnlen) end ts
  from (select *, least(400 + 50 * cast(l_quantity as int), ql, tl) alnlen, cast(round(l_discount * 100) as int) dp
    from (select *, cast(1000 + (a * 37) % 3000 as int) ql, cast(1000 + (b * 37) % 3000 as int) tl, 'r' || cast(a as varchar(9)) qn, 'r' || cast(b as varchar(9)) tn,
            case when l_returnflag = 'R' then '-' else '+' end strand
      from (select *, l_partkey + (l_orderkey * 7 + l_linenumber) % 61 a, l_partkey b from {lineitem}) x0) x1) x2) x3"""

INTERVALS = """select 'c' || cast(cast(floor(l_partkey / 1e2) as int) as varchar(9)) contig, cast(1 + 1700 * (cast(floor(x / 1450e0) as int) % 4) + x % 1450 as int) s, 20 + 4 * cast(l_quantity as int) n,
  (100 - cast(round(l_discount * 100) as int)) / 1e2 identity
from (select *, l_orderkey * 13 + l_linenumber * 101 x from {lineitem}) i0"""

ALIGNMENTS = """select 'q' || cast(l_orderkey as varchar(12)) || '_' || cast(l_linenumber as varchar(3)) qname,
  case l_linenumber % 7 when 0 then 16 when 1 then 0 when 2 then 0 when 3 then 2048 when 4 then 256 when 5 then 4 else 1024 end flag,
  'h' || cast(l_suppkey % 10 as varchar(3)) rname, cast(1 + (l_partkey % 40) * 50 as int) pos,
  case when lc > 0 then cast(lc as varchar(9)) || 'S' else '' end || cast(m as varchar(9)) || 'M' || case when rc > 0 then cast(rc as varchar(9)) || 'S' else '' end cigar,
  substring(repeat('ACGTTGCA', 60), 1, cast(lc + m + rc as int)) seq
from (select *, l_suppkey % 12 lc, l_partkey % 9 rc, 100 + 5 * cast(l_quantity as int) m from {lineitem}) z"""

ASSIGNMENTS = """select event_type method, 'k' || cast(user_id as varchar(9)) contig_id, 't' || cast(user_id % 12 as varchar(9)) truth_id,
  1000 + event_id % 500 aln_len, mm + event_id % 7 + event_id % 5 edit_dist, mm mismatches, event_id % 7 ins_len, event_id % 5 del_len,
  event_id ord, event_id % 300 start, event_id % 300 + 1000 + event_id % 500 stop, least(1, event_id % 7) ins_count, least(1, event_id % 5) del_count, event_id % 3 unknown, user_id % 10 sample
from (select *, cast(floor(value / 5) as int) mm from {events}) e0"""

CONTIGS = """select distinct event_type method, 'k' || cast(user_id as varchar(9)) contig_id, cast(500 + (user_id * 13) % 1100 as int) len, 1e0 + user_id % 9 ab from {events}"""

TRUTH = """select distinct user_id % 12 ord, 't' || cast(user_id % 12 as varchar(9)) truth_id, (user_id % 12 + 1) / 78e0 freq, cast(1000 + 100 * (user_id % 12) as int) len from {events}"""

PAIR_ALIGNMENTS = """select case when x0 < y0 then x0 else y0 end x, case when x0 < y0 then y0 else x0 end y, alnlen - cast(floor(alnlen * dp / 1e2) as int) nmatch, alnlen,
  cast(1 + (l_orderkey * 13) % 3000 as int) xs, alnlen xn, cast(1 + (l_partkey * 17 + l_linenumber * 401) % 3000 as int) ys, alnlen yn
from (select *, cast(floor((l_partkey + (l_orderkey * 7 + l_linenumber) % 61) / 5e0) as int) x0, cast(floor(l_partkey / 5e0) as int) y0, 400 + 50 * cast(l_quantity as int) alnlen, cast(round(l_discount * 100) as int) dp from {lineitem}) w
where x0 <> y0"""

CONTIG_LENGTHS = """select distinct cast(floor(l_partkey / 5e0) as int) + k id, cast(6000 + ((cast(floor(l_partkey / 5e0) as int) + k) * 41) % 700 * 10 as bigint) len
from {lineitem}, (select 0 k union all select 13) k0"""

PAIRS = f"""select x, y, m, l, cast(6000 + (x * 41) % 700 * 10 as bigint) l1, cast(6000 + (y * 41) % 700 * 10 as bigint) l2,
  case when (x + y) % 53 = 0 and (x{{wide}} * y) % 3 = 0 then 1 when (x + 2 * y) % 59 = 0 then 2 else 0 end contained, (1 - m * 1e0 / l) * (1 + (x{{wide}} * y) % 37) gdiv
from (select x, y, sum(nmatch) m, sum(alnlen) l from ({PAIR_ALIGNMENTS}) p0 group by 1, 2) q"""

ALL = {"reads": READS, "ovl": OVERLAPS, "intervals": INTERVALS, "alignments": ALIGNMENTS, "assignments": ASSIGNMENTS, "contigs": CONTIGS, "truth": TRUTH, "pair_alignments": PAIR_ALIGNMENTS, "contig_lengths": CONTIG_LENGTHS, "pairs": PAIRS}
TABLES = ("documents", "lineitem", "events")


def fixture(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The table, or some of its columns, which are not written then."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in ALL[name]}
    made = spark.sql(ALL[name].replace("{g}", "").replace("{wide}", "::bigint"), **used)
    # a filter over these would be pushed through four levels of expressions, each repeated wherever it is used
    return made.select(*columns) if columns else materialized(made) if name == "ovl" else made


def with_clauses(*names: str) -> str:
    """The fixtures as common table expressions for an oracle."""
    plain = lambda sql: sql.replace("{g}", ", 'g'").replace("{wide}", "").format(**{t: t for t in TABLES})
    return "with " + ", ".join(f"{n} as ({plain(ALL[n])})" for n in names)
