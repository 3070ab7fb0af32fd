"""Operators over alignment records: qname, flag, rname, pos (1-based), cigar, seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import has_flag, left_clip, right_clip

DUPLICATE, SUPPLEMENTARY, FAILED, SECONDARY, UNMAPPED = 1024, 2048, 512, 256, 4


def without(alignments: DataFrame, bits: int = SUPPLEMENTARY + DUPLICATE + FAILED) -> DataFrame:
    return alignments.where(~has_flag(F.col("flag"), bits))


def clipped_off(alignments: DataFrame, min_len: int = 100) -> DataFrame:
    """(qname, seq): mapped reads without their soft-clipped ends, of min_len bases or more."""
    lc, rc = left_clip(F.col("cigar")), right_clip(F.col("cigar"))
    cut = F.substring("seq", lc + 1, F.length("seq") - lc - rc)
    return alignments.where(~has_flag(F.col("flag"), UNMAPPED)).select("qname", cut.alias("seq")).where(F.length("seq") >= min_len)


def clip_points(alignments: DataFrame, min_clip: int = 5) -> DataFrame:
    """(rname, bp): where a read's clip of min_clip bases or more begins; the left one goes first."""
    clips = alignments.where("cigar <> '*'").where(~has_flag(F.col("flag"), UNMAPPED)).select("rname", "pos", F.length("seq").alias("len"), left_clip(F.col("cigar")).alias("lc"), right_clip(F.col("cigar")).alias("rc"))
    bp = F.when(F.col("lc") >= min_clip, F.col("pos")).when(F.col("rc") >= min_clip, F.col("pos") + F.col("len") - F.col("rc"))
    return clips.where((F.col("lc") >= min_clip) | (F.col("rc") >= min_clip)).select("rname", bp.alias("bp"))


def breakpoints(alignments: DataFrame, min_clip: int = 5, min_count: int = 10) -> DataFrame:
    return clip_points(alignments, min_clip).groupBy("rname", "bp").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def clip_split(lengths: DataFrame, points: DataFrame, min_len: int = 500) -> DataFrame:
    """(rname, first, last): contigs cut before each breakpoint; cut pieces under min_len go.

    lengths: rname, len. points: rname, bp. Uncut contigs stay whatever their length.
    """
    inner = points.join(lengths, "rname").where("bp > 1 and bp <= len").select("rname", F.col("bp").alias("first"))
    starts = lengths.select("rname", F.lit(1).alias("first")).unionByName(inner).distinct().join(lengths, "rname")
    w = Window.partitionBy("rname").orderBy("first")
    pieces = starts.select("rname", "first", (F.coalesce(F.lead("first").over(w) - 1, F.col("len"))).alias("last"), F.count("*").over(Window.partitionBy("rname")).alias("n"))
    return pieces.where((F.col("n") == 1) | (F.col("last") - F.col("first") + 1 >= min_len)).select("rname", "first", "last")
