"""Column expressions over nucleotide sequences and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Upper-case bases are complemented; other symbols pass through."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def reverse_complement_strict(seq: Column) -> Column:
    """Mixed case; a symbol other than A, C, G, T, N is an error."""
    turned = F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))
    return F.when(seq.isNull() | seq.rlike("^[ACGTNacgtn]*$"), turned).otherwise(F.raise_error(F.lit("a sequence has a symbol that is no base")).cast("string"))


def wrapped(seq: Column, width: int = 60) -> Column:
    """Lines of `width` bases; the last line has no line end."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def fasta_record(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def bases(seq: Column, first: Column, last: Column) -> Column:
    """The 1-based closed range; ends beyond the sequence are clamped."""
    low = F.greatest(first, F.lit(1))
    return F.when(last < low, F.lit("")).otherwise(F.substring(seq, low, last - low + 1))


def has_flag(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def cigar_lengths(cigar: Column) -> Column:
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)(\D)"), F.lit(1)), lambda n: n.cast("int"))


def cigar_letters(cigar: Column) -> Column:
    return F.regexp_extract_all(cigar, F.lit(r"(\d+)(\D)"), F.lit(2))


def left_clip(cigar: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(cigar, r"^(\d+)S", 1), F.lit("")).cast("int"), F.lit(0))


def right_clip(cigar: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(cigar, r"(\d+)S$", 1), F.lit("")).cast("int"), F.lit(0))


def mismatches(a: Column, b: Column) -> Column:
    """(mismatched, unknown) positions of two equally long sequences; N in either is unknown."""
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    unknown = lambda p: (p["a"] == "N") | (p["b"] == "N")
    return F.struct(
        F.size(F.filter(pairs, lambda p: ~unknown(p) & (p["a"] != p["b"]))).alias("mismatched"),
        F.size(F.filter(pairs, unknown)).alias("unknown"),
    )


def abundance(header: Column, prefix: str = "frequency=", suffix: str = "") -> Column:
    """The number in a header's last token, after any run of the prefix's letters."""
    token = F.element_at(F.split(header, r"\s+"), -1)
    letters = "".join(sorted(set(prefix)))
    bare = F.regexp_replace(token, f"^[{letters}]+", "")
    return (F.regexp_replace(bare, f"[{suffix}]+$", "") if suffix else bare).try_cast("double")


def numbered_name(kind: str, place: Column) -> Column:
    """Names by place: r1, contig0, contig_1, strain_1, hap_1, ..."""
    return F.concat(F.lit(kind), place.cast("string"))


def haplotype_name(place: Column, depth: Column, freq: Column) -> Column:
    """hap1 12x freq=0.123: depth without and frequency with three decimals, halves rounded to even."""
    return F.concat(F.lit("hap"), place.cast("string"), F.lit(" "), F.bround(depth, 0).cast("long").cast("string"), F.lit("x freq="), F.bround(freq, 3).cast("decimal(20,3)").cast("string"))


def fixed(x: Column, digits: int) -> Column:
    """A number as text with so many decimals, rounded as printf does: by the double's exact value, exact halves to even.

    The product x * 10^digits is split into the rounded product and its exact error, so that 0.0005 (just above a half) and
    0.0625 (exactly one) both come out right. Nulls stay null; numbers of 2^52 / 10^digits or more, and no numbers, are written as they are.
    """
    x, scale = x.cast("double"), float(10**digits)

    def halves(v: Column) -> tuple[Column, Column]:
        wide = v * 134217729.0  # 2^27 + 1: the upper and lower 26 bits of v
        upper = wide - (wide - v)
        return upper, v - upper

    product = x * scale
    (a, b), (c, d) = halves(x), halves(F.lit(scale))
    error = ((a * c - product) + a * d + b * c) + b * d
    below = F.floor(product)
    beyond = product - below - 0.5
    up = (beyond > 0) | ((beyond == 0) & ((error > 0) | ((error == 0) & (below % 2 != 0))))
    whole = below.cast("long") + up.cast("long")
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    size = F.abs(whole)
    text = F.concat(sign, F.floor(size / int(scale)).cast("string"), *([F.lit("."), F.lpad((size % int(scale)).cast("string"), digits, "0")] if digits else []))
    return F.when(F.abs(x) < 2.0**52 / scale, text).otherwise(x.cast("string"))
