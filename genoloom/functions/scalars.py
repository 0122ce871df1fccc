"""Column functions over sequence, labels and midpoints."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code: amino acids of the codons in the order of TCAG, first base slowest.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(seq: Column) -> Column:
    """Reverse complement with case kept; other letters than acgt become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^acgtACGT]", "N"), "acgtACGT", "tgcaTGCA"))


def translate_codons(seq: Column) -> Column:
    """Amino acids of the codons from the first base on; * for a stop, X for a codon with another letter than
    acgt; a tail of under three bases is ignored."""
    code = F.create_map(*[F.lit(x) for c, a in zip(product("TCAG", repeat=3), AMINO_ACIDS, strict=True) for x in ("".join(c), a)])
    upper = F.upper(seq)
    codons = F.regexp_extract_all(upper, F.lit("(?s)(...)"), F.lit(1))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def gene_label(chromosome: Column, tag: Column) -> Column:
    """Short label of a gene tag ``N.suffix (...)``: chromosome, number and suffix, dotted."""
    return F.concat_ws(".", chromosome, F.regexp_replace(F.regexp_extract(tag, r"^(\d+\.?[a-z]*\d*)", 1), r"\.$", ""))


def gene_number(tag: Column) -> Column:
    return F.regexp_extract(tag, r"^(\d+)", 1).cast("int")


def block_label(chr1: Column, chr2: Column, number: Column) -> Column:
    """Chromosomes and number, dotted, without leading zeros."""
    bare = lambda c: F.regexp_replace(c.cast("string"), "^0+(?=.)", "")
    return F.concat_ws(".", bare(chr1), bare(chr2), number.cast("string"))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: population correlation, within -1 and 1; 0 for two points or fewer, or without spread."""
    r = F.corr(x.cast("double"), y.cast("double"))
    flat = (F.count(x) <= 2) | (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | r.isNull() | F.isnan(r)
    return F.when(flat, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def same_strand(strand: Column) -> Column:
    return strand.isin("+/+", "-/-")
