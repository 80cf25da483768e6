"""Cleaning of labels, k-mers and category names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def clean_label(label: Column) -> Column:
    """Label without outer blanks and without one pair of outer double quotes; null stays null."""
    bare = F.btrim(label, F.lit(BLANKS))
    quoted = (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    return F.when(quoted, bare.substr(F.lit(2), F.length(bare) - 2)).otherwise(bare)


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def clean_kmer(kmer: Column) -> Column:
    """K-mer without outer blanks, in upper case, named by the smaller of its two strands."""
    upper = F.upper(F.btrim(kmer, F.lit(BLANKS)))
    return F.least(upper, reverse_complement(upper))


def clean_source(source: Column) -> Column:
    """Source name without outer blanks, in lower case; null stays null."""
    return F.lower(F.btrim(source, F.lit(BLANKS)))
