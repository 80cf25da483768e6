"""K-mer extraction from sequences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectralmill.errors import InvalidContent
from spectralmill.functions.cleaning import reverse_complement

PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
LIMITS = {"DNA-ss": 30, "DNA-ds": 30, "protein": 12}


def lint_dna(sequence: Column) -> Column:
    """Upper case; every other letter or sign becomes N, so no k-mer reaches across it."""
    return F.regexp_replace(F.translate(sequence, "acgt", "ACGT"), "[^ACGT]", "N")


def lint_protein(sequence: Column) -> Column:
    return F.regexp_replace(F.translate(sequence, PROTEIN.lower(), PROTEIN), f"[^{PROTEIN}]", "X")


def kmers(sequence: Column, k: int, content: str = "DNA-ds") -> Column:
    """Array of the k-mers of a sequence as read, in order; empty if it has none, null if it is null.

    content is DNA-ss, DNA-ds or protein. One pass of a pattern finds all windows, however long
    the sequence is; windows with other letters are none. For DNA-ds, name each by its
    smaller strand afterwards, see ``canonical``.
    """
    if content not in LIMITS:
        raise InvalidContent(content)
    if not 1 <= k <= LIMITS[content]:
        raise InvalidContent(f"{content} needs k from 1 to {LIMITS[content]}")
    letters = PROTEIN if content == "protein" else "ACGT"
    upper = F.translate(sequence, letters.lower(), letters)
    return F.regexp_extract_all(upper, F.lit(f"(?=([{letters}]{{{k}}}))"), 1)


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def hash_hex(kmer: Column) -> Column:
    """DNA k-mer as the hexadecimal number of its base-4 digits A, C, G, T."""
    return F.lower(F.conv(F.translate(kmer, "ACGT", "0123"), 4, 16))
