"""Spectra from sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.functions.kmers import canonical, kmers


def count_kmers(sequences: DataFrame, k: int = 12, content: str = "DNA-ds", label: str | None = None) -> DataFrame:
    """(label, kmer, count) from sequences(tag, seq): one spectrum for each tag, or one named ``label`` for all.

    Segments with one tag add up. Null and short sequences, and windows with letters outside
    the alphabet, give no k-mers; a null tag is a spectrum of label null, which other
    operators leave out. Counting is partial in each task before the shuffle.
    """
    name = F.lit(label) if label is not None else F.col("tag")
    each = sequences.select(name.alias("label"), F.explode(kmers(F.col("seq"), k, content)).alias("kmer"))
    if content == "DNA-ds":
        each = each.withColumn("kmer", canonical(F.col("kmer")))
    return each.groupBy("label", "kmer").agg(F.count("*").alias("count"))
