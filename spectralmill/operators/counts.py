"""Accumulated counts from raw spectrum rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.functions.cleaning import clean_kmer, clean_label


def accumulate_spectra(spectra: DataFrame) -> DataFrame:
    """(label, kmer, count) from rows with label, kmer, count and batch.

    Rows with a null label, k-mer or count, or a count below 1, are not valid and are left
    out. Valid rows equal in all four columns after cleaning are one delivery and count once;
    all others of a label and k-mer add up. An empty table gives an empty one.
    """
    rows = spectra.select(
        clean_label(F.col("label")).alias("label"),
        clean_kmer(F.col("kmer")).alias("kmer"),
        F.col("count").cast("long").alias("count"),
        F.col("batch").cast("int").alias("batch"),
    ).where("label is not null and kmer is not null and count > 0")
    return rows.distinct().groupBy("label", "kmer").agg(F.sum("count").alias("count"))
