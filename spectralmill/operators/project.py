"""Projection of spectra with a twister."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.errors import DuplicateLabel, IncompatibleTwisterAndTwisted
from spectralmill.operators.skew import join_margins


def clean_twister(twister: DataFrame, kmer=None) -> DataFrame:
    """One row for each k-mer; rows with null weights are left out, of repeated k-mers the greatest weights stand."""
    rows = twister.select((F.col("kmer") if kmer is None else kmer).alias("kmer"), "weights").where("kmer is not null and weights is not null")
    return rows.groupBy("kmer").agg(F.max("weights").alias("weights"))


def project_long(cells: DataFrame, twister: DataFrame, normalise: bool = True) -> DataFrame:
    """(label, dim, value): weighted sums over the k-mers that the twister knows, divided by the label's count of known k-mers.

    ``cells`` may hold decimals and repeats, which add up. A label without known k-mers is
    left out; a total of 0 divides nothing. Dimensions count from 1.
    """
    count = "count" if "count" in cells.columns else "value"
    held = cells.groupBy("kmer").agg(F.count("*").alias("_held"))
    known = join_margins(cells.select("label", "kmer", F.col(count).cast("double").alias("v")), twister.join(held, "kmer"), "kmer", "_held")
    each = known.select("label", "v", F.posexplode("weights").alias("dim", "w"))
    total = F.when((F.sum("v") == 0) | F.lit(not normalise), 1.0).otherwise(F.sum("v"))
    return each.groupBy("label", "dim").agg((F.sum(F.col("v") * F.col("w")) / total).alias("value")).select("label", (F.col("dim") + 1).alias("dim"), "value")


def project(cells: DataFrame, twister: DataFrame, dims: int, normalise: bool = True, into: DataFrame | None = None) -> DataFrame:
    """(label, coords): projected spectra, added to ``into`` if given; raises if a label is there already."""
    held = cells.groupBy("kmer").agg(F.count("*").alias("_held"))
    count = "count" if "count" in cells.columns else "value"
    known = join_margins(cells.select("label", "kmer", F.col(count).cast("double").alias("v")), twister.join(held, "kmer"), "kmer", "_held")
    sums = known.groupBy("label").agg(F.sum("v").alias("_total"), *(F.sum(F.col("v") * F.col("weights")[d]).alias(f"_d{d}") for d in range(dims)))
    total = F.when((F.col("_total") == 0) | F.lit(not normalise), 1.0).otherwise(F.col("_total"))
    out = sums.select("label", F.array(*(F.col(f"_d{d}") / total for d in range(dims))).alias("coords"))
    if into is None:
        return out
    other = into.select(F.size("coords")).first()
    if other is not None and other[0] != dims:
        raise IncompatibleTwisterAndTwisted(f"{dims} and {other[0]} dimensions")
    twice = out.join(into.select("label"), "label", "left_semi").first()
    if twice is not None:
        raise DuplicateLabel(twice["label"])
    return into.select("label", "coords").unionByName(out)
