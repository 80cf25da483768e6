"""Cleaned metadata and vectors of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.functions.cleaning import clean_label


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """(label, class_name, host, site): one row for each label, the one received last.

    Fields are compared without outer blanks and in lower case; empty fields and "na" are
    null. Dates are read with dashes or slashes. Of rows received on one day the greatest
    values stand; a null date comes before all others.
    """
    tidy = lambda c: F.nullif(F.nullif(F.lower(F.btrim(F.col(c))), F.lit("")), F.lit("na")).alias(c)
    rows = metadata.select(clean_label(F.col("label")).alias("label"), tidy("class_name"), tidy("host"), tidy("site"), F.replace("received", F.lit("/"), F.lit("-")).alias("received")).where("label is not null")
    best = rows.groupBy("label").agg(F.max(F.struct("received", "class_name", "host", "site")).alias("_b"))
    return best.select("label", "_b.class_name", "_b.host", "_b.site")


def class_means(vectors: DataFrame, classes: DataFrame, dims: int) -> DataFrame:
    """(label, coords): the mean vector of each class; classes has label and class_name."""
    joined = vectors.join(classes.where("class_name is not null").select("label", "class_name"), "label")
    means = joined.groupBy("class_name").agg(*(F.avg(F.col("coords")[d].cast("double")).alias(f"_m{d}") for d in range(dims)))
    return means.select(F.col("class_name").alias("label"), F.array(*(f"_m{d}" for d in range(dims))).alias("coords"))
