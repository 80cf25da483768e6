"""Valid vectors of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.functions.cleaning import clean_label


def latest_vectors(twisted: DataFrame, dims: int = 32) -> DataFrame:
    """(label, coords): for each label its valid row with the greatest run_no.

    A row is valid if label and coords are not null and coords has exactly ``dims`` finite
    numbers that are not all zero. A null run_no comes before all others; should rows of one
    run differ, the greatest coords stand.
    """
    finite = F.forall("coords", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = (
        twisted.select(clean_label(F.col("label")).alias("label"), F.col("coords").cast("array<double>").alias("coords"), F.col("run_no").cast("int").alias("run_no"))
        .where((F.col("label").isNotNull()) & (F.size("coords") == dims))
        .where(finite & F.exists("coords", lambda x: x != 0))
    )
    return valid.groupBy("label").agg(F.max(F.struct("run_no", "coords")).alias("_best")).select("label", F.col("_best.coords").alias("coords"))
