"""Statistics of spectra (columns) and k-mers (rows) of a sparse count table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralmill.operators.skew import join_margins


def _power(value: Column, power: float) -> Column:
    return value.cast("double") if power == 1.0 else F.pow(value, F.lit(float(power)))


def count_statistics(cells: DataFrame, by: str, threshold: float = 1.0, power: float = 1.0) -> DataFrame:
    """(by, non_zero, min, max, sum, sum_log) of each label or k-mer.

    ``cells`` has label, kmer and a positive count. Counts below the threshold don't count; a
    threshold below 1 is that fraction of the sum of the powered counts of the label or
    k-mer. sum adds up count ^ power, sum_log power * ln(count). min is always 0, because
    the running minimum starts there. A threshold of 0 would let zeros of the dense table
    pass; they add nothing to sum and max and are left out of non_zero and sum_log here.
    """
    count = F.col("count")
    if threshold < 1:
        totals = cells.groupBy(by).agg(F.sum(_power(count, power)).alias("_total"), F.count("*").alias("_rows"))
        cells = join_margins(cells, totals, by, "_rows")
        passes = count >= F.lit(float(threshold)) * F.col("_total")
    else:
        passes = count >= F.lit(float(threshold))
    kept = lambda x: F.sum(F.when(passes, x).otherwise(0.0))
    return cells.groupBy(by).agg(
        F.count_if(passes).alias("non_zero"),
        F.lit(0).cast("long").alias("min"),
        F.coalesce(F.max(F.when(passes, count)), F.lit(0)).cast("long").alias("max"),
        kept(_power(count, power)).alias("sum"),
        kept(F.ln(count) * power).alias("sum_log"),
    )
