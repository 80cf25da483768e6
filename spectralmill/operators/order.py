"""Places of rows in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralmill.scratch import Scratch


def place_rows(rows: DataFrame, group: list[str], order: list[str], into: str = "position") -> DataFrame:
    """Adds ``into``: the row's place, from 1, in the order of ``order`` within its group.

    Rows are range-partitioned; a place is that within the partition plus the sizes of the
    group's parts in the partitions before. The partitioned rows are written once, because
    the sampling behind the ranges may differ from run to run.
    """
    spread = Scratch(rows.sparkSession, "order").save(rows.repartitionByRange(*group, *order).select("*", F.spark_partition_id().alias("_p")))
    sizes = spread.groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    earlier = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row for each part
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = spread.withColumn("_at", F.row_number().over(W.partitionBy(*group, "_p").orderBy(*order)))
    same = [placed[g].eqNullSafe(before[g]) for g in group] + [placed["_p"] == before["_p"]]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return placed.join(before, condition).select(*(placed[c] for c in rows.columns), (F.col("_at") + F.col("_before")).alias(into))
