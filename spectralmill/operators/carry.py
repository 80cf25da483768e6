"""Last value carried forward along an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 65_536


def carry_forward(rows: DataFrame, group: str, order: str, value: Column, into: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``into``: the last non-null ``value`` of the group at or before the row's ``order`` (whole numbers).

    Each group is cut into chunks of ``chunk`` consecutive orders; only one row for each chunk
    is carried from chunk to chunk, so a group of any size is spread over many tasks. Rows
    with a null group are a group of their own.
    """
    rows = rows.withColumns({"_value": value, "_chunk": F.floor(F.col(order) / chunk)})
    within = F.last("_value", ignorenulls=True).over(W.partitionBy(group, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    ends = rows.where(F.col("_value").isNotNull()).groupBy(F.col(group).alias("_g"), F.col("_chunk").alias("_from")).agg(F.max_by("_value", order).alias("_end"))
    chunks = rows.groupBy(F.col(group).alias("_g"), F.col("_chunk").alias("_c")).agg(F.lit(1).alias("_one"))
    joined = chunks.join(ends, chunks["_g"].eqNullSafe(ends["_g"]) & (chunks["_c"] == ends["_from"]), "left").select(chunks["_g"], "_c", "_end")
    before = joined.withColumn("_before", F.last("_end", ignorenulls=True).over(W.partitionBy("_g").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    filled = rows.withColumn("_within", within).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_chunk") == F.col("_c")), "left")
    return filled.withColumn(into, F.coalesce("_within", "_before")).drop("_value", "_chunk", "_within", "_before", "_g", "_c")
