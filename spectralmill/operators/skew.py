"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.scratch import Scratch

HOT_KEYS = 64
SMALL_BYTES = 8 << 20  # margins of at most this estimated size in memory are broadcast whole
INFLATION = 6  # assumed size in memory for each byte of Parquet


def join_margins(rows: DataFrame, margins: DataFrame, key: str, rows_of_key: str, how: str = "inner", hot_keys: int = HOT_KEYS, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Join of ``rows`` with ``margins`` (one row per key, ``rows_of_key`` = its number of rows), inner or left.

    The margins are written once. If they are small they are broadcast. Otherwise keys that
    hold more than 1/``hot_keys`` of all rows, which are fewer than ``hot_keys``, have their
    margins broadcast whatever the size of the data, and all other keys are shuffled. For a
    left join every key of that many rows should have a margin; one that lacks it is left to
    the split of skewed partitions at run time. A null key joins nothing.
    """
    margins = Scratch(rows.sparkSession, "margins").save(margins)
    if int(margins._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * INFLATION <= small_bytes:
        return rows.join(F.broadcast(margins), key, how)
    total = margins.agg(F.sum(rows_of_key)).first()[0] or 0
    marked = F.col(rows_of_key) * hot_keys > total
    hot, cold = margins.where(marked), margins.where(~marked)
    in_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    if how == "inner":
        return in_hot.unionByName(rest.join(cold, key))
    return in_hot.unionByName(rest.where(F.col(key).isNotNull()).join(cold, key, "left")).unionByName(rest.where(F.col(key).isNull()), allowMissingColumns=True)
