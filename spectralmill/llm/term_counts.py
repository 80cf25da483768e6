"""Frequencies of all n-grams of records by suffix sorting.

Every suffix of a record, cut to the greatest length wanted, goes to the partition of its
first term. There the suffixes are sorted in reverse lexicographic order, so all that share
a prefix are neighbours, and one pass with a stack of open prefixes (one for each length)
adds up the counts and the sets of records of every prefix at once.

A first term that heads more than ``PART`` suffixes is routed by its record too, in as many
parts as its exact number of suffixes asks for. The record sets of the parts are disjoint, so
the parts' counts add up exactly, and no task holds more than about ``PART`` suffixes of a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.operators.skew import join_margins

PART = 1 << 20


def suffixes_of(records: DataFrame, record: str, terms: str, length: int) -> DataFrame:
    """(record, suffix, weight): each suffix of each array of terms, cut to ``length`` terms; weight 1.

    Null terms end no suffix and start none: they are taken out beforehand. Records with a
    null or empty array have no suffixes.
    """
    clean = records.select(F.col(record).alias("record"), F.array_compact(F.col(terms)).alias("t")).where(F.size("t") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.slice(F.col("t"), i, F.lit(length)))
    return clean.select("record", F.explode(cut).alias("suffix"), F.lit(1).cast("long").alias("weight"))


class _Stack:
    """Open prefixes by length; what closes is handed to ``out``."""

    def __init__(self, length: int):
        self.open: list[list | None] = [None] * length
        self.out: tuple[list, list, list] = ([], [], [])

    def push(self, level: int, prefix: tuple, count: int, records: np.ndarray) -> None:
        top = self.open[level]
        if top is not None and top[0] == prefix:
            top[1] += count
            top[2].append(records)
            return
        self.close(level)
        self.open[level] = [prefix, count, [records]]

    def close(self, level: int) -> None:
        top, self.open[level] = self.open[level], None
        if top is not None:
            held = len(top[2][0]) if len(top[2]) == 1 else len(np.unique(np.concatenate(top[2])))
            for column, value in zip(self.out, (list(top[0]), top[1], held)):
                column.append(value)

    def taken(self) -> tuple[list, list, list]:
        out, self.out = self.out, ([], [], [])
        return out


def _aggregate(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack(length)
        schema = pa.schema([("ngram", pa.list_(pa.string())), ("count", pa.int64()), ("records", pa.int64())])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            suffix = batch.column("suffix")
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            record = batch.column("record_id").to_numpy(zero_copy_only=False)
            sizes = suffix.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            words = suffix.flatten().dictionary_encode()
            names, code = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
            n = len(sizes)
            fresh = np.zeros(n, bool)  # the prefix of this length differs from the row before
            fresh[0] = True
            parts: list[tuple[list, np.ndarray, np.ndarray]] = []
            for level in range(length):
                has = sizes > level
                term = np.full(n, -1, np.int64)
                term[has] = code[starts[has] + level]
                fresh = fresh.copy()
                fresh[1:] |= term[1:] != term[:-1]
                rows = np.flatnonzero(has)
                if len(rows) == 0:
                    break
                first = np.flatnonzero(fresh[rows])
                run_of = np.cumsum(fresh[rows]) - 1
                counts = np.add.reduceat(weight[rows], first)
                order = np.lexsort((record[rows], run_of))
                pairs_run, pairs_record = run_of[order], record[rows][order]
                keep = np.ones(len(order), bool)
                keep[1:] = (pairs_run[1:] != pairs_run[:-1]) | (pairs_record[1:] != pairs_record[:-1])
                pairs_run, pairs_record = pairs_run[keep], pairs_record[keep]
                held = np.bincount(pairs_run, minlength=len(first))
                at = np.concatenate(([0], np.cumsum(held)))
                grams = lambda k: tuple(names[c] for c in code[starts[rows[first[k]]] : starts[rows[first[k]]] + level + 1])  # noqa: B023, E731
                last = len(first) - 1
                stack.push(level, grams(0), int(counts[0]), pairs_record[at[0] : at[1]])
                if last > 0:  # runs between the first and the last begin and end in this batch
                    stack.close(level)
                    middle = np.arange(1, last)
                    if len(middle):
                        index = (starts[rows[first[middle]]][:, None] + np.arange(level + 1)).ravel()
                        values = words.dictionary.take(pa.array(code[index]))
                        offsets = np.arange(0, len(index) + 1, level + 1, dtype=np.int32)
                        parts.append((pa.ListArray.from_arrays(pa.array(offsets), values), counts[middle], held[middle]))
                    stack.push(level, grams(last), int(counts[last]), pairs_record[at[last] : at[last + 1]])
            for grams_out, counts_out, held_out in parts:
                yield pa.RecordBatch.from_arrays([grams_out.cast(schema.field(0).type), pa.array(counts_out, pa.int64()), pa.array(held_out, pa.int64())], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(stack.taken(), schema)], schema=schema)
        for level in range(length):
            stack.close(level)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(stack.taken(), schema)], schema=schema)

    return run


def ngram_counts(suffixes: DataFrame, length: int = 1, part: int = PART) -> DataFrame:
    """(ngram, count, records) of every n-gram of 1 to ``length`` terms.

    ``suffixes`` has record, suffix (array of at most ``length`` terms, longer ones are cut)
    and weight. count adds up the weights; records is the number of different records
    (compared by a 64-bit hash within one n-gram). Rows with a null record, or a null or
    empty suffix, are left out; null weights count 0. An empty table gives an empty result.
    """
    rows = suffixes.select(
        F.xxhash64(F.col("record")).alias("record_id"),
        F.slice(F.col("suffix"), 1, length).alias("suffix"),
        F.coalesce(F.col("weight").cast("long"), F.lit(0)).alias("weight"),
    ).where(F.col("record").isNotNull() & (F.size("suffix") > 0))
    rows = rows.withColumn("_first", F.col("suffix")[0])
    heads = rows.groupBy("_first").agg(F.count("*").alias("_n")).where(F.col("_n") > part)
    split = join_margins(rows, heads, "_first", "_n", "left")
    split = split.withColumn("_part", F.when(F.col("_n").isNotNull(), F.pmod("record_id", F.ceil(F.col("_n") / part))).otherwise(0))
    routed = split.repartition("_first", "_part").sortWithinPartitions("_part", F.col("suffix").desc())
    partial = routed.select("record_id", "suffix", "weight").mapInArrow(_aggregate(length), "ngram array<string>, count bigint, records bigint")
    return partial.groupBy("ngram").agg(F.sum("count").alias("count"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, records: int, min_records: int = 3, min_count: int = 6, max_share: tuple[int, int] = (6, 10)) -> DataFrame:
    """Adds ``mark``: rare (too few records or too small a count), common (held by more than the share of all records), else useful."""
    rare = (F.col("records") < min_records) | (F.col("count") < min_count)
    common = F.col("records") * max_share[1] > F.lit(max_share[0]) * records
    return counts.withColumn("mark", F.when(rare, "rare").when(common, "common").otherwise("useful"))
