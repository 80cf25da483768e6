"""Splits of vectors in two: by gaps along dimensions, or by recursive bipartition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralmill.errors import InsufficientElements, InvalidAcceptanceProbabilityAtZero, InvalidDifferenceMagnificationFactor, InvalidKeepAtMost, UnknownAlgorithm
from spectralmill.operators.order import place_rows
from spectralmill.operators.walks import mixed, walk, walk_together
from spectralmill.scratch import Scratch

ALGORITHMS = ("gaps", "centroids")


def parse_algorithm(name: str) -> str:
    if name not in ALGORITHMS:
        raise UnknownAlgorithm(name)
    return name


def gaps(vectors: DataFrame, keep: int | str = 10_000) -> DataFrame:
    """(split_id, dim, gap, position): the greatest gaps between neighbours along any dimension.

    Ordered by gap downwards, then dimension, then position in the sorted dimension; equal
    coordinates are ordered by label. The split puts the first ``position`` labels of the
    dimension on one side. The sort along a dimension is a range-partitioned global one: a
    position is the row's place in its partition plus the sizes of those before.
    """
    if keep != "all" and (not isinstance(keep, int) or keep < 1):
        raise InvalidKeepAtMost(keep)
    placed = ordered_dimensions(vectors)
    after = placed.select("dim", (F.col("position") - 1).alias("position"), F.col("x").alias("next"))
    found = placed.join(after, ["dim", "position"]).select("dim", (F.col("next") - F.col("x")).alias("gap"), "position")
    if keep == "all":
        ranked = place_rows(found.withColumn("_down", -F.col("gap")), [], ["_down", "dim", "position"], "split_id")
        return ranked.select(F.col("split_id").cast("int").alias("split_id"), "dim", "gap", "position")
    top = found.orderBy(F.desc("gap"), "dim", "position").limit(keep)  # at most ``keep`` rows are numbered by one task
    return top.withColumn("split_id", F.row_number().over(W.orderBy(F.desc("gap"), "dim", "position"))).select(F.col("split_id").cast("int").alias("split_id"), "dim", "gap", "position")


def ordered_dimensions(vectors: DataFrame) -> DataFrame:
    """(dim, position, x, label): every coordinate with its place in its dimension, from 1; dimensions count from 1."""
    long = vectors.where("label is not null and coords is not null").select("label", F.posexplode("coords").alias("dim", "x")).select((F.col("dim") + 1).alias("dim"), "x", "label")
    return place_rows(long, ["dim"], ["x", "label"])


def split_members(vectors: DataFrame, splits: DataFrame) -> DataFrame:
    """(split_id, label): the labels up to each gap."""
    placed = ordered_dimensions(vectors)
    return splits.select("split_id", "dim", F.col("position").alias("_upto")).join(placed, "dim").where("position <= _upto").select("split_id", "label")


def member_ranges(vectors: DataFrame, splits: DataFrame) -> DataFrame:
    """(dim, position, label): the members of all splits at once, each label once for a dimension.

    The members of a split are the labels of its dimension up to its position. Unlike
    ``split_members`` this doesn't repeat a label for every split, so it grows with the vectors only.
    """
    placed = ordered_dimensions(vectors)
    last = splits.groupBy("dim").agg(F.max("position").alias("_last"))  # one row for each dimension
    return placed.join(F.broadcast(last), "dim").where("position <= _last").select("dim", "position", "label")


def _check(at_zero: float, magnification: float) -> None:
    if not 0 < at_zero <= 1:
        raise InvalidAcceptanceProbabilityAtZero(at_zero)
    if magnification <= 0:
        raise InvalidDifferenceMagnificationFactor(magnification)


def bipartition(points: np.ndarray, rng: np.random.Generator, at_zero: float = 0.2, magnification: float = 10.0) -> tuple[np.ndarray, float]:
    """Sides (True, False) of the points and the objective of the best split found by a random walk.

    The objective is the sum over dimensions of the distance between the sides' means, over
    sqrt(1 + difference of sizes). A move of one point is accepted with the logistic
    probability of its gain; the walk ends after max(n, 40) rejections in a row, or after
    ``walks.MOVES`` * n moves, because single moves of a large set gain so little that such a row
    of rejections hardly ever comes. Both sides keep at least one point.
    """
    _check(at_zero, magnification)
    if len(points) < 2:
        raise InsufficientElements(len(points))
    return walk(points, rng, at_zero, magnification)


SMALL = 65_536  # labels of a set that one task splits down to single labels
TOGETHER = 768  # points of a set that is walked together with others
BATCH = 16_384
SPLITS = "split_id string, weight double, members array<string>"
CUT = "label string, coords array<double>, node string, n bigint, side int, weight double"


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[str, pa.Array, np.ndarray]:
    """Node, labels in order and points of a set; the points are there twice for a moment, and only as numbers."""
    nodes, labels, parts = set(), [], []
    for batch in batches:
        nodes.update(batch.column("node")[:1].to_pylist())
        labels.append(batch.column("label"))
        parts.append(batch.column("coords").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
    points = np.concatenate(parts)
    del parts
    names = pa.chunked_array(labels).combine_chunks()
    order = pc.sort_indices(names).to_numpy()
    return nodes.pop(), names.take(pa.array(order)), points.take(order, 0)


def _keys(names: pa.Array, seed: int) -> np.ndarray:
    return mixed(pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) + np.uint64(seed % 2**64))


def _bipartitions(points: np.ndarray, counts: np.ndarray, keys: np.ndarray, at_zero: float, magnification: float) -> tuple[np.ndarray, np.ndarray]:
    """Sides of all points and weights of the sets, whose points follow each other; keys are those of the sets' first labels."""
    sides, weights = np.zeros(len(points), bool), np.zeros(len(counts))
    keys, starts = mixed(keys + counts.astype(np.uint64)), counts.cumsum() - counts
    for i in np.flatnonzero(counts > TOGETHER):
        own = slice(starts[i], starts[i] + counts[i])
        sides[own], weights[i] = bipartition(points[own], np.random.default_rng(int(keys[i])), at_zero, magnification)
    few = (counts > 1) & (counts <= TOGETHER)
    if few.any():
        within = np.repeat(few, counts)
        sides[within], weights[few] = walk_together(points[within], counts[few], keys[few], at_zero, magnification)
    return sides, weights


def centroids(vectors: DataFrame, seed: int = 0, at_zero: float = 0.2, magnification: float = 10.0, depth: int | None = None, small: int = SMALL) -> DataFrame:
    """(split_id, weight, members): recursive bipartition; a set of one label is a split of weight 0.

    Sets of more than ``small`` labels are split level by level, all sets of a level in
    parallel; a smaller set is split down to single labels by one task. The random numbers of
    a set depend on ``seed``, its smallest label and its size only, so both ways agree. A set's
    random walk is in one task, which holds the set's points and labels and nothing else.
    """
    _check(at_zero, magnification)
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids", tidy=True)
    level = scratch.save(vectors.where("label is not null and coords is not null").select("label", F.col("coords").cast("array<double>").alias("coords"), F.lit("0").alias("node")))
    whole = level.count()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, names, points = _read(batches)
        counts = np.array([len(points)])
        side, weight = _bipartitions(points, counts, _keys(names[:1], seed), at_zero, magnification)
        sizes = np.array([(~side).sum(), side.sum()])
        for i in range(0, len(points), BATCH):
            part, there = points[i : i + BATCH], side[i : i + BATCH].astype(np.int32)
            rows = len(part)
            coords = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * points.shape[1]), pa.array(part.ravel()))
            columns = [names[i : i + BATCH], coords, pa.array([node] * rows, pa.string()), pa.array(sizes[there]), pa.array(there), pa.array(np.full(rows, weight[0]))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "coords", "node", "n", "side", "weight"])

    def split_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, names, points = _read(batches)
        keys = _keys(names, seed)
        nodes, at, counts = [node], np.arange(len(points)), np.array([len(points)])
        while len(nodes):
            side, weights = _bipartitions(points[at], counts, keys[at[counts.cumsum() - counts]], at_zero, magnification)
            child = 2 * np.repeat(np.arange(len(counts)), counts) + side
            sizes = np.bincount(child, minlength=2 * len(counts))
            members = pa.ListArray.from_arrays(pa.array(np.append(0, sizes[::2].cumsum()).astype(np.int32)), names.take(pa.array(at[~side])))
            found = pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(weights), members], ["split_id", "weight", "members"])
            yield from (found[i : i + BATCH] for i in range(0, len(nodes), BATCH))
            inner = counts > 1 if depth is None or len(nodes[0]) < depth else np.zeros(len(counts), bool)
            at = at[child.argsort(kind="stable")][np.repeat(inner, counts)]
            counts = sizes.reshape(-1, 2)[inner].ravel()
            nodes = [nodes[i] + side for i in np.flatnonzero(inner) for side in "01"]

    found, done = spark.createDataFrame([], SPLITS), 0
    many, few = (level, None) if whole > small else (None, level)
    while (many is not None or few is not None) and (depth is None or done < depth):
        if few is not None:
            found = found.unionByName(scratch.save(few.groupBy("node").applyInArrow(split_all, SPLITS)))
        if many is None:
            break
        cut = scratch.save(many.groupBy("node").applyInArrow(split, CUT))
        scratch.drop(level)
        members = F.array_sort(F.collect_list(F.when(F.col("side") == F.lit(0), F.col("label")))).alias("members")
        found = found.unionByName(scratch.save(cut.groupBy(F.col("node").alias("split_id")).agg(F.max("weight").alias("weight"), members)))
        level, done = cut, done + 1
        sets = cut.select("label", "coords", F.concat("node", F.col("side").cast("string")).alias("node"), "n")
        most, least = cut.agg(F.max("n"), F.min("n")).first()
        many = sets.where(F.col("n") > small).drop("n") if most > small else None
        few = sets.where(F.col("n") <= small).drop("n") if least <= small else None
    scratch.drop(level)
    return found
