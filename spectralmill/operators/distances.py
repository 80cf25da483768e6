"""Distances between sets of vectors, their summaries, and spectral distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralmill.errors import IncompatibleGeometries, InvalidKeepAtMost, UnknownDistance
from spectralmill.functions.space import Distance
from spectralmill.operators.blocks import number_rows, pair_sums, power_of_gap, product
from spectralmill.operators.order import place_rows
from spectralmill.operators.skew import join_margins
from spectralmill.scratch import Scratch

BLOCK_BYTES = 32 << 20  # of a block of column vectors that goes to the executors
FUSED_BYTES = 256 << 20  # of all column vectors together, for a summary in one pass


def _norms(x: np.ndarray, distance: Distance, metric: np.ndarray) -> np.ndarray:
    """Norms of rows under the metric; 0 is replaced by 1."""
    total = (np.abs(x) ** distance.exponent * metric).sum(1)
    scaled = total / 2 if distance.kind == "cosine" else total ** (1 / distance.exponent)
    return np.where(scaled == 0, 1.0, scaled)


def distance_block(a: np.ndarray, b: np.ndarray, distance: Distance, metric: np.ndarray, normalise: bool) -> np.ndarray:
    """All distances of the rows of ``a`` from those of ``b``."""
    if normalise:
        a, b = a / _norms(a, distance, metric)[:, None], b / _norms(b, distance, metric)[:, None]
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for begin in range(0, len(a), step):
        gap = np.abs(a[begin : begin + step, None] - b[None])
        total = ((gap * gap if distance.exponent == 2.0 else gap**distance.exponent) * metric).sum(2)
        out[begin : begin + step] = total / 2 if distance.kind == "cosine" else np.sqrt(total) if distance.exponent == 2.0 else total ** (1 / distance.exponent)
    return out


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) != len(column) * dims:
        raise IncompatibleGeometries(f"expected vectors of {dims} dimensions")
    return values.reshape(len(column), dims).astype(np.float64)


def _column_blocks(columns: DataFrame, dims: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Column vectors in label order, in blocks of at most ``BLOCK_BYTES``, each fetched as Arrow data when it is its turn."""
    most = max(1, BLOCK_BYTES // (8 * dims))
    placed = place_rows(columns.select("label", F.col("coords").cast("array<double>").alias("coords")), [], ["label"], "_at")
    held = Scratch(columns.sparkSession, "columns").save(placed.withColumn("_block", F.floor((F.col("_at") - 1) / most)))
    for block in range(int((held.agg(F.max("_block")).first()[0] if not held.isEmpty() else -1)) + 1):
        table = held.where(F.col("_block") == block).orderBy("_at").select("label", "coords").toArrow()
        yield table.column("label").to_pylist(), vectors_of(table.column("coords").combine_chunks(), dims)


def cross_distances(rows: DataFrame, columns: DataFrame, metric: list[float], distance: Distance = Distance(), normalise: bool = True, mismatch: str = "fail") -> DataFrame:
    """(row_label, col_label, distance) of every row vector and every column vector.

    Both have label and coords with as many dimensions as the metric. With ``normalise``
    vectors are divided by their norm under the metric, a norm of 0 counting as 1. The
    column vectors go to the executors in blocks of at most ``BLOCK_BYTES``, one pass over
    the rows for each; the rows are never shuffled. Rows with null label or coords are left out.
    Vectors of another number of dimensions fail, or with ``mismatch`` "infinity" are
    infinitely far from all others.
    """
    if mismatch not in ("fail", "infinity"):
        raise UnknownDistance(f"mismatch {mismatch}")
    if mismatch == "infinity":
        fits = F.size("coords") == len(metric)
        good = cross_distances(rows.where(fits), columns.where(fits), metric, distance, normalise)
        named = lambda frame, name: frame.where("label is not null and coords is not null").select(F.col("label").alias(name), fits.alias(f"_{name}"))
        pairs = named(rows, "row_label").join(named(columns, "col_label"), ~F.col("_row_label") | ~F.col("_col_label"))  # the pairs that were asked for
        return good.unionByName(pairs.select("row_label", "col_label", F.lit(float("inf")).alias("distance")))
    dims, weights = len(metric), np.asarray(metric, float)
    sc = rows.sparkSession.sparkContext
    source = rows.where("label is not null and coords is not null").select("label", F.col("coords").cast("array<double>").alias("coords"))
    result = None
    for labels, block in _column_blocks(columns.where("label is not null and coords is not null"), dims):
        shared = sc.broadcast((pa.array(labels, pa.string()), block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, b = shared.value
            for batch in batches:
                a, own = vectors_of(batch.column("coords"), dims), batch.column("label")
                step = max(1, (1 << 20) // len(b))
                for begin in range(0, len(a), step):
                    d = distance_block(a[begin : begin + step], b, distance, weights, normalise)
                    row, col = np.divmod(np.arange(d.size), len(b))
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(row + begin)), names.take(pa.array(col)), pa.array(d.ravel())], names=["row_label", "col_label", "distance"])

        part = source.mapInArrow(run, "row_label string, col_label string, distance double")
        result = part if result is None else result.unionByName(part)
    return result if result is not None else rows.sparkSession.createDataFrame([], "row_label string, col_label string, distance double")


def triangular_distances(vectors: DataFrame, metric: list[float], distance: Distance = Distance(), normalise: bool = True) -> DataFrame:
    """Distances of all pairs with row_label <= col_label, the diagonal included."""
    return cross_distances(vectors, vectors, metric, distance, normalise).where("row_label <= col_label")


def symmetric(triangular: DataFrame) -> DataFrame:
    mirrored = triangular.where("row_label <> col_label").select(F.col("col_label").alias("row_label"), F.col("row_label").alias("col_label"), "distance")
    return triangular.unionByName(mirrored)


SUMMARY = "label string, mean double, stddev double, median double, mad double, neighbours array<struct<rank:int,label:string,distance:double,z:double>>"


def _keep(keep: int | str) -> int:
    if keep == "all":
        return 1 << 30
    if not isinstance(keep, int) or keep < 1:
        raise InvalidKeepAtMost(keep)
    return keep


def summarise_distances(distances: DataFrame, keep: int | str = 2) -> DataFrame:
    """Summary of a distance table: for each row its mean, sample standard deviation, upper median, upper MAD and nearest columns.

    Of the nearest ``keep`` columns all ties of the last are reported too, ordered by
    distance and label; z is (distance - mean) / stddev, null where the deviation is 0. A
    single column has deviation 0.
    """
    keep = _keep(keep)
    by_row = W.partitionBy("row_label")
    moments = distances.groupBy("row_label").agg(F.avg("distance").alias("mean"), F.coalesce(F.stddev_samp("distance"), F.lit(0.0)).alias("stddev"), F.count("*").alias("n"))
    place = F.floor(F.col("n") / 2) + 1
    placed = distances.join(moments, "row_label").withColumn("_at", F.row_number().over(by_row.orderBy("distance", "col_label")))
    median = placed.where(F.col("_at") == place).select("row_label", F.col("distance").alias("median"))
    off = placed.select("row_label", "distance", "n").join(median, "row_label").withColumn("_off", F.abs(F.col("distance") - F.col("median")))
    mad = off.withColumn("_at", F.row_number().over(by_row.orderBy("_off"))).where(F.col("_at") == place).select("row_label", F.col("_off").alias("mad"))
    near = distances.withColumn("_rank", F.rank().over(by_row.orderBy("distance"))).where(F.col("_rank") <= keep)
    near = near.join(moments.select("row_label", "mean", "stddev"), "row_label").withColumn("z", F.try_divide(F.col("distance") - F.col("mean"), F.col("stddev")))
    near = near.groupBy("row_label").agg(F.array_sort(F.collect_list(F.struct("distance", F.col("col_label").alias("label"), "z"))).alias("_n"))
    entries = F.transform("_n", lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["label"].alias("label"), x["distance"].alias("distance"), x["z"].alias("z")))
    joined = moments.join(median, "row_label").join(mad, "row_label").join(near, "row_label")
    return joined.select(F.col("row_label").alias("label"), "mean", "stddev", "median", "mad", entries.alias("neighbours"))


def _summaries(names: list[str], b: np.ndarray, dims: int, distance: Distance, weights: np.ndarray, normalise: bool, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(b)
        for batch in batches:
            a, own = vectors_of(batch.column("coords"), dims), batch.column("label")
            for begin in range(0, len(a), 1024):
                d = distance_block(a[begin : begin + 1024], b, distance, weights, normalise)
                mean = d.mean(1)
                deviation = d.std(1, ddof=1) if n > 1 else np.zeros(len(d))
                ordered = np.sort(d, 1)
                median = ordered[:, n // 2]
                mad = np.sort(np.abs(d - median[:, None]), 1)[:, n // 2]
                within = d <= ordered[:, min(keep, n) - 1][:, None]
                near = []
                for r in range(len(d)):
                    held = np.flatnonzero(within[r])
                    held = held[np.argsort(d[r, held], kind="stable")]  # names are sorted
                    near.append([{"rank": i + 1, "label": names[c], "distance": float(d[r, c]), "z": float((d[r, c] - mean[r]) / deviation[r]) if deviation[r] else None} for i, c in enumerate(held)])
                kind = pa.list_(pa.struct([("rank", pa.int32()), ("label", pa.string()), ("distance", pa.float64()), ("z", pa.float64())]))
                yield pa.RecordBatch.from_arrays([own.slice(begin, len(d)), *(pa.array(x) for x in (mean, deviation, median, mad)), pa.array(near, kind)], names=["label", "mean", "stddev", "median", "mad", "neighbours"])

    return run


def summarise_rowwise(rows: DataFrame, columns: DataFrame, metric: list[float], distance: Distance = Distance(), normalise: bool = True, keep: int | str = 2) -> DataFrame:
    """Summary of the distances of every row vector from all column vectors; see ``summarise_distances``.

    While all column vectors together have at most ``FUSED_BYTES``, each row is summarised
    where it lies and no distance is ever stored; otherwise the distances are made in blocks
    and summarised by sorting.
    """
    limit, dims = _keep(keep), len(metric)
    wanted = columns.where("label is not null and coords is not null")
    if wanted.count() * dims * 8 > FUSED_BYTES:
        return summarise_distances(cross_distances(rows, columns, metric, distance, normalise), keep)
    blocks = list(_column_blocks(wanted, dims))
    if not blocks:
        return rows.sparkSession.createDataFrame([], SUMMARY)
    names, b = [n for labels, _ in blocks for n in labels], np.concatenate([x for _, x in blocks])
    source = rows.where("label is not null and coords is not null").select("label", F.col("coords").cast("array<double>").alias("coords"))
    shared = rows.sparkSession.sparkContext.broadcast((names, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = shared.value
        return _summaries(held, block, dims, distance, np.asarray(metric, float), normalise, limit)(batches)

    return source.mapInArrow(run, SUMMARY)


def spectral_distances(cells: DataFrame, first: DataFrame, second: DataFrame, distance: Distance = Distance(), normalise: bool = True) -> DataFrame:
    """(row_label, col_label, distance) of spectra: rows are the second selection, columns the first.

    Counts are divided by their spectrum's sum and, with ``normalise``, by the spectrum's norm
    after that. Pairs of spectra are summed by dense blocks (see ``blocks``): products for
    exponent 2, since |a - b|^2 = |a|^2 + |b|^2 - 2ab, and powers of differences otherwise.
    Selected labels without counts are left out.
    """
    p = distance.exponent
    scratch = Scratch(cells.sparkSession, "spectral")
    sums = cells.groupBy("label").agg(F.sum("count").alias("_sum"), F.count("*").alias("_rows"))
    shares = join_margins(cells, sums, "label", "_rows").select("label", "kmer", (F.col("count").cast("double") / F.col("_sum")).alias("x"))
    if normalise:
        norm = distance.scale(F.sum(F.pow("x", F.lit(p))))
        norms = shares.groupBy("label").agg(F.when(norm == 0, 1.0).otherwise(norm).alias("_norm"), F.count("*").alias("_rows"))
        shares = join_margins(shares, norms, "label", "_rows").select("label", "kmer", (F.col("x") / F.col("_norm")).alias("x"))
    shares = scratch.save(shares)
    own = scratch.save(shares.groupBy("label").agg(F.sum(F.pow("x", F.lit(p))).alias("t")))
    known = own.select("label")
    rows, cols = (number_rows(x.select("label").distinct().join(known, "label", "left_semi")) for x in (second, first))
    left = rows.join(own, "label").select(F.col("at").alias("i"), F.col("label").alias("row_label"), F.col("t").alias("tr"))
    right = cols.join(own, "label").select(F.col("at").alias("j"), F.col("label").alias("col_label"), F.col("t").alias("tc"))
    every = left.join(right, F.lit(True))  # the matrix that was asked for: one row for each pair
    sums = pair_sums(shares, rows, cols, product if p == 2 else power_of_gap(p))
    total = F.col("tr") + F.col("tc") - 2 * F.coalesce("s", F.lit(0.0)) if p == 2 else F.coalesce("s", F.lit(0.0))
    return every.join(sums, ["i", "j"], "left").select("row_label", "col_label", distance.scale(F.when(F.col("row_label") == F.col("col_label"), 0.0).otherwise(F.greatest(F.lit(0.0), total))).alias("distance"))


def band_pairs(points: DataFrame, delta: float, key: str = "idx", coordinate: str = "x") -> DataFrame:
    """(lo, hi, distance) of all pairs of points on a line at most ``delta`` apart, lo < hi.

    Points are put into buckets as wide as the band; each meets its own bucket and the next,
    so no point is compared with one more than two bands away. Order by distance to
    enumerate. A delta of 0 pairs equal points; null and NaN coordinates have no partner.
    """
    rows = points.select(F.col(key).alias("k"), F.col(coordinate).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    if delta < 0:
        return rows.select(F.col("k").alias("lo"), F.col("k").alias("hi"), F.col("x").alias("distance")).where(F.lit(False))
    # a little wider than the band, so that rounding of the quotient never puts a pair two buckets apart
    bucket = F.floor(F.col("x") / (delta * (1 + 1e-9))) if delta > 0 else F.xxhash64("x")
    left = rows.select(F.col("k").alias("k1"), F.col("x").alias("x1"), bucket.alias("b1"), F.explode(F.array(bucket, bucket + 1) if delta > 0 else F.array(bucket)).alias("b"))
    right = rows.select(F.col("k").alias("k2"), F.col("x").alias("x2"), bucket.alias("b"))
    gap = F.abs(F.col("x1") - F.col("x2"))
    once = (F.col("b1") < F.col("b")) | (F.col("k1") < F.col("k2"))  # a pair of one bucket comes twice, of two buckets once
    pairs = left.join(right, "b").where((gap <= delta) & once & (F.col("k1") != F.col("k2")))
    return pairs.select(F.least("k1", "k2").alias("lo"), F.greatest("k1", "k2").alias("hi"), gap.alias("distance"))


def coordinate_range(points: DataFrame, coordinate: str = "x") -> DataFrame:
    return points.agg(F.min(coordinate).alias("low"), F.max(coordinate).alias("high"))
