"""Distillation: how well each k-mer separates classes of spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralmill.errors import InvalidNumberOfClasses
from spectralmill.operators.order import place_rows
from spectralmill.operators.skew import join_margins
from spectralmill.scratch import Scratch

#: fixed values: the columns of the distill table, in order
COLUMNS = [
    "InnerAvgMean", "OuterAvgMean", "ResidualAvgMean", "InnerAvgMedian", "OuterAvgMedian", "ResidualAvgMedian",
    "InnerVarMean", "OuterVarMean", "ResidualVarMean", "InnerVarMedian", "OuterVarMedian", "ResidualVarMedian",
    "InnerCOVMean", "OuterCOVMean", "ResidualCOVMean", "InnerCOVMedian", "OuterCOVMedian", "ResidualCOVMedian",
]

MOST_CLASSES = 1_000
CHUNK = 1 << 20  # holders of a k-mer that one task takes at most
STATISTICS = [f"{side}{s}{m}" for s in ("Avg", "Var", "COV") for side in ("Inner", "Outer") for m in ("Mean", "Median")]


def _gap_sums(group: np.ndarray, x: np.ndarray, base: np.ndarray, size: np.ndarray, whole: np.ndarray, before: tuple[np.ndarray, np.ndarray], classes: int) -> np.ndarray:
    """s1[a, b]: for the rows of class b the sum of absolute differences to all stored values of class a.

    ``base`` is each class's least value, ``size`` and ``whole`` its number of values and the
    sum of what they exceed it by; ``before`` says how much of both lies before these rows.
    Each sum comes from a row's place among the class's sorted values and their prefix sums,
    so no pair is formed, and equal values differ by 0 exactly.
    """
    order = np.argsort(x, kind="stable")
    group, x = group[order], x[order]
    s1 = np.zeros((classes, classes))
    for a in np.flatnonzero(size):
        own = x[group == a] - base[a]
        prefix = before[1][a] + np.append(0.0, np.cumsum(own))
        y = x - base[a]
        place = np.searchsorted(own, y, side="right")
        at, upto = before[0][a] + place, prefix[place]
        s1[a] = np.bincount(group, at * y - upto + (whole[a] - upto) - (size[a] - at) * y, classes)
    return s1


def _statistics(s1: np.ndarray, held: np.ndarray, mean: np.ndarray, squares: np.ndarray, sizes: np.ndarray) -> list[float]:
    """The 12 statistics of one k-mer from sums over its stored pairs and each class's count, mean and squared deviations; zeros follow from the classes' sizes."""
    one, two = np.triu_indices(len(sizes))
    same = one == two
    absent = sizes - held
    t1, t2 = held * mean, squares + held * mean**2
    n = np.where(same, sizes[one] * (sizes[one] - 1) / 2, sizes[one] * sizes[two])
    first = np.where(same, s1[one, two] / 2 + t1[one] * absent[one], s1[one, two] + t1[one] * absent[two] + t1[two] * absent[one])
    stored = np.where(same, held[one] * squares[one], held[two] * squares[one] + held[one] * squares[two] + held[one] * held[two] * (mean[one] - mean[two]) ** 2)
    second = stored + np.where(same, t2[one] * absent[one], t2[one] * absent[two] + t2[two] * absent[one])
    with np.errstate(all="ignore"):
        avg = np.where(n > 0, first / n, 0.0)
        spread = second - first * first / n
        # equal differences leave a rest of rounding, which a coefficient of variation would blow up
        var = np.where((n > 1) & (spread > 1e-12 * second), spread / (n - 1), 0.0)
        cov = np.where(avg != 0, np.sqrt(var) / avg, 0.0)
    out = []
    for value in (avg, var, cov):
        for side in (value[same], value[~same]):
            out += [side.mean(), np.sort(side)[len(side) // 2]]
    return out


def _moments(group: np.ndarray, x: np.ndarray, classes: int) -> tuple[np.ndarray, ...]:
    """held, base, whole (sum above base), mean and squared deviations of each class."""
    held = np.bincount(group, minlength=classes).astype(float)
    base = np.full(classes, np.inf)
    np.minimum.at(base, group, x)
    base[held == 0] = 0.0
    above = x - base[group]
    whole = np.bincount(group, above, classes)
    rest = np.divide(whole, held, out=np.zeros(classes), where=held > 0)
    return held, base, whole, base + rest, np.bincount(group, (above - rest[group]) ** 2, classes)


def _table(kmers: list, values: list[list[float]]) -> pa.RecordBatch:
    columns = np.array(values).reshape(len(kmers), len(STATISTICS)).T
    return pa.RecordBatch.from_arrays([pa.array(kmers, pa.string()), *(pa.array(c) for c in columns)], names=["kmer", *STATISTICS])


def _distilled(sizes: np.ndarray):
    """Statistics of k-mers whose holders come together; input sorted by k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, name, held = len(sizes), None, []

        def closed() -> list[float]:
            group, x = (np.concatenate(c) for c in zip(*held))
            count, base, whole, mean, squares = _moments(group, x, classes)
            none = np.zeros(classes)
            return _statistics(_gap_sums(group, x, base, count, whole, (none, none), classes), count, mean, squares, sizes)

        for batch in batches:
            codes = batch.column("kmer").dictionary_encode()
            code, group, x = codes.indices.to_numpy(), batch.column("g").to_numpy().astype(np.int64), batch.column("x").to_numpy()
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else []
            kmers, values = [], []
            for begin, end in zip(starts, np.append(starts[1:], len(code))):
                now = codes.dictionary[int(code[begin])].as_py()
                if name is not None and now != name:
                    kmers.append(name)
                    values.append(closed())
                    held = []
                name = now
                held.append((group[begin:end], x[begin:end]))
            if kmers:
                yield _table(kmers, values)
        if name is not None:
            yield _table([name], [closed()])

    return run


def _of_chunk(classes: int):
    def run(key: tuple, rows: pa.Table, margins: pa.Table) -> pa.Table:
        base, size, whole, count, total = (np.zeros(classes) for _ in range(5))
        g = margins.column("g").to_numpy()
        for target, name in ((base, "base"), (size, "size"), (whole, "whole"), (count, "earlier"), (total, "earlier_sum")):
            target[g] = margins.column(name).to_numpy()
        if rows.num_rows == 0:
            return pa.table({"kmer": pa.array([], pa.string()), "s1": pa.array([], pa.list_(pa.float64()))})
        s1 = _gap_sums(rows.column("g").to_numpy().astype(np.int64), rows.column("x").to_numpy(), base, size, whole, (count, total), classes)
        return pa.table({"kmer": rows.column("kmer").slice(0, 1), "s1": pa.array([s1.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def _distill_crowded(shares: DataFrame, sizes: np.ndarray, chunk: int) -> DataFrame:
    """Statistics of k-mers with more holders than one task takes: their values are sorted and worked off in chunks."""
    classes, scratch = len(sizes), Scratch(shares.sparkSession, "crowded")
    placed = place_rows(shares, ["kmer"], ["x", "g"], "_at")
    placed = scratch.save(placed.withColumn("chunk", F.floor((F.col("_at") - 1) / chunk)).drop("_at"))
    of_class = scratch.save(placed.groupBy("kmer", "g").agg(F.min("x").alias("base"), F.count("*").cast("double").alias("size"), F.avg("x").alias("mean")))
    above = join_margins(placed.withColumn("_k", F.struct("kmer", "g")), of_class.withColumn("_k", F.struct("kmer", "g")).select("_k", "base", "mean", "size"), "_k", "size")
    in_chunk = scratch.save(above.groupBy("kmer", "g", "chunk").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("x") - F.col("base")).alias("t"), F.sum((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("q")))
    sums = scratch.save(in_chunk.groupBy("kmer", "g").agg(F.sum("t").alias("whole"), F.sum("q").alias("squares")).join(of_class, ["kmer", "g"]))
    chunks = in_chunk.select("kmer", "chunk").distinct()  # one row for each ``chunk`` holders
    earlier = W.partitionBy("kmer", "g").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    every = chunks.join(sums, "kmer").join(in_chunk, ["kmer", "g", "chunk"], "left").withColumns({"earlier": F.coalesce(F.sum("n").over(earlier), F.lit(0.0)), "earlier_sum": F.coalesce(F.sum("t").over(earlier), F.lit(0.0))})
    margins = every.select("kmer", "chunk", "g", "base", "size", "whole", "earlier", "earlier_sum")
    parts = placed.groupBy("kmer", "chunk").cogroup(margins.groupBy("kmer", "chunk")).applyInArrow(_of_chunk(classes), "kmer string, s1 array<double>")
    add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    s1 = parts.groupBy("kmer").agg(F.aggregate(F.collect_list("s1"), F.array().cast("array<double>"), add).alias("s1"))
    fields = sums.groupBy("kmer").agg(F.collect_list(F.struct("g", "size", "mean", "squares")).alias("m"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for s, m in zip(batch.column("s1").to_pylist(), batch.column("m").to_pylist()):
                held, mean, squares = np.zeros((3, classes))
                for r in m:
                    held[r["g"]], mean[r["g"]], squares[r["g"]] = r["size"], r["mean"], r["squares"]
                values.append(_statistics(np.array(s).reshape(classes, classes), held, mean, squares, sizes))
            if values:
                yield _table(batch.column("kmer").to_pylist(), values)

    return s1.join(fields, "kmer").mapInArrow(finish, TABLE)


TABLE = ", ".join(["kmer string", *(f"{n} double" for n in STATISTICS)])


def distill(cells: DataFrame, groups: DataFrame, kmers: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(kmer, 18 statistics) over all pairs of spectra.

    Counts are divided by their spectrum's sum. For every k-mer, the absolute differences of
    all pairs of spectra fall into one bucket for each pair of classes, of which mean, sample
    variance and sample coefficient of variation are taken; of these, mean and upper median
    over the inner buckets (a class with itself) and the outer ones; last, the residual of
    outer against a straight line in inner, fitted over all k-mers. Buckets without enough
    pairs for a statistic, or whose mean is 0 for a coefficient of variation, give 0.

    ``groups`` has label and group for every spectrum. Differences of stored counts are summed
    by sorting, without forming pairs; pairs with one zero follow from the classes' sums,
    pairs of two zeros add nothing but their number. A k-mer is worked off by one task if it
    has at most ``chunk`` holders, otherwise in sorted chunks of as many; only a row of
    statistics leaves a task.
    """
    spark = cells.sparkSession
    scratch = Scratch(spark, "distill")
    listed = sorted(groups.where("`group` is not null").groupBy(F.col("group").cast("string").alias("group")).agg(F.count_distinct("label").alias("size")).limit(MOST_CLASSES + 1).collect(), key=lambda r: r["group"])
    classes, spectra = len(listed), sum(r["size"] for r in listed)
    if classes > MOST_CLASSES:
        raise InvalidNumberOfClasses(f"more than {MOST_CLASSES} classes")
    if classes <= 1 or classes == spectra:
        raise InvalidNumberOfClasses(f"{classes} classes of {spectra} spectra")
    sizes = np.array([r["size"] for r in listed], float)
    coded = F.broadcast(spark.createDataFrame([(r["group"], i) for i, r in enumerate(listed)], "`_group` string, g int"))
    of_label = groups.select("label", F.col("group").cast("string").alias("_group")).distinct().join(coded, "_group").select("label", "g")
    norms = cells.groupBy("label").agg(F.sum("count").alias("norm"), F.count("*").alias("_rows"))
    shares = join_margins(cells, norms.join(of_label, "label"), "label", "_rows").select("kmer", "g", (F.col("count").cast("double") / F.col("norm")).alias("x"))
    shares = scratch.save(shares)
    holders = shares.groupBy("kmer").agg(F.count("*").alias("_n"))
    crowded = scratch.save(holders.where(F.col("_n") > chunk))
    few = shares if crowded.isEmpty() else join_margins(shares, crowded, "kmer", "_n", "left").where("_n is null").drop("_n")
    table = few.repartition("kmer").sortWithinPartitions("kmer").mapInArrow(_distilled(sizes), TABLE)
    if not crowded.isEmpty():
        table = table.unionByName(_distill_crowded(join_margins(shares, crowded, "kmer", "_n").drop("_n"), sizes, chunk))
    known = (kmers if kmers is not None else cells).select("kmer").distinct()
    table = scratch.save(known.join(table, "kmer", "left").fillna(0.0, STATISTICS))
    names = [f"{s}{m}" for s in ("Avg", "Var", "COV") for m in ("Mean", "Median")]
    lines = table.agg(*(f(F.col(f"Outer{n}"), F.col(f"Inner{n}")).alias(f"{k}{n}") for n in names for f, k in ((F.regr_slope, "slope"), (F.regr_intercept, "base"))))
    fitted = table.join(F.broadcast(lines), F.lit(True))  # one row
    for n in names:
        flat = F.coalesce(F.col(f"base{n}") + F.col(f"slope{n}") * F.col(f"Inner{n}"), F.lit(0.0))
        fitted = fitted.withColumn(f"Residual{n}", F.col(f"Outer{n}") - flat)
    return fitted.select("kmer", *COLUMNS)
