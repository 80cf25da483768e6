"""Fit of a twister: correspondence analysis of a sparse table of spectra.

The Gram matrix of the spectra is summed by dense blocks (see ``blocks``), and k-mers are
projected back by blocks too; no pair of cells is a row. The eigen-decomposition of the Gram
matrix is the only step on the driver, and the number of spectra in a fit is bounded by
``MOST_SPECTRA``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.errors import InsufficientElements
from spectralmill.functions.space import array_literal
from spectralmill.operators.blocks import number_rows, pair_sums
from spectralmill.operators.order import place_rows
from spectralmill.operators.skew import join_margins
from spectralmill.scratch import Scratch

MOST_SPECTRA = 8_192


@dataclass
class Twister:
    """twister(kmer, weights), inertia(dim, name, value), twisted(label, coords) and kmers(kmer, coords)."""

    twister: DataFrame
    inertia: DataFrame
    twisted: DataFrame
    kmers: DataFrame


def keep_kmers(values: DataFrame, keep: DataFrame) -> DataFrame:
    """Only k-mers of the keep-list; names of the list that the table lacks select nothing."""
    return values.join(keep.select("kmer").distinct(), "kmer", "left_semi")


def sample_kmers(values: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The floor(n * fraction) k-mers of the smallest seeded hashes, with all their values."""
    known = values.select("kmer").distinct()
    placed = place_rows(known.withColumn("_h", F.xxhash64(F.lit(seed), "kmer")), [], ["_h", "kmer"], "_at")
    return values.join(placed.where(F.col("_at") <= int(known.count() * fraction)).select("kmer"), "kmer", "left_semi")


def threshold_kmers(values: DataFrame, fraction: float) -> DataFrame:
    """K-mers whose sum over spectra is at least ``fraction`` of the greatest such sum."""
    sums = values.groupBy("kmer").agg(F.sum("value").alias("_sum"))
    kept = sums.where(F.col("_sum") >= sums.agg(F.max("_sum")).scalar() * fraction).select("kmer")
    return values.join(kept, "kmer", "left_semi")


def normalise_spectra(values: DataFrame) -> DataFrame:
    """Values divided by their spectrum's sum; spectra of sum 0 are left out."""
    sums = values.groupBy("label").agg(F.sum("value").alias("_sum"), F.count("*").alias("_rows")).where(F.col("_sum") != 0)
    return join_margins(values, sums, "label", "_rows").select("label", "kmer", (F.col("value") / F.col("_sum")).alias("value"))


def scaled_residues(values: DataFrame) -> DataFrame:
    """(label, kmer, x) with x = P / sqrt(r c), where P = value / total, r are the row masses and c the column masses."""
    total = values.agg(F.sum("value")).first()[0]
    columns = values.groupBy("label").agg((F.sum("value") / total).alias("c"), F.count("*").alias("_rows"))
    rows = values.groupBy("kmer").agg((F.sum("value") / total).alias("r"), F.count("*").alias("_held"))
    joined = join_margins(join_margins(values, columns, "label", "_rows"), rows, "kmer", "_held")
    return Scratch(values.sparkSession, "gram").save(joined.select("kmer", "label", (F.col("value") / total / F.sqrt(F.col("r") * F.col("c"))).alias("x")))


def gram_matrix(values: DataFrame) -> DataFrame:
    """(l1, l2, g) for l1 <= l2: products of standardised residuals plus sqrt(c1 c2), over shared k-mers.

    With P = value / total, row masses r and column masses c this is
    sum over k-mers of P_k1 P_k2 / (r_k sqrt(c_1 c_2)). Pairs without a shared k-mer are missing.
    """
    numbered = number_rows(values)
    sums = pair_sums(scaled_residues(values), numbered)
    one, two = numbered.select(F.col("label").alias("l1"), F.col("at").alias("i")), numbered.select(F.col("label").alias("l2"), F.col("at").alias("j"))
    return sums.join(one, "i").join(two, "j").select("l1", "l2", F.col("s").alias("g"))


def column_masses(values: DataFrame) -> DataFrame:
    return values.groupBy("label").agg((F.sum("value") / values.agg(F.sum("value")).scalar()).alias("mass"))


def fit_twister(values: DataFrame, normalise: bool = True) -> Twister:
    """Twister of a table of transformed counts (label, kmer, value >= 0).

    Each dimension's sign is chosen so that its largest entry over the spectra is positive.
    Needs two spectra at least; zero values and k-mers without value don't matter.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "fit")
    values = values.where("value > 0").select("label", "kmer", "value")
    values = scratch.save(normalise_spectra(values) if normalise else values)
    masses = {r["label"]: r["mass"] for r in column_masses(values).limit(MOST_SPECTRA + 1).collect()}
    if len(masses) > MOST_SPECTRA:
        raise ValueError(f"a fit takes at most {MOST_SPECTRA} spectra; combine them by class first")
    labels = sorted(masses)
    if len(labels) < 2:
        raise InsufficientElements("a fit needs two spectra")
    mass = np.array([masses[label] for label in labels])
    gram = -np.sqrt(np.outer(mass, mass))
    for batch in pair_sums(scaled_residues(values), number_rows(values)).toArrow().to_batches():  # numbered in label order
        i, j, g = (batch.column(c).to_numpy() for c in ("i", "j", "s"))
        gram[i, j] += g
        gram[j[i != j], i[i != j]] += g[i != j]
    eigen, vectors = np.linalg.eigh(gram)
    order = np.argsort(eigen)[::-1]
    most = min(len(labels), values.select("kmer").distinct().count()) - 1
    order = [i for i in order[:most] if eigen[i] > 1e-12 * max(eigen.max(), 1e-300)]
    eigen, vectors = eigen[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    standard = vectors * np.where(signs == 0, 1, signs) / np.sqrt(mass)[:, None]
    coords = spark.createDataFrame([(label, [float(x) for x in row]) for label, row in zip(labels, standard)], "label string, coords array<double>")
    inertia = spark.createDataFrame([(d + 1, f"Dim{d + 1}", float(w / eigen.sum())) for d, w in enumerate(eigen)], "dim int, name string, value double")
    # row profile times column coordinates, over the squared singular values
    totals = values.groupBy("kmer").agg(F.sum("value").alias("_sum"), F.count("*").alias("_held"))
    profile = join_margins(values, totals, "kmer", "_held").select("kmer", "label", (F.col("value") / F.col("_sum")).alias("p"))
    sums = scratch.save(back_project(profile, labels, standard))
    over = lambda weights: F.zip_with("coords", array_literal(weights), lambda x, w: x / w)
    twister = sums.select("kmer", over([float(w) for w in eigen]).alias("weights"))
    kmers = sums.select("kmer", over([float(np.sqrt(w)) for w in eigen]).alias("coords"))
    return Twister(twister, inertia, coords, kmers)


SHARED_BYTES = 64 << 20  # of coordinates that go to the executors at once


def _sum_profiles(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, coords = shared.value
        place = {name: i for i, name in enumerate(names)}
        width = coords.shape[1]
        name, total = None, np.zeros(width)

        def rows(kmers: list, sums: np.ndarray) -> pa.RecordBatch:
            offsets = pa.array(np.arange(0, (len(kmers) + 1) * width, width, dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(kmers, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=["kmer", "coords"])

        step = max(1, (8 << 20) // max(1, width))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                codes = batch.column("kmer").dictionary_encode()
                code = codes.indices.to_numpy()
                starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                labels = batch.column("label").dictionary_encode()
                at = np.array([place[x] for x in labels.dictionary.to_pylist()], np.int64)[labels.indices.to_numpy()]
                sums = np.add.reduceat(batch.column("p").to_numpy()[:, None] * coords[at], starts, axis=0)
                kmers = codes.dictionary.take(pa.array(code[starts])).to_pylist()
                if kmers[0] == name:
                    sums[0] += total
                elif name is not None:
                    yield rows([name], total)
                if len(kmers) > 1:
                    yield rows(kmers[:-1], sums[:-1])
                name, total = kmers[-1], sums[-1].copy()
        if name is not None:
            yield rows([name], total)

    return run


def back_project(profile: DataFrame, labels: list[str], coords: np.ndarray) -> DataFrame:
    """(kmer, coords): for each k-mer the sum of p times its labels' coordinates; coordinates go to the executors in blocks of dimensions of at most ``SHARED_BYTES``."""
    spark = profile.sparkSession
    held = Scratch(spark, "profiles").save(profile.select("kmer", "label", "p"))
    width = max(1, SHARED_BYTES // (8 * max(1, len(labels))))
    result = None
    for begin in range(0, max(1, coords.shape[1]), width):
        shared = spark.sparkContext.broadcast((labels, np.ascontiguousarray(coords[:, begin : begin + width])))
        sorted_ = held.repartition("kmer").sortWithinPartitions("kmer")
        part = sorted_.mapInArrow(_sum_profiles(shared), "kmer string, coords array<double>")
        result = part if result is None else result.join(part.withColumnRenamed("coords", "_more"), "kmer").select("kmer", F.concat("coords", "_more").alias("coords"))
    return result
