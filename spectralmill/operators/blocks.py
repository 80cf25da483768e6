"""Sums over shared columns for all pairs of rows of sparse tables, by dense blocks.

The rows are numbered and cut into tiles. A pair of tiles, and a part of the columns, is the
work of one task: it fills dense blocks of a few columns at a time and adds up their product
(or another term) in one matrix of tile by tile. No pair of cells is ever a row. The parts'
matrices are added up, row by row, in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.operators.order import place_rows
from spectralmill.operators.skew import join_margins
from spectralmill.scratch import Scratch

TILE = 512
COLUMNS = 256  # columns of one dense block
PART_CELLS = 1 << 22  # cells of a part of the columns, about

Term = Callable[[np.ndarray, np.ndarray], np.ndarray]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.T @ b


def power_of_gap(exponent: float) -> Term:
    """Sum over columns of the absolute differences to a power."""

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((a.shape[1], b.shape[1]))
        for x, y in zip(a, b):  # one column at a time
            gap = np.abs(x[:, None] - y[None])
            out += gap if exponent == 1 else gap**exponent
        return out

    return run


def _multiply(term: Term, tile: int):
    """(ti, tj, i, sums): per task's tile pair the rows of the summed matrix; input sorted by (ti, tj, part, column)."""
    schema = pa.schema([("ti", pa.int64()), ("tj", pa.int64()), ("i", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros((tile, tile))
        held: list[tuple[np.ndarray, ...]] = []  # cells of the last column, which may go on

        def add(side: np.ndarray, at: np.ndarray, x: np.ndarray, fresh: np.ndarray) -> None:
            number = np.cumsum(fresh) - 1
            for begin in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
                lo, hi = np.searchsorted(number, (begin, begin + COLUMNS))
                a, b = np.zeros((2, COLUMNS, tile))
                own, other = side[lo:hi] != 1, side[lo:hi] != 0  # side 2 is on both
                n = number[lo:hi] - begin
                a[n[own], at[lo:hi][own]] = x[lo:hi][own]
                b[n[other], at[lo:hi][other]] = x[lo:hi][other]
                width = int(n[-1]) + 1
                total.__iadd__(term(a[:width], b[:width]))

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                side, at, x = (np.concatenate(c) for c in zip(*held))
                add(side, at, x, np.arange(len(x)) == 0)
                held.clear()
            rows = np.flatnonzero(total.any(1))
            if key is not None and len(rows):
                offsets = pa.array(np.arange(0, (len(rows) + 1) * tile, tile, dtype=np.int32))
                sums = pa.ListArray.from_arrays(offsets, pa.array(total[rows].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), key[0])), pa.array(np.full(len(rows), key[1])), pa.array(rows), sums.cast(schema.field(3).type)], schema=schema)
            total.fill(0)

        last_name = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("ti", "tj", "part")])
            side, at, x = (batch.column(c).to_numpy() for c in ("side", "at", "x"))
            codes = batch.column("column").dictionary_encode()
            code, names = codes.indices.to_numpy(), codes.dictionary
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            for begin, end in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
                now = tuple(int(v) for v in ids[:, begin])
                if now != key:
                    yield from closed()
                    key, last_name = now, None
                c = code[begin:end]
                fresh = np.append(True, c[1:] != c[:-1])
                starts = np.flatnonzero(fresh)
                goes_on = last_name is not None and names[int(c[0])].as_py() == last_name
                first_end = begin + (starts[1] if len(starts) > 1 else end - begin)
                if goes_on:
                    held.append((side[begin:first_end], at[begin:first_end], x[begin:first_end]))
                    if len(starts) == 1:
                        continue
                    begin_rest = first_end
                else:
                    begin_rest = begin
                if held:
                    s, p, v = (np.concatenate(h) for h in zip(*held))
                    add(s, p, v, np.arange(len(v)) == 0)
                    held.clear()
                last_start = begin + starts[-1]
                if last_start > begin_rest:
                    add(side[begin_rest:last_start], at[begin_rest:last_start], x[begin_rest:last_start], fresh[begin_rest - begin : last_start - begin])
                held.append((side[last_start:end], at[last_start:end], x[last_start:end]))
                last_name = names[int(c[-1])].as_py()
        yield from closed()

    return run


def number_rows(labels: DataFrame) -> DataFrame:
    """(label, at): every label once, numbered from 0 in label order."""
    placed = place_rows(labels.select("label").where("label is not null").distinct(), [], ["label"], "_p")
    return Scratch(labels.sparkSession, "numbers").save(placed.select("label", (F.col("_p") - 1).alias("at")))


def pair_sums(cells: DataFrame, rows: DataFrame, columns: DataFrame | None = None, term: Term = product, tile: int = TILE, part_cells: int = PART_CELLS) -> DataFrame:
    """(i, j, s): for numbered rows and columns the sum of ``term`` over all shared keys; pairs whose sum is 0 may be missing.

    ``cells`` has label, kmer and x, each label and k-mer once. ``rows`` and ``columns`` come
    from ``number_rows``; without columns the rows meet themselves, once for each pair i <= j.
    A cell is sent to every tile of the other side, so the shuffle grows with the number of
    tiles of ``tile`` labels; a k-mer held by all labels is cut into tiles like any other.
    """
    scratch = Scratch(cells.sparkSession, "blocks")
    same = columns is None
    sides = [(0, rows)] if same else [(0, rows), (1, columns)]
    count = {side: f.agg(F.max("at")).first()[0] for side, f in sides}
    tiles = {side: 0 if top is None else top // tile + 1 for side, top in count.items()}
    held = cells.groupBy("label").agg(F.count("*").alias("_n"))
    placed = []
    for side, numbered in sides:
        mine = join_margins(cells.select("label", "kmer", "x"), numbered.join(held, "label"), "label", "_n")
        t = F.floor(F.col("at") / tile)
        others = tiles[0] if same else tiles[1 - side]
        spread = mine.select("kmer", "x", (F.col("at") % tile).alias("at"), t.alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(max(0, others - 1)))).alias("_o"))
        if same:  # tile t meets all tiles; the smaller number is the pair's first
            spread = spread.select("kmer", "x", "at", F.least("_t", "_o").alias("ti"), F.greatest("_t", "_o").alias("tj"), F.when(F.col("_t") == F.col("_o"), 2).when(F.col("_t") < F.col("_o"), 0).otherwise(1).alias("side"))
        else:
            own, other = ("_t", "_o") if side == 0 else ("_o", "_t")
            spread = spread.select("kmer", "x", "at", F.col(own).alias("ti"), F.col(other).alias("tj"), F.lit(side).alias("side"))
        placed.append(spread)
    every = placed[0] if same else placed[0].unionByName(placed[1])
    parts = max(1, int(-(-(cells.count() // max(1, max(tiles.values()))) // part_cells)))
    routed = every.select(F.col("ti").cast("long").alias("ti"), F.col("tj").cast("long").alias("tj"), F.pmod(F.xxhash64("kmer"), F.lit(parts)).cast("long").alias("part"), F.col("kmer").alias("column"), F.col("side").cast("int").alias("side"), F.col("at").cast("long").alias("at"), F.col("x").cast("double").alias("x"))
    routed = routed.repartition("ti", "tj", "part").sortWithinPartitions("ti", "tj", "part", "column")
    partial = scratch.save(routed.mapInArrow(_multiply(term, tile), "ti bigint, tj bigint, i bigint, sums array<double>"))
    add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    summed = partial.groupBy("ti", "tj", "i").agg(F.collect_list("sums").alias("_s")) if parts > 1 else partial.select("ti", "tj", "i", F.array("sums").alias("_s"))
    each = summed.select("ti", "tj", "i", F.posexplode(F.aggregate("_s", F.array().cast("array<double>"), add)).alias("j", "s"))
    pairs = each.select((F.col("ti") * tile + F.col("i")).alias("i"), (F.col("tj") * tile + F.col("j")).alias("j"), "s").where("s <> 0")
    last = [-1 if top is None else top for top in count.values()]
    pairs = pairs.where((F.col("i") <= last[0]) & (F.col("j") <= last[-1]))  # a tile may be wider than what is left
    return pairs.where("i <= j") if same else pairs
