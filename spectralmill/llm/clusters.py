"""Groups of mutually similar vectors, from all pairs within reach.

Space is parted into boxes and balls (``boxes``) in which every pair within reach is counted
once. The smallest label that spreads over linked labels to convergence names a group, and a
group is mutual if each of its labels has all others within reach. Vectors are sent in rounds,
so that what is shuffled at once stays about the size of the input.

Boxes too crowded to be compared as a whole take grid density clustering instead: the features
are quantised on several shifted grids of wide cells, records are linked to the pivots of their
cell, groups of which any two members are within reach are joined by comparing members in
overlapping cells, and groups with such members are checked for mutual reach by comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.functions.space import array_literal, squared_distance
from spectralmill.llm.boxes import Balls, Boxes, near_pairs, screened
from spectralmill.llm.neighbours import SAMPLE, _groups, matrix_of, whole_groups
from spectralmill.operators.skew import join_margins
from spectralmill.scratch import Scratch

GRIDS = 12
CELL = 16 / 3  # width of a cell in units of reach
BLOCK = 2_048
BALL = 512  # rows of the groups that are looked for as balls, at least
CROWD = 16  # a box of more blocks than that isn't compared as a whole
LEAST_ROUND = 1 << 20  # rows that a round may always send
LINK = "label string, pivot string, degree bigint"
AXES = 14  # dimensions of the overlapping cells; a row is seated in 2 ** AXES cells at most, in about ten on average


def _cells(rows: DataFrame, key: str, width: float, grids: int, dims: int, seed: int) -> DataFrame:
    """(cell, key): the cell of every row on every shifted grid; cells are named by a 64-bit hash."""
    shifts = np.random.default_rng(seed).uniform(0, width, (grids, dims))
    names = [F.xxhash64(F.lit(g), F.transform(F.zip_with("coords", array_literal(list(s)), lambda x, y: (x + y) / width), lambda v: F.floor(v))) for g, s in enumerate(shifts)]
    return rows.select(key, F.explode(F.array(*names)).alias("cell"))


def _leaders(reach: float):
    """Links of records to the pivots of their cell; input sorted by (cell, part, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["cell", "part"]):
            cell, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part"))
            x = matrix_of(batch.column("coords"))
            starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))
            label, pivot = [], []
            for begin, end in zip(starts, np.append(starts[1:], len(cell))):
                left = np.arange(begin, end)
                while len(left) > 1:
                    gap = x[left] - x[left[0]]
                    near = np.sqrt(np.einsum("ij,ij->i", gap, gap)) <= reach
                    if near.sum() > 1:
                        label.append(left[near][1:])
                        pivot.append(np.full(len(label[-1]), left[0]))
                    left = left[~near]
            if label:
                names = batch.column("label")
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(label))), names.take(pa.array(np.concatenate(pivot)))], names=["label", "pivot"])

    return run


def _pivot_links(vectors: DataFrame, cells: DataFrame, reach: float, scratch: Scratch) -> DataFrame:
    """(label, pivot) of records within reach of a pivot of one of their cells.

    A cell of many records is worked off in parts of about ``BLOCK`` records, drawn anew on
    every grid. Links between parts that no other grid finds are left to ``_touching``, which
    leaves out no pair of blocks.
    """
    cells = scratch.save(cells)
    dense = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("cell", "label"), F.ceil(F.col("n") / (4 * BLOCK)).cast("int")).cast("int")
    seated = join_margins(cells, scratch.save(dense), "cell", "n").select("cell", part.alias("part"), "label")
    routed = seated.join(vectors, "label").select("cell", "part", "label", "coords").repartition("cell", "part").sortWithinPartitions("cell", "part", "label")
    return scratch.save(routed.mapInArrow(_leaders(reach), "label string, pivot string").distinct())


def smallest_labels(links: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, comp): the smallest label that each label is connected with, by propagation to convergence.

    ``links`` has label and pivot, ``labels`` all labels. A pivot may have any number of links.
    """
    degree = scratch.save(links.groupBy("pivot").agg(F.count("*").alias("n")))
    now = scratch.save(labels.select("label", F.col("label").alias("comp")))
    while True:
        told = links.join(now, "label").groupBy("pivot").agg(F.min("comp").alias("comp"))
        heads = told.join(now.select(F.col("label").alias("pivot"), F.col("comp").alias("own")), "pivot").select("pivot", F.least("comp", "own").alias("comp"))
        heads = scratch.save(heads.join(degree, "pivot"))
        back = join_margins(links, heads, "pivot", "n").select("label", "comp")
        heard = back.unionByName(heads.select(F.col("pivot").alias("label"), "comp")).groupBy("label").agg(F.min("comp").alias("heard"))
        then = scratch.save(now.join(heard, "label", "left").select("label", F.least("comp", F.coalesce("heard", "comp")).alias("comp"), (F.col("heard") < F.col("comp")).alias("changed")))
        settled = then.where("changed").isEmpty()
        scratch.drop(heads)
        scratch.drop(now)
        now = then.drop("changed")
        if settled:
            return now


def _stats(members: DataFrame, dims: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """comps: comp, n, center, radius; members with r, their distance from the center."""
    means = members.groupBy("comp").agg(F.count("*").alias("n"), *(F.avg(F.col("coords")[i]).alias(f"_m{i}") for i in range(dims)))
    comps = scratch.save(means.select("comp", "n", F.array(*(f"_m{i}" for i in range(dims))).alias("center")))
    placed = scratch.save(join_margins(members, comps, "comp", "n").withColumn("r", F.sqrt(squared_distance(F.col("coords"), F.col("center"), dims))).select("label", "comp", "coords", "r"))
    radius = placed.groupBy("comp").agg(F.max("r").alias("radius"))
    return scratch.save(comps.join(radius, "comp")), placed


def _seats(reach: float, width: float, axes: list[int], shifts: np.ndarray):
    """(cell, comp, label): every cell of the axes' grid that comes within half of reach of a row.

    Rows within reach of each other have a cell in common: on each axis their intervals of
    half of reach meet. Cells are named by a 64-bit hash; a clash only adds comparisons.
    """
    margin = reach / 2 * (1 + 1e-9) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix_of(batch.column("coords"))[:, axes] + shifts
            low, high = (np.floor(v / width).astype(np.int64) for v in (x - margin, x + margin))
            row, cell = np.arange(len(x)), np.zeros(len(x), np.uint64)
            for axis in range(len(axes)):
                both = high[row, axis] > low[row, axis]
                step = np.concatenate((low[row, axis], high[row[both], axis])).view(np.uint64)
                row, cell = np.concatenate((row, row[both])), np.concatenate((cell, cell[both]))
                cell = (cell ^ (step + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
                cell ^= cell >> np.uint64(32)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), batch.column("comp").take(take), batch.column("label").take(take)], names=["cell", "comp", "label"])

    return run


def _linked_groups(reach: float):
    """(one, two): groups of which a row of side 0 and a row of side 1 are within reach; input sorted by (g, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["g", "i", "j"]):
            group = table.combine_chunks().to_batches()[0]
            names = group.column("comp").dictionary_encode()
            x, side, comp = matrix_of(group.column("coords")), group.column("side").to_numpy(), names.indices.to_numpy().astype(np.int64)
            a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2 is on both
            square, count, found = np.einsum("ij,ij->i", x, x), len(names.dictionary), []
            slack = 1e-6 + 1e-9 * float(square.max())
            for begin in range(0, len(a), 512):
                part = a[begin : begin + 512]
                d2 = square[part, None] + square[b][None] - 2 * (x[part] @ x[b].T)
                i, j = np.nonzero(d2 <= reach * reach + slack)
                i, j = part[i], b[j]
                other = comp[i] != comp[j]
                i, j = i[other], j[other]
                near = np.sqrt(((x[i] - x[j]) ** 2).sum(1)) <= reach
                one, two = comp[i[near]], comp[j[near]]
                found.append(np.unique(np.minimum(one, two) * count + np.maximum(one, two)))
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(pairs // count)), names.dictionary.take(pa.array(pairs % count))], names=["one", "two"])

    return run


def _any_pair(keys: list[str], beyond: bool, reach: float):
    """Groups in which some row of side 0 and some row of side 1 are within (or beyond) reach; groups are small blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            group = table.combine_chunks().to_batches()[0]
            x, side = matrix_of(group.column("coords")), group.column("side").to_numpy()
            a, b = x[side != 1], x[side != 0]  # side 2 is on both
            hit = False
            for begin in range(0, len(a), 512):
                d = np.sqrt(((a[begin : begin + 512, None] - b[None]) ** 2).sum(2)) if len(b) * x.shape[1] < 1 << 14 else None
                if d is None:
                    part = a[begin : begin + 512]
                    d2 = (part**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (part @ b.T)
                    i, j = np.nonzero(d2 >= reach * reach - 1e-6 if beyond else d2 <= reach * reach + 1e-6)
                    d = np.sqrt(((part[i] - b[j]) ** 2).sum(1))
                if ((d > reach) if beyond else (d <= reach)).any():
                    hit = True
                    break
            if hit:
                yield pa.RecordBatch.from_arrays([group.column("one").slice(0, 1), group.column("two").slice(0, 1)], names=["one", "two"])

    return run


def _blocked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of groups (one, two) cut into blocks, each pair of blocks together; side 2 where a block meets itself."""
    rows = scratch.save(rows.withColumn("_k", F.struct("one", "two")))
    count = rows.groupBy("_k", "side").agg(F.count("*").alias("n"))
    parts = scratch.save(count.groupBy("_k").agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("parts"), F.sum("n").alias("n")))
    placed = join_margins(rows, parts, "_k", "n").withColumn("_b", F.pmod(F.xxhash64("label"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    spread = placed.withColumn("_o", F.explode(every)).withColumns({"i": F.least("_b", "_o"), "j": F.greatest("_b", "_o")})
    spread = spread.withColumn("side", F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1))
    group = F.xxhash64("one", "two")
    return spread.select(group.alias("g"), "i", "j", F.col("side").cast("int").alias("side"), "one", "two", "coords").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def _touching(members: DataFrame, reach: float, width: float, dims: int, seed: int, scratch: Scratch) -> DataFrame:
    """(one, two): all groups that have members within reach of each other.

    Members are seated in overlapping cells of the ``AXES`` widest dimensions, and in a cell all
    members of different groups are compared, by pairs of blocks of about ``BLOCK`` members. A group
    with more members in a cell has blocks of its own there, which don't meet each other.
    """
    spreads = members.agg(*(F.var_pop(F.col("coords")[i]).alias(f"_v{i}") for i in range(dims))).first()
    axes = sorted(range(dims), key=lambda i: -(spreads[i] or 0.0))[:AXES]
    shifts = np.random.default_rng(seed).uniform(0, width, len(axes))
    seats = scratch.save(members.select("label", "comp", "coords").mapInArrow(_seats(reach, width, axes, shifts), "cell bigint, comp string, label string").withColumn("_k", F.struct("cell", "comp")))
    held = scratch.save(seats.groupBy("_k").agg(F.count("*").alias("n")))
    crowd = F.when(F.col("n") <= BLOCK, F.col("n"))
    cells = held.groupBy(F.col("_k.cell").alias("cell")).agg(F.count("*").alias("comps"), F.sum(crowd).alias("crowd")).where("comps > 1")
    own = F.when(F.col("n") > BLOCK, F.col("_k.comp")).otherwise("")
    parts = F.ceil(F.when(F.col("n") > BLOCK, F.col("n")).otherwise(F.col("crowd")) / BLOCK).cast("int")
    margins = scratch.save(held.withColumn("cell", F.col("_k.cell")).join(cells, "cell").select("_k", "n", own.alias("own"), parts.alias("parts")))
    block = F.struct("own", F.pmod(F.xxhash64("label"), F.col("parts")).cast("int").alias("part"))
    placed = scratch.save(join_margins(seats, margins, "_k", "n").select("cell", block.alias("block"), "comp", "label"))
    blocks = scratch.save(placed.select("cell", "block").distinct())
    met = blocks.withColumnRenamed("block", "one").join(blocks.withColumnRenamed("block", "two"), "cell").where("one <= two and (one.own = '' or one.own <> two.own)")
    met = scratch.save(met.select("cell", "one", "two", F.xxhash64("one").alias("i"), F.xxhash64("two").alias("j")))
    sides = met.select("cell", F.col("one").alias("block"), "i", "j", F.when(F.col("one") == F.col("two"), 2).otherwise(0).alias("side")).unionByName(met.where("one < two").select("cell", F.col("two").alias("block"), "i", "j", F.lit(1).alias("side")))
    routed = placed.join(sides, ["cell", "block"]).join(members.select("label", "coords"), "label").select(F.col("cell").alias("g"), "i", "j", "side", "comp", "coords")
    return routed.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_linked_groups(reach), "one string, two string").distinct()


def _joined(vectors: DataFrame, named: DataFrame, reach: float, width: float, dims: int, seed: int, scratch: Scratch) -> DataFrame:
    """(label, comp) after joining all groups that have members within reach of each other."""
    touching = scratch.save(_touching(scratch.save(vectors.join(named, "label")), reach, width, dims, seed + 1, scratch))
    joined = smallest_labels(touching.select(F.col("two").alias("label"), F.col("one").alias("pivot")), named.select(F.col("comp").alias("label")).distinct(), scratch)
    renamed = joined.where("comp <> label").select(F.col("label").alias("comp"), F.col("comp").alias("_new"))
    return scratch.save(named.join(renamed, "comp", "left").select("label", F.coalesce("_new", "comp").alias("comp")))


def _sample(vectors: DataFrame, dims: int, count: int, seed: int) -> np.ndarray:
    share = min(1.0, SAMPLE / max(1, count))
    part = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "label"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE)
    return np.concatenate([np.zeros((0, dims)), *(matrix_of(c) for c in part.select("coords").toArrow().column("coords").chunks if len(c))])


def _in_balls(balls: Broadcast):
    """(label, ball, gap) of the rows in balls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball, gap = balls.value.of(matrix_of(batch.column("coords")))
            take = np.flatnonzero(ball >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(take)), pa.array(ball[take].astype(np.int32)), pa.array(gap[take])], names=["label", "ball", "gap"])

    return run


def _free_seats(balls: Broadcast, boxes: Broadcast, kept: np.ndarray | None):
    """(box, label, coords) of the rows in no ball, for the boxes that are kept; (box, n) if none are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(boxes.value.low), np.int64)
        for batch in batches:
            x = matrix_of(batch.column("coords"))
            free = np.flatnonzero(balls.value.of(x)[0] < 0)
            row, box = boxes.value.seats(x[free])
            if kept is None:
                counts += np.bincount(box, minlength=len(counts))
                continue
            take, box = pa.array(free[row[kept[box]]]), box[kept[box]]
            yield pa.RecordBatch.from_arrays([pa.array(box.astype(np.int32)), batch.column("label").take(take), batch.column("coords").take(take)], names=["box", "label", "coords"])
        if kept is None:
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts).astype(np.int32)), pa.array(counts[counts > 0])], names=["box", "n"])

    return run


def _box_links(boxes: Broadcast, reach: float):
    """(label, pivot, degree): pairs within reach that a label has in a box, and the smallest label they connect it with; input sorted by (box, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["box"]):
            group = table.combine_chunks().to_batches()[0]
            degree, first = boxes.value.linked_rows(matrix_of(group.column("coords")), group.column("box")[0].as_py(), reach)
            rows, names = np.flatnonzero(degree), group.column("label")
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), names.take(pa.array(first[rows])), pa.array(degree[rows])], names=["label", "pivot", "degree"])

    return run


def _around_balls(balls: Broadcast, reach: float, opened: np.ndarray | None):
    """(ball, side, label, coords): rows that may have members of another ball within reach, side 1; the members of ``opened`` balls, side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("coords"))
            ball = balls.value.of(x)[0]
            if opened is None:
                row, ball = balls.value.around(x, ball, reach)
            else:
                row = np.flatnonzero(opened[ball] & (ball >= 0))
                ball = ball[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(ball.astype(np.int32)), pa.array(np.full(len(row), int(opened is None), np.int32)), batch.column("label").take(take), batch.column("coords").take(take)], names=["ball", "side", "label", "coords"])

    return run


def _ball_pairs(balls: Broadcast, reach: float):
    """(label, pivot, degree) of members of a ball (side 0) and rows around it (side 1) that are within reach; input sorted by (ball, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["ball", "i", "j"]):
            group = table.combine_chunks().to_batches()[0]
            x, side = matrix_of(group.column("coords")), group.column("side").to_numpy()
            left, right, half, slack = screened(x)
            members, others, degree = np.flatnonzero(side == 0), np.flatnonzero(side == 1), np.zeros(len(x), np.int64)
            for begin in range(0, len(members) if len(others) else 0, 32):
                part = members[begin : begin + 32]
                i, j = near_pairs(left[part], right[others], half[part], x[part], x[others], reach, slack)
                degree += np.bincount(part[i], minlength=len(x)) + np.bincount(others[j], minlength=len(x))
            rows = np.flatnonzero(degree)
            name = balls.value.name[group.column("ball")[0].as_py()]
            yield pa.RecordBatch.from_arrays([group.column("label").take(pa.array(rows)), pa.array([name] * len(rows), pa.string()), pa.array(degree[rows])], names=["label", "pivot", "degree"])

    return run


def _ball_links(vectors: DataFrame, balls: Balls, reach: float, scratch: Scratch) -> list[DataFrame]:
    """(label, pivot, degree) of all pairs that have a row in a ball; counts the rows of ``balls``."""
    spark = vectors.sparkSession
    placed = scratch.save(vectors.mapInArrow(_in_balls(spark.sparkContext.broadcast(balls)), "label string, ball int, gap double"))
    balls.size = np.zeros(len(balls.centers), np.int64)
    for r in placed.groupBy("ball").agg(F.count("*").alias("n"), F.max("gap").alias("radius"), F.min("label").alias("name")).collect():
        balls.size[r.ball], balls.radius[r.ball], balls.name[r.ball] = r.n, r.radius, r.name
    shared = spark.sparkContext.broadcast(balls)
    names = spark.createDataFrame([(k, name, int(n)) for k, (name, n) in enumerate(zip(balls.name, balls.size))], "ball int, pivot string, n bigint")
    links = [placed.join(F.broadcast(names), "ball").select("label", "pivot", (F.col("n") - 1).alias("degree"))]
    row = "ball int, side int, label string, coords array<double>"
    around = scratch.save(vectors.mapInArrow(_around_balls(shared, reach, None), row))
    held = {r.ball: r.n for r in around.groupBy("ball").agg(F.count("*").alias("n")).collect()}
    if held:
        opened = np.isin(np.arange(len(balls.size)), list(held))
        parts = spark.createDataFrame([(k, -(-int(balls.size[k]) // (2 * BLOCK)), -(-n // (2 * BLOCK))) for k, n in held.items()], "ball int, p int, q int")
        both = vectors.mapInArrow(_around_balls(shared, reach, opened), row).unionByName(around).join(F.broadcast(parts), "ball")
        member, own = F.col("side") == 0, F.xxhash64("label")
        every = F.explode(F.sequence(F.lit(0), F.when(member, F.col("q")).otherwise(F.col("p")) - 1))
        both = both.withColumn("_own", F.pmod(own, F.when(member, F.col("p")).otherwise(F.col("q"))).cast("int")).withColumn("_every", every)
        both = both.select("ball", F.when(member, F.col("_own")).otherwise(F.col("_every")).alias("i"), F.when(member, F.col("_every")).otherwise(F.col("_own")).alias("j"), "side", "label", "coords")
        links.append(scratch.save(both.repartition("ball", "i", "j").sortWithinPartitions("ball", "i", "j").mapInArrow(_ball_pairs(shared, reach), LINK)))
    scratch.drop(around)
    return links


def _mutual(vectors: DataFrame, named: DataFrame, reach: float, dims: int, scratch: Scratch) -> DataFrame:
    """comp of the groups that have two members beyond reach of each other."""
    comps, placed = _stats(scratch.save(vectors.join(named, "label")), dims, scratch)
    # members so near the center that their distance to any other can't exceed reach need no comparison
    outer = join_margins(placed, comps.select("comp", "n", "radius"), "comp", "n").where(F.col("r") + F.col("radius") > reach - 1e-9)
    wide = _blocked(outer.select(F.col("comp").alias("one"), F.col("comp").alias("two"), F.lit(0).alias("side"), "label", "coords"), scratch)
    return scratch.save(wide.mapInArrow(_any_pair(["g", "i", "j"], True, reach), "one string, two string").select(F.col("one").alias("comp")).distinct())


def similar_groups(vectors: DataFrame, reach: float, dims: int, grids: int = GRIDS, cell: float = CELL, seed: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(label, comp, size, mutual): the group of every label.

    ``vectors`` has label (unique, not null) and coords (``dims`` finite numbers). comp is the
    group's smallest label, size its number of labels; mutual tells whether any two labels of the
    group are within ``reach``, which is so if each has all others within reach. Groups are the
    connected parts of the graph that links labels within reach. All such pairs are counted, in
    rounds that send about as many rows as there are vectors; those of rows in crowded boxes are
    not counted but found by ``_touching``. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "clusters", tidy=True)
    context = vectors.sparkSession.sparkContext
    vectors = vectors.select("label", "coords")
    count = vectors.count()
    sample = _sample(vectors, dims, count, seed)
    share = len(sample) / max(1, count)
    balls = Balls(sample, reach, BALL * share, seed)
    near = _ball_links(vectors, balls, reach, scratch) if len(balls.centers) else []
    boxes = context.broadcast(Boxes(sample[balls.of(sample)[0] < 0], reach, BLOCK * share))
    balls = context.broadcast(balls)
    seated = np.zeros(len(boxes.value.low), np.int64)
    for r in vectors.mapInArrow(_free_seats(balls, boxes, None), "box int, n bigint").groupBy("box").agg(F.sum("n").alias("n")).collect():
        seated[r.box] = r.n
    crowded = seated > CROWD * BLOCK
    run = np.cumsum(np.where(crowded, 0, seated))
    rounds = -(-int(run[-1]) // max(count, LEAST_ROUND))
    for k in range(rounds):
        kept = ~crowded & (seated > 1) & (np.minimum(run * rounds // int(run[-1]), rounds - 1) == k)
        routed = vectors.mapInArrow(_free_seats(balls, boxes, kept), "box int, label string, coords array<double>").repartition("box").sortWithinPartitions("box", "label")
        near.append(scratch.save(routed.mapInArrow(_box_links(boxes, reach), LINK)))
    width = max(cell, 2) * reach
    hot = None
    if crowded.any():
        hot = scratch.save(vectors.mapInArrow(_free_seats(balls, boxes, crowded), "box int, label string, coords array<double>").groupBy("label").agg(F.first("coords").alias("coords")))
        near.append(_pivot_links(hot, _cells(hot, "label", width, grids, dims, seed), reach, scratch).withColumn("degree", F.lit(0).cast("bigint")))
        near.append(hot.select("label", F.col("label").alias("pivot"), F.lit(0).cast("bigint").alias("degree")))
    if not near:
        near = [vectors.select("label", F.col("label").alias("pivot"), F.lit(0).cast("bigint").alias("degree"))]
    near = reduce(DataFrame.unionByName, near)
    degrees = scratch.save(near.select("label", "degree").unionByName(near.select(F.col("pivot").alias("label"), F.lit(0).cast("bigint").alias("degree"))).groupBy("label").agg(F.sum("degree").alias("degree")))
    named = smallest_labels(near.where("label <> pivot").select("label", "pivot"), degrees, scratch)
    if hot is not None:
        named = _joined(hot, named, reach, width, dims, seed, scratch)
    linked = scratch.save(named.join(degrees, "label"))
    judged = linked.groupBy("comp").agg(F.count("*").alias("size"), (F.min("degree") == F.count("*") - 1).alias("mutual"))
    if hot is not None:
        heavy = scratch.save(named.join(hot.select("label"), "label").select("comp").distinct())
        broken = _mutual(vectors, named.join(heavy, "comp", "left_semi"), reach, dims, scratch)
        judged = judged.join(heavy.withColumn("_heavy", F.lit(True)), "comp", "left").join(broken.withColumn("_broken", F.lit(True)), "comp", "left")
        judged = judged.select("comp", "size", F.when(F.col("_heavy"), F.col("_broken").isNull()).otherwise(F.col("mutual")).alias("mutual"))
    found = join_margins(linked.select("label", "comp"), judged, "comp", "size")
    alone = vectors.select("label").join(linked.select("label"), "label", "left_anti")
    return found.select("label", "comp", "size", "mutual").unionByName(alone.select("label", F.col("label").alias("comp"), F.lit(1).cast("bigint").alias("size"), F.lit(True).alias("mutual")))


def describe_groups(groups: DataFrame, vectors: DataFrame, reach: float, dims: int, typical: int = 3, grids: int = GRIDS, cell: float = CELL, seed: int = 3) -> DataFrame:
    """(comp, size, typical): of every group its size and the members of its densest cell that are nearest to its mean."""
    scratch = Scratch(vectors.sparkSession, "described", tidy=True)
    _, placed = _stats(scratch.save(vectors.join(groups.select("label", "comp"), "label")), dims, scratch)
    sizes = groups.select("label", "size").join(placed.select("label", "comp", "r"), "label")
    cells = _cells(vectors.join(groups.select("label"), "label", "left_semi"), "label", cell * reach, grids, dims, seed).join(sizes, "label")
    density = cells.groupBy("comp", "cell").agg(F.count("*").alias("held"))
    densest = density.groupBy("comp").agg(F.max(F.struct("held", "cell")).alias("top")).select("comp", F.col("top.cell").alias("cell"))
    inside = cells.join(densest, ["comp", "cell"], "left_semi").withColumn("_rank", F.expr("row_number() over (partition by comp order by r, label)")).where(F.col("_rank") <= typical)
    return inside.groupBy("comp", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "label"))), lambda x: x["label"]).alias("typical"))
