"""Most similar vectors of every vector: NN-descent on Spark.

A forest of random hyperplanes, fitted on a bounded sample, gives every vector its first
neighbours: all vectors are routed, and those of one leaf are compared with each other.
NN-descent then improves the graph: every vector is sent along its links in both
directions, those that meet at a vector are neighbours of neighbours, and each pair of them
that is closer than what either holds becomes a link. It ends when hardly a link is new.

Links carry exact distances in double precision; only which links are found is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.operators.skew import join_margins
from spectralmill.scratch import Scratch

SAMPLE = 65_536  # vectors that the forest is fitted on, at most
DEEPEST = 14  # levels of a tree: at most 2 ** 14 leaves, whatever the number of vectors
LEAF = 2_048
MEETING = 64  # vectors of one meeting that are compared at once
LINKS = "id bigint, nbr bigint, d double"
_LINKS = pa.schema([("id", pa.int64()), ("nbr", pa.int64()), ("d", pa.float64())])


class Forest:
    """Trees of random hyperplanes at medians of a sample."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.depth = depth
        self.normal = rng.standard_normal((trees, (1 << depth) - 1, dims))
        self.offset = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for level in range(depth):
                side = np.einsum("ij,ij->i", sample, self.normal[t, at])
                order = np.lexsort((side, at))
                nodes, first, size = np.unique(at[order], return_index=True, return_counts=True)
                ranked = side[order]
                self.offset[t, nodes] = (ranked[first + size // 2] + ranked[first + np.maximum(size // 2 - 1, 0)]) / 2
                at = 2 * at + 1 + (side > self.offset[t, at])

    def leaves(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", vectors, self.normal[tree, at]) > self.offset[tree, at])
        return at - ((1 << self.depth) - 1)


def matrix_of(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def list_of(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(matrix).ravel()))


def fit_forest(nodes: DataFrame, trees: int, leaf: int, seed: int, count: int) -> Forest:
    depth = max(0, min(DEEPEST, math.ceil(math.log2(max(1, count) / leaf))))
    share = min(1.0, SAMPLE / max(1, count))
    part = nodes.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE)
    rows = part.select("coords").toArrow().column("coords")
    sample = np.concatenate([matrix_of(c) for c in rows.chunks if len(c)]) if count else np.zeros((0, 1))
    return Forest(sample, trees, depth, seed)


def route(nodes: DataFrame, forest: Forest, trees: int) -> DataFrame:
    """(tree, leaf, id, coords): every vector once for each tree."""
    shared = nodes.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix_of(batch.column("coords"))
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vectors), t, np.int32)), pa.array(shared.value.leaves(vectors, t).astype(np.int32)), batch.column("id"), batch.column("coords")], names=["tree", "leaf", "id", "coords"])

    return nodes.select("id", "coords").mapInArrow(run, "tree int, leaf int, id bigint, coords array<double>")


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of each row to its k nearest rows within reach, by exhaustive comparison."""
    square = np.einsum("ij,ij->i", x, x)
    slack = 1e-9 * (1 + float(square.max()))
    for begin in range(0, len(x), 512):
        end = min(begin + 512, len(x))
        d2 = square[begin:end, None] + square[None] - 2 * (x[begin:end] @ x.T)
        d2[np.arange(end - begin), np.arange(begin, end)] = np.inf
        near = d2 <= reach * reach + slack
        held = near.sum(1)
        few = held <= k
        row, col = np.nonzero(near & few[:, None])
        many = np.flatnonzero(~few)
        if len(many):
            best = np.argpartition(d2[many], k - 1, axis=1)[:, :k]
            row, col = np.concatenate((row, np.repeat(many, k))), np.concatenate((col, best.ravel()))
        exact = np.sqrt(((x[begin + row] - x[col]) ** 2).sum(1))
        yield ids[begin + row], ids[col], exact


def _halves(x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    open_ = [rows]
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf:
            yield rows
        else:
            order = np.argsort(x[rows] @ rng.standard_normal(x.shape[1]), kind="stable")
            open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows equal in ``keys``, which the input is sorted by."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for begin, end in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
            now = tuple(key[:, begin])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a run of rows equal in ``keys`` ends; input sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            same &= values == values[last]
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if held and (cut or any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)):
            if any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _compare_leaves(k: int, leaf: int, reach: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        for table in _groups(batches, ["tree", "leaf"]):
            group = table.combine_chunks().to_batches()[0]
            ids, x = group.column("id").to_numpy(), matrix_of(group.column("coords"))
            for rows in _halves(x, np.arange(len(x)), 2 * leaf, rng):
                for links in _nearest(ids[rows], x[rows], k, reach):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in links], schema=_LINKS)

    return run


def _meet(reach: float):
    """Compare the vectors that meet at one vector; input sorted by (at, part)."""

    def pairs(ids: np.ndarray, x: np.ndarray, kth: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        # ids: meetings x members, all of one size
        square = np.einsum("gij,gij->gi", x, x)
        d2 = square[:, :, None] + square[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        i, j = np.triu_indices(ids.shape[1], 1)
        flat = d2[:, i, j]
        slack = 1e-9 * (1 + float(square.max()))
        bound = np.minimum(np.maximum(kth[:, i], kth[:, j]), reach)
        g, p = np.nonzero((flat <= bound * bound + slack) & (fresh[:, i] | fresh[:, j]) & (ids[:, i] != ids[:, j]))
        a, b = i[p], j[p]
        exact = np.sqrt(((x[g, a] - x[g, b]) ** 2).sum(1))
        ida, idb = ids[g, a], ids[g, b]
        one, two = exact < kth[g, a], exact < kth[g, b]
        return np.concatenate((ida[one], idb[two])), np.concatenate((idb[one], ida[two])), np.concatenate((exact[one], exact[two]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.RecordBatch | None = None

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "part"))
            ids, kth, fresh = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "kth", "fresh"))
            x = matrix_of(batch.column("coords"))
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])))
            sizes = np.diff(np.append(starts, len(at)))
            own = batch.column("own").to_numpy(zero_copy_only=False)
            sets: dict[int, list[np.ndarray]] = {}
            for size in np.unique(sizes):
                rows = starts[sizes == size][:, None] + np.arange(size)
                if size <= MEETING:
                    sets.setdefault(int(size), []).append(rows)
                    continue
                for row in rows:  # the vector's own neighbours meet all others, block by block
                    mine, others = row[own[row]], row[~own[row]]
                    step = max(1, MEETING - len(mine))
                    for begin in range(0, max(1, len(others)), step):
                        block = np.concatenate((mine, others[begin : begin + step]))
                        sets.setdefault(len(block), []).append(block[None])
            out: list[tuple[np.ndarray, ...]] = []
            for size, blocks in sets.items():
                if size < 2:
                    continue
                rows = np.concatenate(blocks)
                step = max(1, (1 << 19) // (size * size))
                for begin in range(0, len(rows), step):
                    r = rows[begin : begin + step]
                    out.append(pairs(ids[r], x[r], kth[r], fresh[r]))
            if out:
                one, two, d = (np.concatenate(c) for c in zip(*out))
                order = np.lexsort((two, one))
                keep = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))[: len(one)]
                order = order[keep]
                yield pa.RecordBatch.from_arrays([pa.array(one[order]), pa.array(two[order]), pa.array(d[order])], schema=_LINKS)

        for batch in batches:
            if carried is not None:
                batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            at = batch.column("at").to_numpy(zero_copy_only=False)
            part = batch.column("part").to_numpy(zero_copy_only=False)
            same = (at == at[-1]) & (part == part[-1]) if len(at) else np.zeros(0, bool)
            cut = int(np.argmax(same)) if same.any() else 0
            if len(at) - cut > 1 << 15:  # one meeting longer than a batch: work it off
                cut = len(at)
            if cut:
                yield from work(batch.slice(0, cut))
            carried = batch.slice(cut)
        if carried is not None and carried.num_rows:
            yield from work(carried)

    return run


def _best(links: DataFrame, k: int) -> DataFrame:
    """(id, nbr, d, fresh) to lists: id, links = the k nearest, each link once; a link that was known isn't fresh."""
    once = links.repartition("id").groupBy("id", "nbr").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return once.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "nbr", "fresh"))), 1, k).alias("links"))


def neighbour_graph(nodes: DataFrame, k: int = 10, reach: float = math.inf, trees: int = 4, leaf: int = LEAF, rounds: int = 6, least_new: float = 0.002, seed: int = 11, scratch: Scratch | None = None) -> DataFrame:
    """(id, nbr, d): for each id about its ``k`` nearest others, at most ``reach`` away.

    ``nodes`` has id (unique BIGINT) and coords (arrays of one length, no nulls), best without
    equal vectors; see ``group_copies``. Vectors further than ``reach`` apart are never
    linked or followed. Ends after ``rounds`` rounds, or when fewer than ``least_new`` of all
    links were new in a round. An empty table, or a single vector, gives an empty graph.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "neighbours")
    nodes = nodes.select("id", "coords")
    count = nodes.count()
    if count < 2:
        return nodes.sparkSession.createDataFrame([], LINKS)
    forest = fit_forest(nodes, trees, leaf, seed, count)
    routed = route(nodes, forest, trees).repartition("tree", "leaf").sortWithinPartitions("tree", "leaf")
    first = routed.mapInArrow(_compare_leaves(k, leaf, reach, seed), LINKS)
    lists = scratch.save(_best(first.withColumn("fresh", F.lit(True)), k))
    for _ in range(rounds):
        links = lists.select("id", F.explode("links").alias("l")).select("id", F.col("l.nbr").alias("nbr"), F.col("l.d").alias("d"), F.col("l.fresh").alias("fresh"))
        new, total = links.agg(F.count_if("fresh"), F.count("*")).first()
        if new <= least_new * total:
            break
        # who meets whom: at every vector its own neighbours, and all that have it as a neighbour
        both = links.select(F.col("id").alias("at"), F.col("nbr").alias("id"), "fresh", F.lit(True).alias("own")).unionByName(links.select(F.col("nbr").alias("at"), "id", "fresh", F.lit(False).alias("own")))
        meeting = both.groupBy("at", "id").agg(F.max("fresh").alias("fresh"), F.max("own").alias("own"))
        busy = meeting.groupBy("at").agg(F.count_if(~F.col("own")).alias("guests"), F.max("fresh").alias("any"), F.count("*").alias("all"))
        busy = busy.where("any").select("at", "all", F.ceil(F.greatest(F.lit(1), F.col("guests")) / 1024).cast("int").alias("parts"))
        placed = join_margins(meeting, busy, "at", "all")
        # a vector that many others have as a neighbour holds its meeting in parts, each with all its own neighbours
        part = F.when(F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
        placed = placed.select("at", F.explode(part).alias("part"), "id", "fresh", "own")
        bound = lists.select("id", F.when(F.size("links") >= k, F.element_at("links", -1)["d"]).otherwise(F.lit(math.inf)).alias("kth"))
        known = nodes.join(bound, "id")
        sent = placed.join(known, "id").repartition("at", "part").sortWithinPartitions("at", "part")
        found = sent.select("at", "part", "id", "kth", "fresh", "own", "coords").mapInArrow(_meet(reach), LINKS)
        better = scratch.save(_best(links.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), k))
        scratch.drop(lists)
        lists = better
    return lists.select("id", F.explode("links").alias("l")).select("id", F.col("l.nbr").alias("nbr"), F.col("l.d").alias("d"))


def group_copies(vectors: DataFrame, label: str = "label", coords: str = "coords", heads: int = 6, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): one node for all labels with equal coords.

    nodes: id, coords, copies, heads (its smallest labels, at most ``heads``). members: label,
    id, copies. Rows with a null label or null coords are left out.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "copies")
    rows = vectors.select(F.col(label).alias("label"), F.col(coords).alias("coords")).where("label is not null and coords is not null")
    # equal coords share a key; the sample of labels is cut in each task before the shuffle and again after it
    counted = rows.groupBy("coords").agg(F.count("*").alias("copies"), F.min("label").alias("_first"))
    rank = F.expr("row_number() over (partition by coords order by label)")
    top = rows.withColumn("_rank", rank).where(F.col("_rank") <= heads).groupBy("coords").agg(F.array_sort(F.collect_list("label")).alias("heads"))
    nodes = scratch.save(counted.join(top, "coords").select(F.monotonically_increasing_id().alias("id"), "coords", "copies", "heads"))
    members = join_margins(rows, nodes.select("coords", "id", "copies"), "coords", "copies").select("label", "id", "copies")
    return nodes, members


def nearest_labels(vectors: DataFrame, k: int = 5, reach: float = math.inf, digits: int = 6, links: int = 10, **options) -> DataFrame:
    """(label, neighbour, rank, distance): the ``k`` nearest labels of every label.

    ``vectors`` has label (unique) and coords. Distances are Euclidean, rounded to ``digits``
    decimals; ties go to the smaller label; labels more than ``reach`` away don't count.
    Labels with equal coords are one vector in the graph and get each other at distance 0.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    nodes, members = group_copies(vectors, heads=k + 1, scratch=scratch)
    graph = neighbour_graph(nodes, k=max(links, 2 * k), reach=reach, scratch=scratch, **options)
    others = graph.join(nodes.select(F.col("id").alias("nbr"), "heads"), "nbr").select("id", F.round("d", digits).alias("distance"), F.explode("heads").alias("neighbour"))
    own = nodes.where("copies > 1").select("id", F.lit(0.0).alias("distance"), F.explode("heads").alias("neighbour"))
    near = others.where(F.col("distance") <= reach).unionByName(own).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k + 1).alias("near"))
    near = scratch.save(near.join(nodes.select("id", "copies"), "id"))
    mine = join_margins(members.select("label", "id"), near, "id", "copies")
    kept = F.slice(F.filter("near", lambda n: n["neighbour"] != F.col("label")), 1, k)
    return mine.select("label", F.posexplode(kept).alias("rank", "n")).select("label", F.col("n.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("n.distance").alias("distance"))
