"""Greedy search of a neighbour graph: the nearest vectors of given query vectors.

Every query starts from vectors of the leaves it is routed to, and keeps a beam of the
nearest found so far. Each round follows the links of the beam's vectors that weren't
followed yet, for all queries at once by joins, until no beam has any left.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.functions.space import squared_distance
from spectralmill.llm.neighbours import fit_forest, route
from spectralmill.scratch import Scratch

ENTRIES = 64  # vectors of a leaf that a query starts from


def search_graph(nodes: DataFrame, graph: DataFrame, queries: DataFrame, dims: int, k: int = 5, beam: int = 16, trees: int = 4, rounds: int = 12, seed: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """(query, id, d): about the ``k`` nearest nodes of every query.

    ``nodes`` has id and coords, ``graph`` id, nbr and d (see ``neighbour_graph``; links of
    any length help), ``queries`` query (unique BIGINT) and coords. Distances are exact,
    which vectors are found is approximate. Ends after ``rounds`` rounds at the latest.
    Empty inputs give an empty result.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "search")
    nodes, asked = nodes.select("id", "coords"), queries.select("query", "coords")
    count = nodes.count()
    if count == 0:
        return nodes.sparkSession.createDataFrame([], "query bigint, id bigint, d double")
    forest = fit_forest(nodes, trees, ENTRIES, seed, count)
    seats = route(nodes, forest, trees).select("tree", "leaf", "id").withColumn("_n", F.expr(f"row_number() over (partition by tree, leaf order by xxhash64({seed}, id))")).where(F.col("_n") <= ENTRIES)
    starts = route(asked.withColumnRenamed("query", "id"), forest, trees).select("tree", "leaf", F.col("id").alias("query"))
    found = starts.join(seats, ["tree", "leaf"]).select("query", "id").distinct()

    def measured(pairs: DataFrame) -> DataFrame:
        both = pairs.join(nodes.withColumnRenamed("coords", "_a"), "id").join(asked.withColumnRenamed("coords", "_b"), "query")
        return both.select("query", "id", F.sqrt(squared_distance(F.col("_a"), F.col("_b"), dims)).alias("d"))

    def nearest(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("query", "id").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        kept = once.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "done"))), 1, beam).alias("b"))
        return kept.select("query", F.explode("b").alias("b")).select("query", "b.id", "b.d", "b.done")

    # a query has at most trees * ENTRIES starts, then beam * links candidates a round
    state = scratch.save(nearest(measured(found).withColumn("done", F.lit(False))))
    for _ in range(rounds):
        ahead = state.where("not done")
        if ahead.isEmpty():
            break
        links = ahead.select("query", "id").join(graph.select("id", "nbr"), "id").select("query", F.col("nbr").alias("id")).distinct()
        new = measured(links.join(state.select("query", "id"), ["query", "id"], "left_anti")).withColumn("done", F.lit(False))
        then = scratch.save(nearest(state.withColumn("done", F.lit(True)).unionByName(new)))
        scratch.drop(state)
        state = then
    top = F.expr("row_number() over (partition by query order by d, id)")
    return state.withColumn("_n", top).where(F.col("_n") <= k).select("query", "id", "d")


def search_labels(vectors: DataFrame, graph: DataFrame, nodes: DataFrame, dims: int, k: int = 5, reach: float = math.inf, digits: int = 6, **options) -> DataFrame:
    """(label, neighbour, rank, distance): the ``k`` nearest labels of every query vector (label, coords), itself left out.

    ``nodes`` has id, coords and heads, its smallest labels (see ``group_copies``).
    """
    scratch = Scratch(vectors.sparkSession, "search")
    asked = scratch.save(vectors.select(F.monotonically_increasing_id().alias("query"), "label", "coords"))
    found = search_graph(nodes, graph, asked, dims, k + 1, scratch=scratch, **options)
    named = found.join(nodes.select("id", F.explode("heads").alias("neighbour")), "id").join(asked.select("query", "label"), "query").where("label <> neighbour")
    near = named.withColumn("distance", F.round("d", digits)).where(F.col("distance") <= reach)
    ranked = near.withColumn("rank", F.expr("row_number() over (partition by query order by distance, neighbour)").cast("int"))
    return ranked.where(F.col("rank") <= k).select("label", "neighbour", "rank", "distance")
