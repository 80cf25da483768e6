"""Mixtures with target shares by entropy balancing.

Of all rates between 0 and the caps under which every source gives its wanted tokens, those
are taken that lose the least relative entropy against using each document once. They are
exp(lambda * size), cut off at the cap, with one multiplier lambda for each source: a source
of which less is wanted than there is leans to its short documents, one of which more is
wanted to its long ones. The multipliers minimise a convex dual, whose gradient is the gap in
tokens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralmill.functions.cleaning import clean_source
from spectralmill.scratch import Scratch

TOKENIZERS = "/opt/tokenizers"
#: fixed value: the published split pattern of the byte-level rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_SOURCES = 100_000
SIZE_CLASSES = 16  # to a doubling of the size
LEAST_PARTS, ROWS_OF_PART = 64, 1 << 20  # a size class of a source is rounded in parts; at most ROWS_OF_PART rows each, whatever share of all rows it has


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            counts = np.fromiter((len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column("text"))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(counts)], names=["doc_id", "source", "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, tokens): the size of each whole text in tokens of a public vocabulary.

    The source is cleaned; null and empty texts have 0 tokens. ``tokenizers`` is a folder
    that every executor can read.
    """
    rows = documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_count_tokens(f"{tokenizers}/{vocabulary}"), f"doc_id {kind}, source string, tokens bigint")


def _targets(targets: DataFrame) -> DataFrame:
    clean = targets.select(clean_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    return clean.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def dual_sums(sizes: DataFrame, state: dict[str, float], budget: dict[str, tuple[float, float, int]]) -> dict[str, tuple[float, float]]:
    """source -> (expected tokens, their derivative by the multiplier), both in units of the source's mean size; one aggregation over ``sizes``."""
    rows = [(s, float(lam), budget[s][1], math.log(budget[s][2])) for s, lam in state.items()]
    now = F.broadcast(sizes.sparkSession.createDataFrame(rows, "source string, lambda double, mean double, top double"))
    x = F.col("tokens") / F.col("mean")
    tilt = F.col("lambda") * x
    rate = F.exp(F.least("top", tilt))
    d = F.col("documents")
    joined = sizes.join(now, "source").select("source", (d * x * rate).alias("g"), F.when(tilt < F.col("top"), d * x * x * rate).otherwise(0.0).alias("h"))
    return {r["source"]: (r["g"], r["h"]) for r in joined.groupBy("source").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}


def solve_rates(sizes: DataFrame, budget: dict[str, tuple[float, float, int]], iterations: int = 60, tolerance: float = 1e-9) -> dict[str, float]:
    """source -> multiplier, by Newton's method on the dual, all sources at once.

    ``sizes`` has source, tokens and documents (how many of this size). ``budget`` gives for
    each source its tokens wanted, its mean size and its cap. The rate of a document of t
    tokens is min(cap, exp(lambda * t / mean)). Each iteration is one aggregation over
    ``sizes``; only the sums of each source reach the driver. A step that leaves the interval
    in which the solution is known to lie is replaced by halving it.
    """
    state = dict.fromkeys(budget, 0.0)
    low, high = dict.fromkeys(budget, -math.inf), dict.fromkeys(budget, math.inf)
    open_ = set(budget)
    for _ in range(iterations):
        for s, (g, h) in dual_sums(sizes, {s: state[s] for s in open_}, budget).items():
            wanted, lam = budget[s][0] / budget[s][1], state[s]
            gap = wanted - g
            if abs(gap) <= tolerance * wanted:
                open_.discard(s)
                continue
            (low if gap > 0 else high)[s] = lam
            step = min(4.0, max(-4.0, gap / h)) if h > 0 else math.copysign(1.0, gap)
            then = lam + step
            if not low[s] < then < high[s]:
                then = (low[s] + high[s]) / 2
            state[s] = then
        if not open_:
            break
    return state


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares): how often each document is used, and what each source then contributes.

    ``targets`` has source, target_share and max_repeats; rows with nulls or without a
    positive share and cap are left out, of repeated sources the greatest share and smallest
    cap stand. Sources of targets without tokens can't contribute; the shares of the others
    are scaled to 1. Without ``total_tokens`` the mixture is as large as the caps let it be with
    all shares met. With it, a source that can't fill its part is used up to its cap.

    copies: doc_id, source, tokens, rate, copies, one row for each document of a target
    source with at least one token; the rate is the tilted expected number of copies, rounded
    by systematic sampling in order of size, so that the sums of a source hardly differ from
    the expected ones. shares: source, target_share, max_repeats,
    documents, tokens_available, tokens, actual_share, one row for each target.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    want = _targets(targets)
    if want.agg(F.count("*")).first()[0] > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    counted = scratch.save(sizes if sizes is not None else token_counts(documents)).where("tokens > 0")
    mine = counted.join(F.broadcast(want.select("source")), "source", "left_semi")
    histogram = scratch.save(mine.groupBy("source", "tokens").agg(F.count("*").alias("documents")))
    at_hand = histogram.groupBy("source").agg(F.sum("documents").alias("documents"), F.sum(F.col("tokens") * F.col("documents")).alias("tokens"))
    have = {r["source"]: r for r in want.join(at_hand, "source", "left").collect()}
    usable = {s: r for s, r in have.items() if r["tokens"]}
    scale = sum(r["target_share"] for r in usable.values())
    if total_tokens is None and usable:
        total_tokens = min(r["tokens"] * r["max_repeats"] * scale / r["target_share"] for r in usable.values())
    budget, full = {}, {}
    for s, r in usable.items():
        wanted = total_tokens * r["target_share"] / scale
        if wanted >= r["tokens"] * r["max_repeats"] * (1 - 1e-9):
            full[s] = r["max_repeats"]
        else:
            budget[s] = (wanted, r["tokens"] / r["documents"], r["max_repeats"])
    solved = solve_rates(histogram, budget) if budget else {}
    rows = [(s, lam, budget[s][1], budget[s][2], False) for s, lam in solved.items()] + [(s, 0.0, 1.0, m, True) for s, m in full.items()]
    of_source = F.broadcast(spark.createDataFrame(rows, "source string, lambda double, mean double, cap int, used_up boolean"))
    cap = F.col("cap").cast("double")
    rate = F.when(F.col("used_up"), cap).otherwise(F.least(cap, F.exp(F.least(F.ln(cap), F.col("lambda") * F.col("tokens") / F.col("mean")))))
    parts = max(LEAST_PARTS, -(-sum(r["documents"] for r in usable.values()) // ROWS_OF_PART))
    rated = mine.join(of_source, "source").select("doc_id", "source", "tokens", rate.alias("rate"))
    rated = rated.withColumns({"_class": F.floor(F.log2("tokens") * SIZE_CLASSES), "_hash": F.xxhash64(F.lit(seed), F.col("doc_id"))}).withColumn("_sub", F.pmod("_hash", F.lit(parts)))
    keys = ["source", "_class", "_sub"]
    before = rated.groupBy(*keys).agg(F.sum("rate").alias("_sum"))
    before = before.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_class", "_sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("_sum")
    upto = F.sum("rate").over(W.partitionBy(*keys).orderBy("_hash", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    placed = rated.withColumn("_upto", upto).join(before, keys)
    upper = F.col("_before") + F.col("_upto") + 0.5
    copies = scratch.save(placed.select("doc_id", "source", "tokens", F.round("rate", 6).alias("rate"), F.least(F.ceil("rate"), F.floor(upper) - F.floor(upper - F.col("rate"))).cast("int").alias("copies")))
    used = copies.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    whole = used.agg(F.sum("tokens")).scalar()
    shares = (
        want.join(at_hand.select("source", "documents", F.col("tokens").alias("tokens_available")), "source", "left")
        .join(used, "source", "left")
        .fillna(0, ["documents", "tokens_available", "copies", "tokens"])
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), whole), F.lit(0.0)))
    )
    return copies, shares
