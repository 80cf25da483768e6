"""Queries of the training-data problems over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralmill.llm.clusters import describe_groups, similar_groups
from spectralmill.llm.distinctive import distinctive_terms
from spectralmill.llm.graph_search import search_labels
from spectralmill.llm.leaks import find_leaks
from spectralmill.llm.mixing import mix_sources
from spectralmill.llm.neighbours import group_copies, nearest_labels, neighbour_graph
from spectralmill.llm.term_counts import mark_terms, ngram_counts, suffixes_of
from spectralmill.llm.truncation import find_truncated, truncation_by_source
from spectralmill.operators.counts import accumulate_spectra
from spectralmill.operators.vectors import latest_vectors
from spectralmill.scratch import Scratch

NEIGHBOURS, REACH = 5, 1.5


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scratch(spark, "cells").save(accumulate_spectra(_read(spark, sf_dir, "spectra")))


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-mer of every label with its residual."""
    scored = distinctive_terms(_cells(spark, sf_dir), "label", "kmer", "count")
    return scored.select(F.col("record").alias("label"), F.col("term").alias("kmer"), F.col("weight").alias("count"), F.round("residual", 6).alias("residual"), F.round("adjusted_residual", 6).alias("adjusted_residual"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers whose residual is at least that of one with 4 % of its label; the share itself is checked exactly afterwards."""
    scored = distinctive_terms(_cells(spark, sf_dir), "label", "kmer", "count")
    # the residual of a share of 4 %, less a little for rounding, so that the exact check decides
    least = (F.col("record_total") / 25 - F.col("expected")) / F.sqrt("expected")
    distinctive = scored.where(F.col("residual") >= least - 1e-9 * (F.abs(least) + F.sqrt("expected") + 1))
    return distinctive.where("weight * 25 >= record_total and holders >= 2 and holders * 50 <= records").select(F.col("record").alias("label"), F.col("term").alias("kmer"))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = Scratch(spark, "vectors").save(latest_vectors(_read(spark, sf_dir, "twisted")))
    return nearest_labels(vectors, NEIGHBOURS, REACH)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _nearest(spark, sf_dir)
    return near.select(F.least("label", "neighbour").alias("label_a"), F.greatest("label", "neighbour").alias("label_b")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest labels of every label, with their distances."""
    return _nearest(spark, sf_dir)


def p2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest labels of every label whose number is divisible by 50, by greedy search of the graph of all."""
    scratch = Scratch(spark, "search")
    vectors = scratch.save(latest_vectors(_read(spark, sf_dir, "twisted")))
    nodes, _ = group_copies(vectors, heads=NEIGHBOURS + 1, scratch=scratch)
    graph = scratch.save(neighbour_graph(nodes, k=2 * NEIGHBOURS, scratch=scratch))
    asked = vectors.where(F.regexp_extract("label", "([0-9]+)$", 1).try_cast("bigint") % 50 == 0)
    return search_labels(asked, graph, nodes, 32, NEIGHBOURS, REACH)


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "clusters", tidy=True)
    vectors = scratch.save(latest_vectors(_read(spark, sf_dir, "twisted")))
    return similar_groups(vectors, REACH, 32, scratch=scratch).where("mutual and size >= 5"), vectors


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)[0].select(F.col("comp").alias("cluster_label"), "label")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical labels of every group."""
    groups, vectors = _clusters(spark, sf_dir)
    return describe_groups(groups, vectors, REACH, 32).withColumnRenamed("comp", "cluster_label")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    counts = ngram_counts(cells.select(F.col("label").alias("record"), F.array("kmer").alias("suffix"), F.col("count").alias("weight")))
    labels = cells.select(F.countDistinct("label")).first()[0]
    return mark_terms(counts, labels).select(F.col("ngram")[0].alias("kmer"), F.col("records").alias("non_zero"), F.col("count").alias("sum"), "mark")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("mark <> 'useful'").select("kmer", "mark")


def p5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of one to three words of the documents, with its count and the number of documents that have it."""
    words = F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), 1), F.lower)
    counts = ngram_counts(suffixes_of(_read(spark, sf_dir, "documents").select("doc_id", words.alias("words")), "doc_id", "words", 3), 3)
    return counts.select(F.array_join("ngram", " ").alias("ngram"), F.size("ngram").alias("words"), "count", "records")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mixture, with its rate and copies."""
    return mix_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))[0].where("copies > 0")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mix_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))[1]
    return shares.withColumn("actual_share", F.round("actual_share", 6))


def p7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of p7_shares: the sources, their documents with text, and whether share and caps are met."""
    copies, shares = mix_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))
    most = copies.groupBy("source").agg(F.max("copies").alias("most"))
    wanted = F.when(F.col("documents") > 0, F.col("target_share")).otherwise(0.0) / shares.where("documents > 0").agg(F.sum("target_share")).scalar()
    return shares.join(most, "source", "left").select(
        "source", "target_share", "max_repeats", "documents", F.round(wanted, 6).alias("wanted_share"),
        (F.abs(F.col("actual_share") - wanted) <= 0.005).alias("share_met"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_met"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_truncated(_read(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_by_source(find_truncated(_read(spark, sf_dir, "documents"))).withColumn("share", F.round("share", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_scores": p1_scores,
        "p2_found": p2_found,
        "p2_neighbours": p2_neighbours,
        "p2_search": p2_search,
        "p3_found": p3_found,
        "p3_groups": p3_groups,
        "p5_found": p5_found,
        "p5_terms": p5_terms,
        "p5_ngrams": p5_ngrams,
        "p6_found": p6_found,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p7_sources": p7_sources,
        "p8_found": p8_found,
        "p8_sources": p8_sources,
    }
