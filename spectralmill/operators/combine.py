"""Combination of spectra: of a selection, or of every class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralmill.errors import ClassesLabelNotFound, ClassLabelIsAlsoSpectrumName, EmptySelection, UnknownCombinationCriterion
from spectralmill.operators.order import place_rows
from spectralmill.operators.skew import join_margins


def combine_by_group(cells: DataFrame, groups: DataFrame, criterion: str = "mean") -> DataFrame:
    """(label, kmer, count): one combined spectrum for each group, named by it.

    ``groups`` has label and group. Each spectrum is rescaled to the greatest sum of its
    group. mean adds the rescaled counts up; median takes the upper median over the group's
    spectra with a positive sum, zeros included, times the number of its spectra. Results
    are truncated to whole numbers (BIGINT, so that large classes don't overflow), and those
    that become 0 aren't stored. Before
    truncation the value is rounded to 6 decimals, so that the order of summation can't
    tip a whole number over. Labels without group are left out.
    """
    if criterion not in ("mean", "median"):
        raise UnknownCombinationCriterion(criterion)
    norms = cells.groupBy("label").agg(F.sum("count").alias("norm"), F.count("*").alias("_rows"))
    grouped = groups.where("`group` is not null").select("label", "group").distinct()
    of_group = grouped.join(norms, "label", "left").groupBy("group").agg(F.max(F.coalesce("norm", F.lit(0))).alias("top"), F.count("*").alias("found"), F.count_if(F.col("norm") > 0).alias("usable"))
    margins = norms.join(grouped, "label").join(of_group, "group")
    rescaled = F.col("count").cast("double") * F.col("top") / F.col("norm")
    scaled = join_margins(cells, margins, "label", "_rows").select(F.col("group").alias("label"), "kmer", rescaled.alias("v"), "found", "usable")
    if criterion == "mean":
        combined = scaled.groupBy("label", "kmer").agg(F.sum("v").alias("v"))
    else:
        # counted from above, zeros come last: a place beyond the stored values is a zero
        ranked = scaled.withColumn("_place", F.row_number().over(W.partitionBy("label", "kmer").orderBy(F.desc("v"))))
        combined = ranked.where(F.col("_place") == F.col("usable") - F.floor(F.col("usable") / 2)).select("label", "kmer", (F.col("v") * F.col("found")).alias("v"))
    return combined.select("label", "kmer", F.round("v", 6).cast("long").alias("count")).where("count > 0")


def combine_selected(cells: DataFrame, selected: DataFrame, label: str, criterion: str = "mean") -> DataFrame:
    """``cells`` with a combined spectrum of the selection added, or put in place of one of that label."""
    if selected.isEmpty():
        raise EmptySelection(label)
    combined = combine_by_group(cells, selected.select("label", F.lit(label).alias("group")), criterion)
    return cells.where(F.col("label") != label).unionByName(combined)


def combine_metadata(metadata: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, field...): for each group and field the value that all its labels share, else empty. Labels without metadata count as empty."""
    fields = [c for c in metadata.columns if c != "label"]
    rows = groups.where("`group` is not null").select("label", "group").distinct().join(metadata, "label", "left")
    shared = [F.when(F.min(F.coalesce(f, F.lit(""))) == F.max(F.coalesce(f, F.lit(""))), F.min(F.coalesce(f, F.lit("")))).otherwise("").alias(f) for f in fields]
    return rows.groupBy(F.col("group").alias("_g")).agg(*shared).withColumnRenamed("_g", "label") if shared else rows.select(F.col("group").alias("label")).distinct()


def class_groups(metadata: DataFrame, field: str) -> DataFrame:
    if field not in metadata.columns or field == "label":
        raise ClassesLabelNotFound(field)
    return metadata.select("label", F.col(field).alias("group"))


def combine_classes(cells: DataFrame, metadata: DataFrame, field: str, criterion: str = "mean") -> tuple[DataFrame, DataFrame]:
    """Spectra and metadata with one label for each value of ``field``; the originals are gone."""
    groups = class_groups(metadata, field).where("`group` <> ''")
    clash = groups.select(F.col("group").alias("label")).join(cells.select("label").union(metadata.select("label")), "label", "left_semi")
    if not clash.isEmpty():
        raise ClassLabelIsAlsoSpectrumName(clash.first()[0])
    return combine_by_group(cells, groups, criterion), combine_metadata(metadata, groups)


def class_indicator(metadata: DataFrame, field: str) -> DataFrame:
    """(label, indicator): number of the label's class, in the order of the classes' smallest labels."""
    groups = class_groups(metadata, field)
    first = groups.groupBy("group").agg(F.min("label").alias("first"))
    ranked = place_rows(first, [], ["first", "group"], "_at").withColumn("indicator", F.col("_at") - 1)
    return groups.join(ranked, groups["group"].eqNullSafe(ranked["group"])).select("label", F.col("indicator").cast("int").alias("indicator"))
