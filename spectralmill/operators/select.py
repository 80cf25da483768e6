"""Selections of spectra: by label, by pattern, negated; deletion and export filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_labels(cells: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Every label of counts and metadata, once."""
    labels = cells.select("label")
    return (labels if metadata is None else labels.union(metadata.select("label"))).where("label is not null").distinct()


def select_labels(labels: DataFrame, names: list[str]) -> DataFrame:
    """The given labels that exist; unknown names select nothing."""
    return labels.where(F.col("label").isin(list(names))).select("label").distinct()


def translate_pattern(pattern: str) -> str:
    """A pattern in which \\( \\) \\| are the operators and ( ) | { } plain signs, in the form that Spark takes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append(nxt if nxt in "()|" else r"\b" if nxt == "b" else "\\" + nxt)
            i += 2
            continue
        if c == "[":  # a set ends at the first ] that isn't its first sign
            begin = i + 1 + (pattern[i + 1 : i + 2] == "^")
            end = pattern.find("]", begin + 1)
            end = len(pattern) - 1 if end < 0 else end
            out.append(pattern[i : end + 1].replace("\\", "\\\\").replace("&&", "&\\&").replace("[", "\\[").replace("\\[", "[", 1))
            i = end + 1
            continue
        out.append("\\" + c if c in "(){}|" else c)
        i += 1
    return "".join(out)


def select_matching(labels: DataFrame, patterns: list[tuple[str, str]], metadata: DataFrame | None = None) -> DataFrame:
    """Labels that match every (field, pattern) at the beginning; the empty field is the label itself.

    An unknown field selects nothing; a label without metadata has empty fields.
    """
    rows = labels.select("label").distinct()
    fields = set() if metadata is None else set(metadata.columns) - {"label"}
    if any(f and f not in fields for f, _ in patterns):
        return rows.where(F.lit(False))
    wanted = [f for f, _ in patterns if f]
    if wanted:
        rows = rows.join(metadata.select("label", *dict.fromkeys(wanted)), "label", "left")
    for field, pattern in patterns:
        rows = rows.where(F.coalesce(F.col(field or "label"), F.lit("")).rlike(f"\\A(?:{translate_pattern(pattern)})"))
    return rows.select("label").distinct()


def negate_selection(labels: DataFrame, selected: DataFrame) -> DataFrame:
    return labels.select("label").distinct().join(selected.select("label"), "label", "left_anti")


def keep_selected(frame: DataFrame, selected: DataFrame) -> DataFrame:
    return frame.join(selected.select("label").distinct(), "label", "left_semi")


def remove_selected(frame: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of spectra or metadata whose label isn't selected; k-mers stay known even if nothing is left of them."""
    return frame.join(selected.select("label").distinct(), "label", "left_anti")


def nonzero_kmers(cells: DataFrame, threshold: float = 1.0, power: float = 1.0) -> DataFrame:
    """K-mers whose row statistics have a positive sum; what an export keeps unless zero rows are asked for."""
    from spectralmill.operators.stats import count_statistics

    return count_statistics(cells, "kmer", threshold, power).where(F.col("sum") > 0).select("kmer")
