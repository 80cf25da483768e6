"""Transformations of counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralmill.errors import InvalidTransformation, SpectralMillError, UnknownTransformation
from spectralmill.operators.skew import join_margins
from spectralmill.operators.stats import count_statistics

EPSILON = 0.1
ALIASES = {"binary": "binary", "power": "power", "pow": "power", "clr": "clr", "CLR": "clr", "pseudocounts": "pseudocounts", "pseudo": "pseudocounts"}


@dataclass(frozen=True)
class Transformation:
    """binary, power, clr or pseudocounts with a threshold (below 1: a fraction of the label's sum) and a power."""

    which: str = "power"
    threshold: float = 1.0
    power: float = 1.0

    def __post_init__(self):
        if self.which not in ALIASES:
            raise UnknownTransformation(self.which)
        object.__setattr__(self, "which", ALIASES[self.which])
        if self.which == "pseudocounts" and self.power < 0:
            raise InvalidTransformation(f"pseudocounts with power {self.power}")

    @classmethod
    def parse(cls, text: str) -> Transformation:
        """``name`` or ``name(threshold,power)``."""
        found = re.fullmatch(r"(\w+)(?:\(([^,()]+),([^,()]+)\))?", text)
        if not found:
            raise UnknownTransformation(text)
        try:
            return cls(found[1], *(float(x) for x in found.groups()[1:] if x is not None))
        except ValueError as error:
            raise error if isinstance(error, SpectralMillError) else InvalidTransformation(text) from None

    def __str__(self) -> str:
        return f"{self.which}({self.threshold:g},{self.power:g})"

    def value(self, count: Column, stats: dict[str, Column]) -> Column:
        """The transformed count, given the label's max, sum, sum_log and non_zero."""
        c, p = count.cast("double"), float(self.power)
        t = F.lit(float(self.threshold)) * stats["sum"] if self.threshold < 1 else F.lit(float(self.threshold))
        if self.which == "binary":
            return F.when(c >= t, 1.0).otherwise(0.0)
        if self.which == "power":
            return F.when(c >= t, c if p == 1.0 else F.pow(c, F.lit(p))).otherwise(0.0)
        if self.which == "clr":
            kept = F.when(c >= t, c).otherwise(0.0)
            return F.ln(F.greatest(kept, F.lit(EPSILON))) * p - F.try_divide(stats["sum_log"], stats["non_zero"].cast("double"))
        top = stats["max"].cast("double")
        if p == 0:
            v = top * F.ln((c + 1) / t)
        else:
            low = F.pow(F.greatest(t - 1, F.lit(0.0)), F.lit(p))
            above = F.pow(c, F.lit(p)) - low
            v = above * F.pow(top, F.lit(1 - p)) / p if p < 1 else F.try_divide(above, F.pow(t, F.lit(p)) - low)
        return F.greatest(F.lit(0.0), F.try_divide(F.floor(v).cast("double"), stats["sum"]))


def transform_counts(cells: DataFrame, transformation: Transformation, statistics: DataFrame | None = None) -> DataFrame:
    """(label, kmer, value) of every stored count; see ``zero_values`` for the counts that aren't stored."""
    if transformation.which in ("binary", "power") and transformation.threshold >= 1:
        return cells.select("label", "kmer", transformation.value(F.col("count"), {}).alias("value"))
    stats = statistics if statistics is not None else count_statistics(cells, "label", transformation.threshold, transformation.power)
    rows = cells.groupBy("label").agg(F.count("*").alias("_rows"))
    joined = join_margins(cells, stats.join(rows, "label"), "label", "_rows")
    return joined.select("label", "kmer", transformation.value(F.col("count"), {n: F.col(n) for n in ("max", "sum", "sum_log", "non_zero")}).alias("value"))


def zero_values(cells: DataFrame, transformation: Transformation) -> DataFrame:
    """(label, value): what a count of 0 becomes for each label. Only clr gives something other than 0 for thresholds of 1 or more."""
    stats = count_statistics(cells, "label", transformation.threshold, transformation.power)
    return stats.select("label", transformation.value(F.lit(0), {n: F.col(n) for n in ("max", "sum", "sum_log", "non_zero")}).alias("value"))
