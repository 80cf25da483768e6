"""Distances, norms and metrics as column expressions over arrays of doubles."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectralmill.errors import InvalidThreshold, NegativePower, UnknownDistance, UnknownMetric


def squared_distance(a: Column, b: Column, dims: int) -> Column:
    """Sum of squared differences of the first ``dims`` entries, unrolled so that it is compiled with its stage."""
    return reduce(lambda x, y: x + y, ((a[i] - b[i]) * (a[i] - b[i]) for i in range(dims)), F.lit(0.0))


def array_literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


@dataclass(frozen=True)
class Distance:
    """Euclidean, cosine (half the squared Euclidean form) or Minkowski distance under a metric."""

    kind: str = "euclidean"
    power: float = 2.0

    @classmethod
    def parse(cls, text: str) -> Distance:
        if text in ("euclidean", "cosine"):
            return cls(text)
        if found := re.fullmatch(r"minkowski\(([^)]+)\)", text):
            try:
                power = float(found[1])
            except ValueError:
                raise UnknownDistance(text) from None
            if power < 0:
                raise NegativePower(power)
            return cls("minkowski", power)
        raise UnknownDistance(text)

    def __str__(self) -> str:
        return self.kind if self.kind != "minkowski" else f"minkowski({self.power:g})"

    @property
    def exponent(self) -> float:
        return self.power if self.kind == "minkowski" else 2.0

    def component(self, difference: Column, weight: Column) -> Column:
        if self.exponent == 2.0:
            return difference * difference * weight
        if self.exponent == 1.0:
            return F.abs(difference) * weight
        return F.pow(F.abs(difference), F.lit(self.exponent)) * weight

    def scale(self, total: Column) -> Column:
        if self.kind == "cosine":
            return total / 2
        if self.exponent == 1.0:
            return total
        return F.sqrt(total) if self.exponent == 2.0 else F.pow(total, F.lit(1.0 / self.exponent))

    def between(self, a: Column, b: Column, metric: list[float]) -> Column:
        """Distance of two arrays under a metric (one weight for each dimension)."""
        terms = (self.component(a[i] - b[i], F.lit(float(w))) for i, w in enumerate(metric))
        return self.scale(reduce(lambda x, y: x + y, terms, F.lit(0.0)))

    def norm(self, a: Column, metric: list[float]) -> Column:
        terms = (self.component(a[i], F.lit(float(w))) for i, w in enumerate(metric))
        return self.scale(reduce(lambda x, y: x + y, terms, F.lit(0.0)))


@dataclass(frozen=True)
class Metric:
    """Weights of dimensions: flat, or powers of their inertia."""

    kind: str = "powers"
    inner: float = 1.0
    threshold: float = 1.0
    outer: float = 2.0

    @classmethod
    def parse(cls, text: str) -> Metric:
        if text == "flat":
            return cls("flat")
        if found := re.fullmatch(r"powers\(([^,()]+),([^,()]+),([^,()]+)\)", text):
            try:
                inner, threshold, outer = (float(x) for x in found.groups())
            except ValueError:
                raise UnknownMetric(text) from None
            if inner < 0 or outer < 0:
                raise NegativePower(min(inner, outer))
            if not 0 <= threshold <= 1:
                raise InvalidThreshold(threshold)
            return cls("powers", inner, threshold, outer)
        raise UnknownMetric(text)

    def __str__(self) -> str:
        return "flat" if self.kind == "flat" else f"powers({self.inner:g},{self.threshold:g},{self.outer:g})"

    def weights(self, inertia: list[float]) -> list[float]:
        """Weights that sum to 1; inner power, then entries beyond the accumulated threshold become 0, then outer power."""
        n = len(inertia)
        if self.kind == "flat":
            return [1.0 / n] * n if n else []
        raised = [abs(v) ** self.inner for v in inertia]
        total, before = sum(raised), 0.0
        kept = [0.0] * n
        for i in sorted(range(n), key=lambda i: (-raised[i], i)):
            if before < self.threshold * total:
                kept[i] = raised[i] ** self.outer
            before += raised[i]
        whole = sum(kept)
        return [k / whole for k in kept] if whole else kept
