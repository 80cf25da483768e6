"""Norms, normalisation and embeddings of vectors under a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.errors import IncompatibleGeometries
from spectralmill.functions.space import Distance, Metric, array_literal


def metric_vector(inertia: DataFrame, metric: Metric = Metric()) -> list[float]:
    """Weights of the dimensions from a twister's inertia (dim, name, value), in order of dim."""
    return metric.weights([r["value"] for r in inertia.orderBy("dim").select("value").collect()])


def metric_table(inertia: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """(dim, name, weight); the weights are computed by windows over the few rows of the inertia."""
    if metric.kind == "flat":
        return inertia.select("dim", "name", (F.lit(1.0) / inertia.agg(F.count("*")).scalar()).alias("weight"))
    raised = inertia.select("dim", "name", F.pow(F.abs("value"), F.lit(metric.inner)).alias("_r"))
    before = F.coalesce(F.expr("sum(_r) over (order by _r desc, dim rows between unbounded preceding and 1 preceding)"), F.lit(0.0))
    kept = raised.withColumn("_k", F.when(before < F.lit(metric.threshold) * raised.agg(F.sum("_r")).scalar(), F.pow("_r", F.lit(metric.outer))).otherwise(0.0))
    return kept.withColumn("weight", F.try_divide("_k", F.expr("sum(_k) over ()"))).select("dim", "name", "weight")


def check_dims(vectors: DataFrame, dims: int) -> None:
    if not vectors.where(F.size("coords") != dims).isEmpty():
        raise IncompatibleGeometries(f"expected vectors of {dims} dimensions")


def norms(vectors: DataFrame, metric: list[float], distance: Distance = Distance()) -> DataFrame:
    """(label, norm) under the metric; a norm of 0 is given as 1, so that it can divide."""
    norm = distance.norm(F.col("coords"), metric)
    return vectors.select("label", F.when(norm == 0, 1.0).otherwise(norm).alias("norm"))


def embed(vectors: DataFrame, metric: list[float], distance: Distance = Distance(), normalise: bool = True) -> DataFrame:
    """(label, coords): coordinates times metric ^ (1 / p), so that plain distances of embeddings are weighted ones.

    With ``normalise`` they are divided by their norm, which is taken under the metric once
    more, as the reference tool does.
    """
    roots = array_literal([w ** (1 / distance.exponent) for w in metric])
    scaled = vectors.select("label", F.zip_with("coords", roots, lambda x, w: x * w).alias("coords"))
    if not normalise:
        return scaled
    norm = distance.norm(F.col("coords"), metric)
    return scaled.withColumn("_n", F.when(norm == 0, 1.0).otherwise(norm)).select("label", F.transform("coords", lambda x: x / F.col("_n")).alias("coords"))
