"""Matrix algebra on long tables (row, col, value) and set operations on labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.errors import DuplicateLabel, IncompatibleMatrices


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def to_long(vectors: DataFrame) -> DataFrame:
    """(row, col, value) of vectors (label, coords); columns are DimN from 1."""
    return vectors.select(F.col("label").alias("row"), F.posexplode("coords").alias("_d", "value")).select("row", F.concat(F.lit("Dim"), F.col("_d") + 1).alias("col"), "value")


def merge_rows(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of two sets of vectors (label, coords); raises if a label is in both or the dimensions differ."""
    first, second = one.select(F.size("coords").alias("n")).first(), two.select(F.size("coords").alias("n")).first()
    if first and second and first["n"] != second["n"]:
        raise IncompatibleMatrices(f"{first['n']} and {second['n']} columns")
    twice = one.select("label").join(two.select("label"), "label", "left_semi").first()
    if twice is not None:
        raise DuplicateLabel(twice["label"])
    return one.unionByName(two)


def multiply_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(row, value) = matrix x vector(col, value); columns that the vector lacks count 0."""
    joined = matrix.join(vector.select("col", F.col("value").alias("_v")), "col", "left")
    return joined.groupBy("row").agg(F.sum(F.col("value") * F.coalesce("_v", F.lit(0.0))).alias("value"))


def multiply_sparse_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(row, value) = matrix x vector(col, value) that names its few columns other than 0; rows without any of them are missing."""
    joined = matrix.join(vector.where("value <> 0").select("col", F.col("value").alias("_v")), "col")
    return joined.groupBy("row").agg(F.sum(F.col("value") * F.col("_v")).alias("value"))


def multiply(one: DataFrame, two: DataFrame) -> DataFrame:
    """(row, col, value) = one x two; the columns of one are the rows of two. Entries without common index are absent (0)."""
    left = one.select(F.col("row").alias("_i"), F.col("col").alias("_k"), F.col("value").alias("_a"))
    right = two.select(F.col("row").alias("_k"), F.col("col").alias("_j"), F.col("value").alias("_b"))
    return left.join(right, "_k").groupBy("_i", "_j").agg(F.sum(F.col("_a") * F.col("_b")).alias("value")).select(F.col("_i").alias("row"), F.col("_j").alias("col"), "value")


def label_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.select("label").distinct().join(two.select("label"), "label", "left_anti")


def label_union(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.select("label").union(two.select("label")).distinct()
