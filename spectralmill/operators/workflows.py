"""Operations of documented workflows: splits of samples, joins of names, predictions and their accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralmill.operators.order import place_rows


def train_test_split(labels: DataFrame, by: str | None = None) -> DataFrame:
    """Adds ``part``: train for odd and test for even places in label order, within each value of ``by`` if given."""
    placed = place_rows(labels, [by] if by else [], ["label"], "_n")
    return placed.withColumn("part", F.when(F.col("_n") % 2 == 1, "train").otherwise("test")).drop("_n")


def first_of_name(rows: DataFrame, name: str, order: list) -> DataFrame:
    """The first row of every name in the given order. A name with many rows is cut in each task before the shuffle."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(name).orderBy(*order)))
    return ranked.where(F.col("_n") == 1).drop("_n")


def join_by_name(sequences: DataFrame, lineages: DataFrame, name: str = "name") -> DataFrame:
    """Inner join after normalising names: blanks become underscores, and what follows the first bar is cut."""
    norm = lambda c: F.element_at(F.split(F.regexp_replace(F.btrim(c), r"\s+", "_"), r"\|"), 1)
    return sequences.withColumn(name, norm(F.col(name))).join(lineages.withColumn(name, norm(F.col(name))), name)


def count_by_class(metadata: DataFrame, field: str) -> DataFrame:
    return metadata.groupBy(field).agg(F.count_distinct("label").alias("labels"))


def compare_counts(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """(key, one, two): rows whose values differ, a missing one counting as null."""
    a, b = one.select(key, F.col(value).alias("one")), two.select(key, F.col(value).alias("two"))
    return a.join(b, key, "full_outer").where(~F.col("one").eqNullSafe(F.col("two")))


def nearest_class(summaries: DataFrame) -> DataFrame:
    """(label, predicted, distance) from summaries; of tied classes the smallest name."""
    return summaries.where(F.size("neighbours") > 0).select("label", F.col("neighbours")[0]["label"].alias("predicted"), F.col("neighbours")[0]["distance"].alias("distance"))


def accuracy(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(items, wrong, nearly): all items; those whose class isn't the true one; those of them whose class is a sub-class of it or the reverse ("B.1" and "B.1.2")."""
    joined = predictions.join(truth.select("label", "true_class"), "label")
    p, t = F.col("predicted"), F.col("true_class")
    sub = p.startswith(F.concat(t, F.lit("."))) | t.startswith(F.concat(p, F.lit(".")))
    return joined.agg(F.count("*").alias("items"), F.count_if(p != t).alias("wrong"), F.count_if((p != t) & sub).alias("nearly"))


def knn_vote(summaries: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(label, predicted, share): majority among the k nearest neighbours; ties go to the class seen nearest first; share = votes of it / votes."""
    near = summaries.select("label", F.explode(F.slice("neighbours", 1, k)).alias("n")).select(F.col("label").alias("_label"), F.col("n.rank").alias("rank"), F.col("n.label").alias("label"))
    voted = near.join(classes.select("label", "class_name"), "label").groupBy("_label", "class_name").agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    best = voted.groupBy("_label").agg(F.min(F.struct((-F.col("votes")).alias("v"), "first", "class_name")).alias("b"), F.sum("votes").alias("all"))
    return best.select(F.col("_label").alias("label"), F.col("b.class_name").alias("predicted"), (-F.col("b.v") / F.col("all")).alias("share"))


def choose_k(spectra_by_k: DataFrame) -> DataFrame:
    """(k, score) from (k, label, kmer, count): the least ratio, over labels, of the greatest count to the counts' geometric mean; the best k has the greatest score."""
    ratio = spectra_by_k.groupBy("k", "label").agg((F.max("count") / F.exp(F.avg(F.ln("count")))).alias("ratio"))
    return ratio.groupBy("k").agg(F.min("ratio").alias("score"))


def best_k(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))


def filter_reads(reads: DataFrame, targets: DataFrame, segment: int = 25, hits: int = 3) -> DataFrame:
    """Reads (tag, seq) of which at least ``hits`` non-overlapping segments are among the targets (segment)."""
    starts = F.sequence(F.lit(1), F.length("seq") - segment + 1, F.lit(segment))
    cut = reads.where(F.length("seq") >= segment).select("tag", F.explode(F.transform(starts, lambda i: F.substring(F.col("seq"), i, F.lit(segment)))).alias("segment"))
    found = cut.join(targets.select("segment").distinct(), "segment", "left_semi").groupBy("tag").agg(F.count("*").alias("hits"))
    return found.where(F.col("hits") >= hits)


def random_forest(train: DataFrame, test: DataFrame, classes: DataFrame, trees: int = 100, seed: int = 0) -> DataFrame:
    """(label, predicted): random forest of vectors' coordinates on train, applied to test; classes has label and class_name."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    known = train.join(classes.select("label", "class_name"), "label").select(array_to_vector("coords").alias("features"), "class_name")
    index = StringIndexer(inputCol="class_name", outputCol="target", stringOrderType="alphabetAsc").fit(known)
    model = RandomForestClassifier(labelCol="target", numTrees=trees, seed=seed).fit(index.transform(known))
    scored = model.transform(test.select("label", array_to_vector("coords").alias("features")))
    return IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels).transform(scored).select("label", "predicted")
