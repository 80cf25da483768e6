"""Queries over the driver's tables: one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralmill.functions.cleaning import clean_kmer, clean_label, clean_source
from spectralmill.functions.kmers import hash_hex
from spectralmill.functions.space import Distance, Metric, array_literal
from spectralmill.operators import algebra, combine, distances, embeddings, fit, select, splits, workflows
from spectralmill.operators.counts import accumulate_spectra
from spectralmill.operators.distill import distill
from spectralmill.operators.metadata import class_means, latest_metadata
from spectralmill.operators.project import clean_twister, project, project_long
from spectralmill.operators.sequences import count_kmers
from spectralmill.operators.stats import count_statistics
from spectralmill.operators.transforms import Transformation, transform_counts, zero_values
from spectralmill.operators.vectors import latest_vectors
from spectralmill.plans.pipeline import CountDatabase, VectorDatabase, count_to_spectra
from spectralmill.scratch import Scratch
from spectralmill.sources import tables
from spectralmill.sources.sequences import read_sequences, write_fasta, write_fastq
from spectralmill.sources.spectra_lines import load_lines, rejected_lines
from spectralmill.sources.tables import counts_table, database_listing, database_summary

Query = Callable[[SparkSession, str], DataFrame]
DIMS = 32
HOSTS = ["badger", "cattle", "human", "water"]
NUDGE = 1.234567e-10  # added before rounding where values lie halfway between two roundings, here and in the SQL
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Tables:
    """Inputs of the queries; frames that a query uses more than once are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.scratch = Scratch(spark, "query")
        self._cells: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.dir, name)

    def cells(self) -> DataFrame:
        """The accumulated spectra, written once for a query however often it asks for them."""
        if self._cells is None:
            self._cells = self.scratch.save(accumulate_spectra(self.table("spectra")))
        return self._cells

    def labels(self) -> DataFrame:
        """The labels with at least one valid row; the largest table isn't accumulated for that."""
        rows = self.table("spectra").select(clean_label(F.col("label")).alias("label"), "kmer", "count")
        return rows.where("label is not null and kmer is not null and count > 0").select("label").distinct()

    def folder(self, name: str) -> str:
        """A path for a file that is written and read again."""
        return f"{self.scratch.root}/{name}"

    def metadata(self) -> DataFrame:
        return latest_metadata(self.table("metadata"))

    def vectors(self) -> DataFrame:
        return self.scratch.save(latest_vectors(self.table("twisted"), DIMS))

    def classes(self) -> DataFrame:
        return self.scratch.save(class_means(latest_vectors(self.table("twisted"), DIMS), self.metadata(), DIMS))

    def weights(self, metric: Metric = Metric()) -> list[float]:
        return embeddings.metric_vector(self.table("inertia"), metric)

    def by_class(self, criterion: str = "mean") -> DataFrame:
        return combine.combine_by_group(self.cells(), self.groups(), criterion)

    def groups(self) -> DataFrame:
        return self.metadata().select("label", F.col("class_name").alias("group"))

    def parts(self) -> DataFrame:
        """Counts of the order lines: suppliers as spectra, parts as k-mers."""
        return self.table("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("label"), F.col("l_partkey").cast("string").alias("kmer")).agg(F.sum("l_quantity").cast("bigint").alias("count"))

    def suppliers(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").cast("string").alias("label"), F.col("s_nationkey").cast("string").alias("group"))

    def points(self) -> DataFrame:
        """Embeddings as vectors labelled by their id."""
        return self.table("embeddings").select(F.col("vec_id").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("coords"))

    def point_classes(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").cast("string").alias("label"), F.col("label").cast("string").alias("class_name"))

    def sequences(self, letters: str = LETTERS, bases: str = BASES) -> DataFrame:
        """Texts read as sequences of bases, tagged by language; the tag may be null."""
        return self.table("documents").select(F.col("lang").alias("tag"), F.translate("text", letters, bases).alias("seq"))


def _round(frame: DataFrame, digits: int, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})


def _long(vectors: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    return vectors.select("label", F.posexplode("coords").alias("dim", "value")).select("label", (F.col("dim") + 1).alias("dim"), F.round(F.col("value") + nudge, digits).alias("value"))


def _summary_rows(summaries: DataFrame) -> DataFrame:
    rows = summaries.select("label", "mean", "stddev", "median", "mad", F.explode("neighbours").alias("n"))
    return _round(rows.select("label", "mean", "stddev", "median", "mad", "n.rank", F.col("n.label").alias("neighbour"), "n.distance", "n.z"), 6, "mean", "stddev", "median", "mad", "distance", "z")


def _stats(by: str, threshold: float, power: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(count_statistics(Tables(spark, sf_dir).cells(), by, threshold, power), 6, "sum", "sum_log")

    return run


def _transform(which: str, threshold: float, power: float, digits: int = 6) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(transform_counts(Tables(spark, sf_dir).cells(), Transformation(which, threshold, power)), digits, "value")

    return run


def _cross(distance: str, metric: str, normalise: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return _round(distances.cross_distances(t.vectors(), t.classes(), t.weights(Metric.parse(metric)), Distance.parse(distance), normalise), 6, "distance")

    return run


def _query(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


def _selected(t: Tables) -> tuple[DataFrame, DataFrame]:
    labels = select.all_labels(t.labels())
    return labels, select.select_matching(labels, [("", "LB\\|QS"), ("host", "human\\|cattle")], t.metadata())


def _nonnull_hosts(t: Tables) -> DataFrame:
    return combine.combine_by_group(t.cells(), t.metadata().select("label", F.col("host").alias("group")))


def _ca_values(t: Tables) -> DataFrame:
    return t.scratch.save(t.by_class().select("label", "kmer", F.col("count").cast("double").alias("value")))


def _ca_distances(t: Tables) -> DataFrame:
    """Distances of classes in the full space of a fit, each dimension weighted by its principal inertia."""
    values = _ca_values(t)
    model = fit.fit_twister(values, normalise=False)
    return _round(distances.triangular_distances(model.twisted, _principal(values, model), Distance(), normalise=False), 6, "distance")


def _principal(values: DataFrame, model: fit.Twister) -> list[float]:
    """The principal inertias of a fit's dimensions: their shares times the whole, which is the trace of the Gram matrix less 1."""
    total = fit.scaled_residues(values).agg(F.sum(F.col("x") * F.col("x"))).first()[0] - 1
    return [r["value"] * total for r in model.inertia.orderBy("dim").collect()]


def _ca_projection(t: Tables) -> DataFrame:
    """Distances between the spectra of hosts, which the fit of the classes hasn't seen, each dimension weighted by its squared principal inertia."""
    values = _ca_values(t)
    model = fit.fit_twister(values, normalise=False)
    inertias = _principal(values, model)
    projected = t.scratch.save(project(_nonnull_hosts(t), model.twister, len(inertias)))
    return _round(distances.triangular_distances(projected, [w * w for w in inertias], Distance(), normalise=False), 6, "distance")


def _ca_kmers(t: Tables) -> DataFrame:
    """The squared chi-square distance of each k-mer's profile from the mean profile, from its coordinates."""
    values = _ca_values(t)
    model = fit.fit_twister(values, normalise=False)
    return _round(model.kmers.select("kmer", _weighted_square(_principal(values, model)).alias("chi2")), 6, "chi2")


def _weighted_square(weights: list[float]) -> Column:
    return F.aggregate(F.zip_with("coords", array_literal(weights), lambda x, w: x * x * w), F.lit(0.0), lambda a, b: a + b)


def _means(t: Tables) -> tuple[DataFrame, list[float]]:
    return t.classes(), t.weights()


def _accuracy(t: Tables) -> DataFrame:
    classes, weights = _means(t)
    near = workflows.nearest_class(distances.summarise_rowwise(t.vectors(), classes, weights))
    return workflows.accuracy(near, t.metadata().select("label", F.col("class_name").alias("true_class")))


def _knn(t: Tables) -> DataFrame:
    points = t.points()
    near = distances.summarise_rowwise(points, points, [1.0 / 64] * 64, normalise=False, keep=6)
    others = near.withColumn("neighbours", F.filter("neighbours", lambda n: n["label"] != F.col("label")))
    return _round(workflows.knn_vote(others, t.point_classes(), 5), 6, "share")


def _stored(t: Tables) -> DataFrame:
    """Stored sums that differ from those of the counts."""
    stored = t.table("load_stats").select(clean_label(F.col("label")).alias("label"), "batch", "sum").where("label is not null and sum is not null").groupBy("label").agg(F.max_by("sum", "batch").cast("bigint").alias("sum"))
    computed = t.cells().groupBy("label").agg(F.sum("count").alias("sum"))
    return workflows.compare_counts(stored, computed, "label", "sum")


def _metadata_classes(t: Tables) -> DataFrame:
    return t.metadata().where("class_name is not null")


def _by_k(sequences: DataFrame) -> DataFrame:
    counted = [count_kmers(sequences, k, "DNA-ds").withColumn("k", F.lit(k)) for k in (3, 4, 5)]
    return workflows.choose_k(counted[0].unionByName(counted[1]).unionByName(counted[2]))



def queries() -> dict[str, Query]:
    q = _query
    return {
        "p4_found": q(lambda t: rejected_lines(t.table("spectra_lines"))),
        "p4_load": q(lambda t: load_lines(t.table("spectra_lines"))),
        "spectra_accumulate": q(lambda t: accumulate_spectra(t.table("spectra"))),
        "database_summary": q(lambda t: database_summary(t.cells(), t.metadata())),
        "kmer_count_dna_ds": q(lambda t: count_kmers(t.sequences(), 5, "DNA-ds")),
        "kmer_count_dna_ss": q(lambda t: count_kmers(t.sequences(), 5, "DNA-ss")),
        "kmer_count_protein": q(lambda t: count_kmers(t.sequences("", ""), 3, "protein")),
        "kmer_count_one_spectrum": q(lambda t: count_kmers(t.sequences(), 6, "DNA-ds", label="all")),
        "kmer_hash_hex": q(lambda t: t.cells().select("kmer").distinct().select("kmer", hash_hex(F.col("kmer")).alias("code"))),
        "col_stats": _stats("label", 2, 1),
        "col_stats_relative": _stats("label", 0.01, 0.5),
        "row_stats": _stats("kmer", 2, 1),
        "row_stats_relative": _stats("kmer", 0.01, 0.5),
        "transform_binary": _transform("binary", 3, 1),
        "transform_power": _transform("power", 2, 0.5),
        "transform_power_relative": _transform("power", 0.01, 1),
        "transform_clr": _transform("clr", 1, 1),
        "transform_clr_zeros": q(lambda t: _round(zero_values(t.cells(), Transformation("clr", 1, 1)), 6, "value")),
        "transform_pseudo_zero": _transform("pseudocounts", 1, 0, 9),
        "transform_pseudo_half": _transform("pseudocounts", 2, 0.5, 9),
        "transform_pseudo_two": _transform("pseudocounts", 3, 2, 9),
        "select_labels": q(lambda t: select.select_labels(select.all_labels(t.labels(), t.metadata()), ["POOL-ENV-01", "no such label"])),
        "select_matching": q(lambda t: _selected(t)[1]),
        "select_negated": q(lambda t: select.negate_selection(*_selected(t))),
        "remove_selected": q(lambda t: select.remove_selected(t.cells(), _selected(t)[1]).groupBy("label").agg(F.count("*").alias("kmers"))),
        "nonzero_kmers": q(lambda t: select.nonzero_kmers(t.cells(), 50)),
        "table_pivot": q(lambda t: counts_table(_nonnull_hosts(t), "count", HOSTS)),
        "combine_mean_by_class": q(lambda t: t.by_class()),
        "combine_median_by_class": q(lambda t: t.by_class("median")),
        "combine_selected": q(lambda t: combine.combine_selected(t.cells(), _selected(t)[1], "combined").where("label = 'combined'")),
        "combine_metadata": q(lambda t: combine.combine_metadata(t.metadata().select("label", "host", "site"), t.groups())),
        "class_indicator": q(lambda t: combine.class_indicator(_metadata_classes(t), "class_name")),
        "distill": q(lambda t: _distilled(t)),
        "distill_spectra": q(lambda t: _distilled_spectra(t)),
        "ca_gram": q(lambda t: _round(fit.gram_matrix(_ca_values(t)), 6, "g")),
        "ca_masses": q(lambda t: _round(fit.column_masses(_ca_values(t)), 9, "mass")),
        "ca_distances": q(_ca_distances),
        "ca_projection": q(_ca_projection),
        "kmers_threshold": q(lambda t: fit.threshold_kmers(_ca_values(t), 0.1).groupBy("kmer").agg(F.count("*").alias("spectra"))),
        "kmers_normalised": q(lambda t: _round(fit.normalise_spectra(_ca_values(t)), 9, "value")),
        "project_spectra": q(lambda t: _round(project_long(t.cells(), clean_twister(t.table("twister"), clean_kmer(F.col("kmer")))).withColumn("value", F.col("value") + NUDGE), 6, "value")),
        "metric_flat": q(lambda t: _round(embeddings.metric_table(t.table("inertia"), Metric.parse("flat")), 9, "weight")),
        "metric_powers": q(lambda t: _round(embeddings.metric_table(t.table("inertia"), Metric.parse("powers(1,0.8,2)")), 9, "weight")),
        "vector_norms": q(lambda t: _round(embeddings.norms(t.vectors(), t.weights()), 6, "norm")),
        "embeddings_scaled": q(lambda t: _long(embeddings.embed(t.vectors(), t.weights(Metric.parse("flat")), Distance.parse("minkowski(3)"), normalise=False))),
        "embeddings_normalised": q(lambda t: _long(embeddings.embed(t.vectors(), t.weights()))),
        "dist_euclidean": _cross("euclidean", "powers(1,1,2)", True),
        "dist_cosine": _cross("cosine", "powers(1,1,2)", True),
        "dist_minkowski": _cross("minkowski(3)", "flat", False),
        "dist_self_triangular": q(lambda t: _round(distances.triangular_distances(*_means(t)), 6, "distance")),
        "spectral_distances": q(lambda t: _class_spectra_distances(t)),
        "summary_nearest": q(lambda t: _summary_rows(distances.summarise_rowwise(t.vectors(), *_means(t)))),
        "summary_of_distances": q(lambda t: _summary_rows(distances.summarise_distances(t.scratch.save(distances.cross_distances(t.vectors(), *_means(t))), 3))),
        "nearest_class": q(lambda t: _round(workflows.nearest_class(distances.summarise_rowwise(t.vectors(), *_means(t))), 6, "distance")),
        "classification_accuracy": q(_accuracy),
        "knn_vote": q(_knn),
        "related_300": q(lambda t: _summary_rows(distances.summarise_rowwise(t.points(), t.points(), [1.0 / 64] * 64, normalise=False, keep=300)).select("label", "rank", "neighbour", "distance")),
        "gaps_splits": q(lambda t: _round(splits.gaps(t.vectors()), 6, "gap")),
        "gaps_member_ranges": q(lambda t: _member_ranges(t)),
        "centroid_splits": q(lambda t: splits.centroids(t.vectors(), seed=5).select("split_id", "weight", F.size("members").alias("members"))),
        "band_join_pairs": q(lambda t: _round(distances.band_pairs(t.table("part"), 0.05, "p_partkey", "p_retailprice"), 6, "distance")),
        "coordinate_range": q(lambda t: distances.coordinate_range(t.table("part"), "p_retailprice")),
        "matrix_transpose": q(lambda t: _round(algebra.transpose(algebra.to_long(t.classes())).withColumn("value", F.col("value") + NUDGE), 6, "value")),
        "matrix_merge_rows": q(lambda t: _long(algebra.merge_rows(t.vectors(), t.classes()), nudge=NUDGE)),
        "matrix_vector": q(lambda t: _round(algebra.multiply_vector(algebra.to_long(t.vectors()), t.table("inertia").select(F.col("name").alias("col"), "value")), 6, "value")),
        "matrix_product": q(lambda t: _product(t)),
        "label_difference": q(lambda t: algebra.label_difference(t.labels(), t.metadata())),
        "label_union": q(lambda t: algebra.label_union(t.labels(), t.metadata())),
        **_round_trips(),
        **_exports(),
        "database_listing": q(lambda t: database_listing(t.cells(), t.metadata())),
        "database_empty": q(lambda t: CountDatabase(t.spark).summary()),
        "selection_print": q(lambda t: t.spark.createDataFrame([(n,) for n in CountDatabase(t.spark, t.cells(), t.metadata()).select_matching([("", "LB")]).selected()], "label string")),
        "selection_filter": q(lambda t: _filtered(t)),
        "combine_large": q(lambda t: combine.combine_by_group(t.cells().withColumn("count", F.col("count") * 1_000_000), t.metadata().select("label", F.lit("all").alias("group")))),
        "project_vectors": q(lambda t: _long(project(t.cells(), clean_twister(t.table("twister"), clean_kmer(F.col("kmer"))), DIMS), nudge=NUDGE)),
        "kmers_kept": q(lambda t: fit.keep_kmers(_ca_values(t), clean_twister(t.table("twister"), clean_kmer(F.col("kmer")))).groupBy("label").agg(F.count("*").alias("kmers"))),
        "kmers_sampled": q(lambda t: _sampled(t)),
        "ca_kmers": q(_ca_kmers),
        "dist_self_symmetric": q(lambda t: _round(distances.symmetric(distances.triangular_distances(*_means(t))), 6, "distance")),
        "dist_infinity": q(lambda t: _infinite(t)),
        "spectral_distances_cosine": q(lambda t: _class_spectra_distances(t, "cosine", False)),
        "spectral_distances_minkowski": q(lambda t: _class_spectra_distances(t, "minkowski(1)", True)),
        "matrix_sparse_vector": q(lambda t: _round(algebra.multiply_sparse_vector(algebra.to_long(t.vectors()), t.table("inertia").where("dim <= 3").select(F.col("name").alias("col"), "value")), 6, "value")),
        "option_texts": q(lambda t: t.spark.createDataFrame([(x, str(kind.parse(x))) for kind, texts in TEXTS for x in texts], "text string, parsed string")),
        "centroid_counts": q(lambda t: _centroid_counts(t)),
        "best_k": q(lambda t: workflows.best_k(_by_k(t.sequences()))),
        "random_forest": q(lambda t: _forest(t)),
        "train_test_split": q(lambda t: workflows.train_test_split(_metadata_classes(t).select("label", "class_name"), "class_name")),
        "dedup_first": q(lambda t: workflows.first_of_name(t.table("documents").select("doc_id", "file_path", "crawled_at"), "file_path", [F.asc("crawled_at"), F.asc("doc_id")]).select("doc_id", "file_path")),
        "count_by_class": q(lambda t: workflows.count_by_class(t.metadata(), "class_name")),
        "compare_stored_sums": q(_stored),
        "name_join": q(lambda t: workflows.join_by_name(t.table("documents").select("doc_id", clean_source(F.col("source")).alias("name")), t.table("mix_targets").select(F.col("source").alias("name"), "max_repeats"))),
        "choose_k": q(lambda t: _round(_by_k(t.sequences()), 6, "score")),
        "filter_reads": q(lambda t: workflows.filter_reads(t.table("documents").select(F.col("doc_id").alias("tag"), F.col("text").alias("seq")), _segments(t))),
    }


def _distilled(t: Tables) -> DataFrame:
    table = distill(t.scratch.save(t.parts()), t.suppliers())
    return _round(table, 7, *(c for c in table.columns if c != "kmer"))


def _distilled_spectra(t: Tables) -> DataFrame:
    """Distillation of the accumulated spectra that have a class."""
    cells = t.cells()
    groups = t.groups().where("`group` is not null").join(cells.select("label").distinct(), "label", "left_semi")
    table = distill(cells, t.scratch.save(groups))
    return _round(table, 7, *(c for c in table.columns if c != "kmer"))


def _member_ranges(t: Tables) -> DataFrame:
    """Members of the splits of gaps_splits."""
    vectors = t.vectors()
    return splits.member_ranges(vectors, splits.gaps(vectors))


def _class_spectra_distances(t: Tables, distance: str = "euclidean", normalise: bool = True) -> DataFrame:
    spectra = t.scratch.save(t.by_class())
    labels = spectra.select("label").distinct()
    return _round(distances.spectral_distances(spectra, labels, labels, Distance.parse(distance), normalise), 6, "distance")


TEXTS = [
    (Distance, ["euclidean", "cosine", "minkowski(3)", "minkowski(2.50)"]), (Metric, ["flat", "powers(1,1,2)", "powers(0.50,0.8,2.0)"]), (Transformation, ["pow", "CLR(1,1)", "pseudo(2,0.50)", "binary(3,1)"]),
]


def _filtered(t: Tables) -> DataFrame:
    """Labels that are exported after those of a selection were filtered out."""
    db = CountDatabase(t.spark, t.cells(), t.metadata()).select_matching([("host", "human")]).selection_to_filter()
    return db.exported().groupBy("label").agg(F.count("*").alias("kmers"))


def _sampled(t: Tables) -> DataFrame:
    """How many k-mers a sample of a third holds, and how many of them the table lacks."""
    values = _ca_values(t)
    sample = fit.sample_kmers(values, 1 / 3, 7).select("kmer").distinct()
    return sample.agg(F.count("*").alias("kmers")).withColumn("unknown", F.lit(sample.join(values.select("kmer").distinct(), "kmer", "left_anti").count()))


def _infinite(t: Tables) -> DataFrame:
    """Class means, of which those before "m" are cut to 31 dimensions, against all class means."""
    classes = t.classes()
    cut = classes.withColumn("coords", F.when(F.col("label") < "m", F.slice("coords", 1, DIMS - 1)).otherwise(F.col("coords")))
    return distances.cross_distances(t.scratch.save(cut), classes, t.weights(), mismatch="infinity").where(F.col("distance") == float("inf")).select("row_label", "col_label")


def _centroid_counts(t: Tables) -> DataFrame:
    """Number of splits, of those without members, and of those that are split no further."""
    found = splits.centroids(t.vectors(), seed=5)
    parents = found.where(F.length("split_id") > 1).select(F.expr("left(split_id, length(split_id) - 1)").alias("split_id")).distinct().withColumn("_inner", F.lit(True))
    return found.join(parents, "split_id", "left").agg(F.count("*").alias("splits"), F.count_if(F.size("members") == 0).alias("empty"), F.count_if(F.col("_inner").isNull()).alias("leaves"))


def _forest(t: Tables) -> DataFrame:
    """Items and those whose class a random forest of the odd labels' vectors gets right."""
    parts = t.scratch.save(workflows.train_test_split(_metadata_classes(t).select("label", "class_name").join(t.vectors(), "label"), "class_name"))
    train, test = (parts.where(F.col("part") == p) for p in ("train", "test"))
    told = workflows.random_forest(train.select("label", "coords"), test.select("label", "coords"), train.select("label", "class_name"), trees=20)
    return told.join(test.select("label", "class_name"), "label").agg(F.count("*").alias("items"), F.count_if(F.col("predicted") == F.col("class_name")).alias("right"))


def _written(t: Tables, name: str, write: Callable[[str], object]) -> str:
    path = t.folder(name)
    write(path)
    return path


def _text_spectra(t: Tables) -> DataFrame:
    cells = t.cells()
    return tables.read_spectra(t.spark, _written(t, "spectra.txt", lambda p: tables.write_spectra(cells, p)))


def _database(t: Tables) -> DataFrame:
    path = _written(t, "database", lambda p: CountDatabase(t.spark, t.cells(), t.metadata()).save(p))
    db = CountDatabase(t.spark).load(path)
    return db.cells.join(db.metadata.select("label", "class_name"), "label", "left")


def _vectors_of(t: Tables, text: bool) -> DataFrame:
    db, path = VectorDatabase(t.spark, twisted=t.vectors()), t.folder("twisted")
    back = VectorDatabase(t.spark)
    db = db.save_table("twisted", path) if text else db.save("twisted", path)
    return _long((back.load_table("twisted", path) if text else back.load("twisted", path)).twisted, nudge=NUDGE)


def _twister_of(t: Tables, text: bool) -> DataFrame:
    twister = clean_twister(t.table("twister"), clean_kmer(F.col("kmer")))
    db, path, back = VectorDatabase(t.spark, twister=t.scratch.save(twister), inertia=t.table("inertia")), t.folder("twister"), VectorDatabase(t.spark)
    db = db.save_table("twister", path) if text else db.save("twister", path)
    back = back.load_table("twister", path) if text else back.load("twister", path)
    weighted = back.twister.select("kmer", F.posexplode("weights").alias("dim", "w")).join(back.inertia.select((F.col("dim") - 1).alias("dim"), "value"), "dim")
    return _round(weighted.groupBy("kmer").agg((F.sum(F.col("w") * F.col("value")) + NUDGE).alias("value")), 6, "value")


def _sequence_file(t: Tables, fastq: bool) -> DataFrame:
    """Length of every text after a round trip; line ends would end a sequence and > would begin one, so they are taken out."""
    flat = t.table("documents").select(F.col("doc_id").cast("string").alias("tag"), F.regexp_replace("text", r"[\s>]", "").alias("seq")).where("seq <> ''")
    path = _written(t, "sequences", lambda p: (write_fastq if fastq else write_fasta)(flat, p))
    back = read_sequences(t.spark, paired=[(path, path)]) if fastq else read_sequences(t.spark, fasta=[path])
    return back.select(F.col("tag"), "segm", F.length("seq").alias("letters"))


def _round_trips() -> dict[str, Query]:
    """What is read back from files that a query wrote."""
    q = _query
    return {
        "file_spectra_text": q(_text_spectra),
        "file_spectra_hex": q(lambda t: tables.read_spectra(t.spark, _written(t, "hex.txt", lambda p: count_to_spectra(t.sequences().where("tag is not null"), p, 5)))),
        "file_metadata": q(lambda t: tables.read_metadata(t.spark, _written(t, "metadata.txt", lambda p: tables.write_metadata(t.metadata().coalesce(1), p)))),
        "file_database": q(_database),
        "file_matrix_text": q(lambda t: _vectors_of(t, True)),
        "file_matrix_archive": q(lambda t: _vectors_of(t, False)),
        "file_twister_text": q(lambda t: _twister_of(t, True)),
        "file_twister_archive": q(lambda t: _twister_of(t, False)),
        "file_keep_list": q(lambda t: tables.read_keep_list(t.spark, _written(t, "keep.txt", lambda p: t.table("twister").select("kmer").where("kmer is not null").write.text(p)))),
        "file_fasta": q(lambda t: _sequence_file(t, False)),
        "file_fastq_paired": q(lambda t: _sequence_file(t, True)),
        "file_distances": q(_distance_file),
        "file_metrics": q(lambda t: _metric_file(t)),
        "file_distill": q(lambda t: _distill_file(t)),
    }


def _distance_file(t: Tables) -> DataFrame:
    db = VectorDatabase(t.spark, distances=distances.triangular_distances(*_means(t)))
    path = _written(t, "distances", lambda p: db.save_table("distances", p))
    return _round(VectorDatabase(t.spark).load_table("distances", path).distances.where("distance > 0"), 6, "distance")


def _metric_file(t: Tables) -> DataFrame:
    path = _written(t, "metrics", lambda p: VectorDatabase(t.spark, inertia=t.table("inertia")).set(metric="flat").save_table("metrics", p))
    return _round(tables.read_matrix(t.spark, path).select("label", F.posexplode("coords").alias("dim", "weight")).withColumn("dim", F.col("dim") + 1), 9, "weight")


def _distill_file(t: Tables) -> DataFrame:
    table = distill(t.scratch.save(t.parts()), t.suppliers())
    path = _written(t, "distill", lambda p: tables.write_distill(table, p))
    return _round(tables.read_matrix(t.spark, path).select(F.col("label").alias("kmer"), F.col("coords")[0].alias("InnerAvgMean"), F.col("coords")[1].alias("OuterAvgMean")), 7, "InnerAvgMean", "OuterAvgMean")


def _host_database(t: Tables) -> CountDatabase:
    """Spectra of hosts with a field of metadata."""
    cells = t.scratch.save(_nonnull_hosts(t))
    return CountDatabase(t.spark, cells, t.spark.createDataFrame([(h, h.upper()) for h in HOSTS], "label string, name string"))


def _table_lines(which: str, **options) -> Query:
    def build(t: Tables) -> DataFrame:
        """Lines of a dense table with its numbers split off and rounded."""
        lines = _host_database(t).set(transformation=which, **options).table_lines().where("part = 2").select("name", F.posexplode(F.split("line", "\t")).alias("at", "v"))
        return _round(lines.select("name", "at", F.col("v").try_cast("double").alias("value")).where("value is not null"), 6, "value")

    return _query(build)


def _exports() -> dict[str, Query]:
    q = _query
    return {
        "table_clr": _table_lines("clr(1,1)", with_metadata=True),
        "table_clr_transposed": _table_lines("clr(1,1)", transposed=True, row_names=False),
        "table_power": _table_lines("power(2,1)", zero_kmers=True, row_names=False),
        "table_heads": q(lambda t: _host_database(t).set(with_metadata=True).table_lines().where("part < 2").select("part", "line")),
        "table_heads_transposed": q(lambda t: _host_database(t).set(with_metadata=True, transposed=True, column_names=False).table_lines().select("name", F.split("line", "\t")[1].alias("field"))),
        "file_summary": q(lambda t: tables.summary_lines(distances.summarise_rowwise(t.vectors(), *_means(t))).select(F.split("line", "\t").alias("f")).select(F.col("f")[0].alias("label"), F.round(F.col("f")[1].cast("double"), 6).alias("mean"), F.col("f")[5].alias("nearest"))),
        "file_splits": q(lambda t: _split_file(t)),
    }


def _split_file(t: Tables) -> DataFrame:
    """Weight and number of members of each line of the splits of the class means."""
    classes = t.classes()
    found = splits.gaps(classes, 100)
    path = _written(t, "splits", lambda p: tables.write_splits(found, p, splits.member_ranges(classes, found)))
    fields = t.spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return fields.select(F.col("f")[0].cast("int").alias("split_id"), F.round(F.col("f")[1].cast("double") + 1e-7, 5).alias("weight"), (F.size("f") - 2).alias("members"))


def _product(t: Tables) -> DataFrame:
    matrix = algebra.to_long(t.classes())
    return _round(algebra.multiply(matrix, algebra.transpose(matrix)), 6, "value")


def _segments(t: Tables) -> DataFrame:
    """Pieces of 25 signs of the item texts, as targets of reads."""
    starts = F.sequence(F.lit(1), F.length("text") - 24, F.lit(1))
    return t.table("eval_items").where("length(text) >= 25").select(F.explode(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(25)))).alias("segment"))
