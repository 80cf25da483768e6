"""Two front ends that keep frames in named registers, so that a program is a chain of calls.

Nothing runs until a result is collected or written; every call returns the object itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralmill.errors import InvalidRegisterType, UnexpectedType
from spectralmill.functions.kmers import hash_hex
from spectralmill.functions.space import Distance, Metric
from spectralmill.operators import combine, distances, embeddings, select, splits
from spectralmill.operators.algebra import merge_rows
from spectralmill.operators.distill import distill
from spectralmill.operators.fit import Twister, fit_twister, keep_kmers, sample_kmers, threshold_kmers
from spectralmill.operators.project import project
from spectralmill.operators.sequences import count_kmers
from spectralmill.operators.transforms import Transformation, transform_counts, zero_values
from spectralmill.sources import tables

CELLS = "label string, kmer string, count bigint"


@dataclass
class CountDatabase:
    """Spectra and metadata, a selection, an export filter and options."""

    spark: SparkSession
    cells: DataFrame | None = None
    metadata: DataFrame | None = None
    selection: DataFrame | None = None
    excluded: DataFrame | None = None
    criterion: str = "mean"
    distance: Distance = field(default_factory=Distance)
    distance_normalise: bool = True
    transformation: Transformation = field(default_factory=Transformation)
    zero_kmers: bool = False
    row_names: bool = True
    column_names: bool = True
    with_metadata: bool = False
    transposed: bool = False
    precision: int = 15

    def __post_init__(self):
        if self.cells is None:
            self.empty()

    def empty(self) -> CountDatabase:
        self.cells = self.spark.createDataFrame([], CELLS)
        self.metadata = self.spark.createDataFrame([], "label string")
        return self.clear_selection()

    def load(self, path: str) -> CountDatabase:
        found = tables.read_archive(self.spark, path, "counts")
        self.cells, self.metadata = found["cells"], found["metadata"]
        return self

    def save(self, path: str) -> CountDatabase:
        tables.write_archive({"cells": self.cells, "metadata": self.metadata}, "counts", path)
        return self

    def add_spectra(self, paths: str | list[str]) -> CountDatabase:
        return self.add_cells(tables.read_spectra(self.spark, paths))

    def add_cells(self, cells: DataFrame) -> CountDatabase:
        self.cells = self.cells.unionByName(cells.select("label", "kmer", "count")).groupBy("label", "kmer").agg(F.sum("count").alias("count"))
        return self

    def add_metadata(self, path_or_frame: str | DataFrame) -> CountDatabase:
        new = tables.read_metadata(self.spark, path_or_frame) if isinstance(path_or_frame, str) else path_or_frame
        self.metadata = tables.add_metadata(self.metadata, new)
        return self

    def labels(self) -> DataFrame:
        return select.all_labels(self.cells, self.metadata)

    def select_labels(self, names: list[str]) -> CountDatabase:
        self.selection = select.select_labels(self.labels(), names)
        return self

    def select_matching(self, patterns: list[tuple[str, str]]) -> CountDatabase:
        self.selection = select.select_matching(self.labels(), patterns, self.metadata)
        return self

    def negate_selection(self) -> CountDatabase:
        self.selection = select.negate_selection(self.labels(), self.selection)
        return self

    def clear_selection(self) -> CountDatabase:
        self.selection = self.spark.createDataFrame([], "label string")
        return self

    def selection_to_filter(self) -> CountDatabase:
        self.excluded = self.selection
        return self

    def remove_selected(self) -> CountDatabase:
        self.cells, self.metadata = select.remove_selected(self.cells, self.selection), select.remove_selected(self.metadata, self.selection)
        return self

    def add_combined_selected(self, label: str) -> CountDatabase:
        groups = self.selection.select("label", F.lit(label).alias("group"))
        meta = combine.combine_metadata(self.metadata, groups)
        self.cells = combine.combine_selected(self.cells, self.selection, label, self.criterion)
        self.metadata = self.metadata.where(F.col("label") != label).unionByName(meta, allowMissingColumns=True)
        return self

    def combine_classes(self, name: str) -> CountDatabase:
        self.cells, self.metadata = combine.combine_classes(self.cells, self.metadata, name, self.criterion)
        return self

    def set(self, **options) -> CountDatabase:
        """Any of ``OPTIONS``; distance and transformation may be given as text."""
        parse = {"distance": Distance.parse, "transformation": Transformation.parse}
        for name, value in options.items():
            if name not in OPTIONS:
                raise InvalidRegisterType(name)
            setattr(self, name, parse[name](value) if name in parse and isinstance(value, str) else value)
        return self

    def set_transform(self, **parts) -> CountDatabase:
        self.transformation = replace(self.transformation, **parts)
        return self

    def distill(self, name: str) -> DataFrame:
        return distill(self.cells, combine.class_groups(self.metadata, name))

    def distances(self, first: list[tuple[str, str]], second: list[tuple[str, str]]) -> DataFrame:
        a, b = (select.select_matching(self.labels(), p, self.metadata) for p in (first, second))
        return distances.spectral_distances(self.cells, a, b, self.distance, self.distance_normalise)

    def exported(self) -> DataFrame:
        """(label, kmer, value): transformed counts without the filtered labels and, unless asked for, all-zero k-mers."""
        cells = self.cells if self.zero_kmers else self.cells.join(select.nonzero_kmers(self.cells, self.transformation.threshold, self.transformation.power), "kmer", "left_semi")
        values = transform_counts(cells.select("label", "kmer", "count"), self.transformation)
        return values if self.excluded is None else select.remove_selected(values, self.excluded)

    def write_spectra(self, path: str) -> CountDatabase:
        tables.write_spectra(self.exported(), path, self.precision)
        return self

    def table_lines(self) -> DataFrame:
        """(part, name, line) of the dense table with the options that are set; what isn't stored has the transformed value of 0."""
        values = self.exported()
        zeros = zero_values(self.cells, self.transformation) if self.transformation.which == "clr" else None
        return tables.dense_lines(values, zeros, self.metadata if self.with_metadata else None, self.transposed, self.row_names, self.column_names, self.precision)

    def write_table(self, path: str) -> CountDatabase:
        tables.write_dense_table(self.table_lines(), path)
        return self

    def write_distill(self, name: str, path: str) -> CountDatabase:
        tables.write_distill(self.distill(name), path, self.precision)
        return self

    def selected(self) -> list[str]:
        """The labels of the selection in order, for display."""
        return [r["label"] for r in self.selection.orderBy("label").collect()]

    def summary(self, verbose: bool = False) -> DataFrame:
        return tables.database_listing(self.cells, self.metadata) if verbose else tables.database_summary(self.cells, self.metadata)

    def fit(self, normalise: bool = True, keep: DataFrame | str | None = None, sample: float | None = None, threshold: float | None = None, seed: int = 0) -> Twister:
        """Twister of the exported counts: only k-mers of ``keep`` (a frame or a file), then a share of them drawn by ``seed``, then those of at least ``threshold`` of the greatest sum."""
        values = self.exported()
        if keep is not None:
            values = keep_kmers(values, tables.read_keep_list(self.spark, keep) if isinstance(keep, str) else keep)
        if sample is not None:
            values = sample_kmers(values, sample, seed)
        if threshold is not None:
            values = threshold_kmers(values, threshold)
        return fit_twister(values, normalise)


OPTIONS = ("criterion", "distance", "distance_normalise", "transformation", "zero_kmers", "row_names", "column_names", "with_metadata", "transposed", "precision")


def count_to_spectra(sequences: DataFrame, path: str, k: int = 12, content: str = "DNA-ds", label: str | None = None, names: str = "hex") -> None:
    """Spectra text of sequences (tag, seq): one spectrum for each tag, or one named ``label``. DNA k-mers are named by their hexadecimal code unless ``names`` is "letters"; protein ones always by their letters."""
    cells = count_kmers(sequences, k, content, label)
    if names == "hex" and content != "protein":
        cells = cells.withColumn("kmer", hash_hex(F.col("kmer")))
    tables.write_spectra(cells, path)


REGISTERS = ("twister", "twisted", "vectors", "distances", "splits")


@dataclass
class VectorDatabase:
    """Registers for a twister, projected vectors, embeddings, distances and splits."""

    spark: SparkSession
    twister: DataFrame | None = None
    inertia: DataFrame | None = None
    twisted: DataFrame | None = None
    vectors: DataFrame | None = None
    distances: DataFrame | None = None
    splits: DataFrame | None = None
    normalise_kmers: bool = True
    distance: Distance = field(default_factory=Distance)
    distance_normalise: bool = True
    metric: Metric = field(default_factory=Metric)
    algorithm: str = "gaps"
    keep_splits: int | str = 10_000
    keep: int | str = 2

    def _named(self, name: str) -> str:
        if name not in REGISTERS:
            raise InvalidRegisterType(name)
        return name

    def empty(self, name: str) -> VectorDatabase:
        setattr(self, self._named(name), None)
        if name == "twister":
            self.inertia = None
        return self

    def load(self, name: str, path: str) -> VectorDatabase:
        if self._named(name) == "twister":
            self.twister, self.inertia = tables.read_twister(self.spark, path)
        else:
            setattr(self, name, tables.read_archive(self.spark, path, name)[name])
        return self

    def add(self, name: str, path: str) -> VectorDatabase:
        """Rows of another archive of the same kind, appended to the register."""
        if name not in ("twisted", "vectors"):
            raise UnexpectedType(name)
        more, now = tables.read_archive(self.spark, path, name)[name], getattr(self, name)
        setattr(self, name, more if now is None else merge_rows(now, more))
        return self

    def load_table(self, name: str, path: str) -> VectorDatabase:
        """A register from text tables; for the twister ``path`` is the prefix of its two files."""
        if self._named(name) == "twister":
            self.twister, self.inertia = tables.read_twister_text(self.spark, path)
        elif name in ("twisted", "vectors"):
            setattr(self, name, tables.read_matrix(self.spark, path))
        elif name == "distances":
            names = self.spark.createDataFrame(list(enumerate(tables.read_matrix_names(self.spark, path))), "at int, col_label string")
            each = tables.read_matrix(self.spark, path).select(F.col("label").alias("row_label"), F.posexplode("coords").alias("at", "distance"))
            self.distances = each.join(F.broadcast(names), "at").select("row_label", "col_label", "distance")
        else:
            raise UnexpectedType(name)
        return self

    def add_table(self, name: str, path: str) -> VectorDatabase:
        """Rows of a text table, appended to the register."""
        if name not in ("twisted", "vectors"):
            raise UnexpectedType(name)
        more, now = tables.read_matrix(self.spark, path), getattr(self, name)
        setattr(self, name, more if now is None else merge_rows(now, more))
        return self

    def save_table(self, name: str, path: str, precision: int | None = None) -> VectorDatabase:
        """A register as text tables with 15 digits, splits with 10; "metrics" writes the weights of the dimensions."""
        if name == "metrics":
            weights = self.metrics().orderBy("dim").collect()
            frame = self.spark.createDataFrame([("metrics", [r["weight"] for r in weights])], "label string, coords array<double>")
            tables.write_matrix(frame, path, [r["name"] for r in weights], precision or 15)
        elif self._named(name) == "twister":
            tables.write_twister_text(self._need("twister"), self._need("inertia"), path, precision or 15)
        elif name == "splits":
            members = splits.member_ranges(self._need("vectors"), self._need("splits")) if "members" not in self._need("splits").columns else None
            tables.write_splits(self.splits, path, members, precision or 10)
        elif name == "distances":
            rows, columns = tables.dense_rows(self._need("distances").select(F.col("col_label").alias("label"), F.col("row_label").alias("kmer"), F.col("distance").alias("value")))
            tables.write_matrix(rows.select(F.col("name").alias("label"), F.col("cells").alias("coords")), path, [r["name"] for r in columns.orderBy("at").collect()], precision or 15)
        else:
            dims = self._need(name).select(F.max(F.size("coords"))).first()[0] or 0
            tables.write_matrix(self._need(name), path, [f"Dim{i + 1}" for i in range(dims)], precision or 15)
        return self

    def save(self, name: str, path: str) -> VectorDatabase:
        if self._named(name) == "twister":
            tables.write_twister(self.twister, self.inertia, path)
        else:
            tables.write_archive({name: getattr(self, name)}, name, path)
        return self

    def fitted(self, model: Twister) -> VectorDatabase:
        self.twister, self.inertia, self.twisted = model.twister, model.inertia, model.twisted
        return self

    def dims(self) -> int:
        return self._need("inertia").count()

    def _need(self, name: str) -> DataFrame:
        frame = getattr(self, name)
        if frame is None:
            raise InvalidRegisterType(f"{name} is empty")
        return frame

    def weights(self) -> list[float]:
        return embeddings.metric_vector(self._need("inertia"), self.metric)

    def add_spectra(self, cells: DataFrame | str) -> VectorDatabase:
        values = tables.read_spectra(self.spark, cells, decimals=True) if isinstance(cells, str) else cells
        self.twisted = project(values, self._need("twister"), self.dims(), self.normalise_kmers, self.twisted)
        return self

    def set(self, **options) -> VectorDatabase:
        parse = {"distance": Distance.parse, "metric": Metric.parse, "algorithm": splits.parse_algorithm}
        for name, value in options.items():
            if name not in ("normalise_kmers", "distance", "distance_normalise", "metric", "algorithm", "keep_splits", "keep"):
                raise InvalidRegisterType(name)
            setattr(self, name, parse[name](value) if name in parse and isinstance(value, str) else value)
        return self

    def embed(self) -> VectorDatabase:
        self.vectors = embeddings.embed(self._need("twisted"), self.weights(), self.distance, self.distance_normalise)
        return self

    def split(self, seed: int = 0) -> VectorDatabase:
        self.splits = splits.gaps(self._need("vectors"), self.keep_splits) if self.algorithm == "gaps" else splits.centroids(self._need("vectors"), seed)
        return self

    def distances_from(self, columns: DataFrame) -> VectorDatabase:
        self.distances = distances.cross_distances(self._need("twisted"), columns, self.weights(), self.distance, self.distance_normalise)
        return self

    def summary_from(self, columns: DataFrame) -> DataFrame:
        return distances.summarise_rowwise(self._need("twisted"), columns, self.weights(), self.distance, self.distance_normalise, self.keep)

    def summary(self) -> DataFrame:
        return distances.summarise_distances(self._need("distances"), self.keep)

    def metrics(self) -> DataFrame:
        return embeddings.metric_table(self._need("inertia"), self.metric)
