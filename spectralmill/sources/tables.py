"""Readers and writers of spectra, metadata, matrices and archives."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralmill.errors import DuplicateField, IncompatibleArchiveVersion, MismatchedTwisterFiles, UnexpectedType, UnknownType
from spectralmill.functions.cleaning import clean_label
from spectralmill.operators.blocks import number_rows

VERSION = "1"
#: fixed values: the types of matrices
MATRIX_TYPES = ("distill", "twister", "inertia", "metrics", "twisted", "vectors", "dmatrix")


def path_of(prefix: str, suffix: str, family: str = "") -> str:
    """Prefix with suffix, the suffix led by ``family`` where files carry a tool's name; device files are taken as they are."""
    return prefix if prefix.startswith("/dev/") else f"{prefix}.{family}{suffix}"


def read_spectra(spark: SparkSession, paths: str | list[str], decimals: bool = False) -> DataFrame:
    """(label, kmer, count) of spectra text files; repeats of a label and k-mer add up.

    A spectrum starts with a tab and its label; files are split between spectra by Spark.
    Lines before the first header, and lines without a valid count, raise when they are read;
    to set such lines aside instead use ``load_lines``.
    """
    blocks = spark.read.option("lineSep", "\n\t").text(paths)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    headed = blocks.select(lines.alias("_l"), F.col("value").startswith("\t").alias("_first"), F.regexp_extract("value", r"\A([^\t\n]*\t[^\n]*)\n?", 1).alias("_bad"))
    # in the first block of a file the header's tab is still there; in later ones the separator took it
    head = F.regexp_replace(F.col("_l")[0], r"\A\t", "")
    wrong = ~F.col("_first") & (F.col("_bad") != "")
    body = F.when(wrong, F.raise_error(F.concat(F.lit("header expected: "), F.col("_bad")))).otherwise(F.slice("_l", 2, F.greatest(F.lit(0), F.size("_l") - 1)))
    rows = headed.select(clean_label(head).alias("label"), F.explode(body).alias("line")).where("line <> ''")
    fields = F.split("line", "\t", -1)
    pattern = r"\A[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z" if decimals else r"\A[0-9]{1,10}\z"
    sound = (F.size(fields) == 2) & F.get(fields, F.lit(1)).rlike(pattern)
    value = F.when(sound, F.get(fields, F.lit(1)).cast("double" if decimals else "bigint")).otherwise(F.raise_error(F.concat(F.lit("wrong format: "), F.col("line"))))
    return rows.select("label", clean_label(fields[0]).alias("kmer"), value.alias("count")).groupBy("label", "kmer").agg(F.sum("count").alias("count"))


def _numbers(values: list, precision: int) -> list[str]:
    return ["" if v is None else f"{v:.{precision}g}" for v in values]


def format_rows(rows: DataFrame, precision: int = 15, names: bool = True, quoted: bool = False) -> DataFrame:
    """(line) of rows (name, cells): the name, unless left out, and the numbers with ``precision`` significant digits, separated by tabs. Order is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for name, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head = [f'"{name}"' if quoted else name] if names else []
                lines.append("\t".join(head + _numbers(cells, precision)))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    return rows.select("name", F.col("cells").cast("array<double>").alias("cells")).mapInArrow(run, "line string")


def write_spectra(cells: DataFrame, path: str, precision: int = 15) -> None:
    """Spectra text, sorted by label and k-mer, only positive values; cells with null label or k-mer are left out.

    The rows are range-partitioned and written as they come, so no spectrum is held in
    memory; one that goes on in a next file has its header there again, and readers add up.
    """
    value = "count" if "count" in cells.columns else "value"
    whole = dict(cells.dtypes)[value] in ("bigint", "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            lines = []
            for label, kmer, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if label != last:
                    lines.append(f"\t{label}")
                    last = label
                lines.append(f"{kmer}\t{v if whole else format(v, f'.{precision}g')}")
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    rows = cells.where(F.col("label").isNotNull() & F.col("kmer").isNotNull() & (F.col(value) > 0)).select("label", "kmer", value)
    rows.repartitionByRange("label", "kmer").sortWithinPartitions("label", "kmer").mapInArrow(run, "value string").write.text(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata: first column label, other columns text named by the header; a row of another width raises. Repeated fields are refused."""
    head = spark.read.text(path).first()
    names = [n.strip().removeprefix('"').removesuffix('"') for n in head[0].rstrip("\r").split("\t")] if head else ["label"]
    if len(set(names[1:])) != len(names) - 1:
        raise DuplicateField(", ".join(names[1:]))
    schema = ", ".join(["label string", *(f"`{n}` string" for n in names[1:])])
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', schema=schema, mode="FAILFAST", enforceSchema=True, ignoreLeadingWhiteSpace=False)
    return rows.select(clean_label(F.col("label")).alias("label"), *(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names[1:]))


def add_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels and fields of both; where both have a value the new one stands, missing ones are empty."""
    fields = list(dict.fromkeys([*old.columns, *new.columns]))
    fields.remove("label")
    joined = old.alias("o").join(new.alias("n"), "label", "full_outer")
    pick = lambda f: F.coalesce(*([F.col(f"n.`{f}`")] if f in new.columns else []), *([F.col(f"o.`{f}`")] if f in old.columns else []), F.lit(""))
    return joined.select("label", *(pick(f).alias(f) for f in fields))


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.csv(path, sep="\t", header=True, quote='"')


def _fields(line: Column) -> Column:
    return F.split(F.regexp_replace(line, "\r", ""), "\t", -1)


def _matrix_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header names (at, name), from 0, and rows (label, fields) of a table; lines of another width, or fields that are no numbers, raise when they are read."""
    lines = spark.read.text(path).where("value <> ''")
    heads = lines.where(F.col("value").startswith('""\t') | (F.col("value") == '""')).select(_fields(F.col("value")).alias("f"))
    names = heads.limit(1).select(F.posexplode(F.slice("f", 2, F.greatest(F.lit(0), F.size("f") - 1))).alias("at", "n")).select("at", clean_label(F.col("n")).alias("name"))
    width = heads.limit(1).select(F.size("f").alias("_w"))
    rows = lines.where(~(F.col("value").startswith('""\t') | (F.col("value") == '""'))).select(_fields(F.col("value")).alias("f")).join(F.broadcast(width), F.lit(True))  # one row
    number = lambda x: F.coalesce(x.try_cast("double"), F.when(x.isNotNull(), F.raise_error(F.concat(F.lit("FloatExpected: "), x)).cast("double")))
    body = F.when(F.size("f") != F.col("_w"), F.raise_error(F.concat(F.lit("WrongNumberOfColumns: "), F.col("f")[0])).cast("array<string>")).otherwise(F.slice("f", 2, F.greatest(F.lit(0), F.size("f") - 1)))
    return names, rows.select(clean_label(F.col("f")[0]).alias("label"), F.transform(body, number).alias("coords"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(label, coords) from a table with a header of column names and quoted row names; a part file's repeated header is passed over."""
    return _matrix_lines(spark, path)[1]


def read_matrix_names(spark: SparkSession, path: str) -> list[str]:
    """The column names of a table, which are few where columns are dimensions."""
    return [r["name"] for r in _matrix_lines(spark, path)[0].orderBy("at").collect()]


def write_matrix(vectors: DataFrame, path: str, names: list[str], precision: int = 15) -> None:
    """Table of vectors: header of quoted names, quoted row labels, numbers with ``precision`` significant digits; ordered by label.

    A writer's task makes a file of its own, each with the header.
    """
    lines = format_rows(vectors.orderBy("label").select(F.col("label").alias("name"), F.col("coords").alias("cells")), precision, quoted=True)
    header = "\t".join(['""', *(f'"{n}"' for n in names)])
    lines.select(F.col("line").alias(header)).write.option("header", "true").csv(path, sep="\x01", quote="", escapeQuotes=False, emptyValue="", quoteAll=False)


def write_twister_text(twister: DataFrame, inertia: DataFrame, prefix: str, precision: int = 15) -> None:
    """Two tables, <prefix>.Twister.txt with a row for each dimension and a column for each k-mer, and <prefix>.Inertia.txt with one row."""
    numbered = number_rows(twister.select(F.col("kmer").alias("label")))
    top = numbered.agg(F.max("at")).first()[0]
    cells = twister.join(numbered.withColumnRenamed("label", "kmer"), "kmer").select("at", F.posexplode("weights").alias("dim", "value"))
    dims = inertia.select((F.col("dim") - 1).alias("dim"), "name")
    head = numbered.agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("h")).select(F.lit(-1).alias("dim"), F.concat_ws("\t", F.lit('""'), F.array_join(F.transform("h", lambda x: F.concat(F.lit('"'), x["label"], F.lit('"'))), "\t")).alias("line"))
    rows = cells.join(dims, "dim").groupBy("dim", "name").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("c"))  # a line of the table holds a value of every k-mer
    body = format_rows(rows.orderBy("dim").select("name", F.transform("c", lambda x: x["value"]).alias("cells")), precision, quoted=True)
    if top is not None:
        head.select(F.col("line").alias("value")).unionByName(body.select(F.col("line").alias("value"))).coalesce(1).write.text(path_of(prefix, "Twister.txt"))
    write_matrix(inertia.groupBy(F.lit("inertia").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("coords")), path_of(prefix, "Inertia.txt"), [r["name"] for r in inertia.orderBy("dim").collect()], precision)


def read_twister_text(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(twister, inertia) from two tables; raises if the rows of the one aren't named like the columns of the other."""
    names, rows = _matrix_lines(spark, path_of(prefix, "Twister.txt"))
    dims = read_matrix_names(spark, path_of(prefix, "Inertia.txt"))
    if sorted(r["label"] for r in rows.select("label").collect()) != sorted(dims):
        raise MismatchedTwisterFiles(f"{prefix}: dimensions are named differently")
    place = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(dims)], "label string, dim int"))
    cells = rows.join(place, "label").select("dim", F.posexplode("coords").alias("at", "value")).join(names, "at")
    twister = cells.groupBy(F.col("name").alias("kmer")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("weights"))
    values = read_matrix(spark, path_of(prefix, "Inertia.txt")).select(F.posexplode("coords").alias("dim", "value")).join(place.withColumnRenamed("label", "name"), "dim")
    return twister, values.select((F.col("dim") + 1).alias("dim"), "name", "value")


def write_archive(frames: dict[str, DataFrame], kind: str, path: str, notes: dict | None = None) -> None:
    """Parquet tables of one object with a manifest of kind, version and names."""
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}")
    spark = next(iter(frames.values())).sparkSession
    manifest = json.dumps({"kind": kind, "version": VERSION, "tables": sorted(frames), **(notes or {})})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_archive(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["version"] != VERSION:
        raise IncompatibleArchiveVersion(manifest["version"])
    if manifest["kind"] != kind:
        raise UnexpectedType(f"{manifest['kind']} instead of {kind}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def matrix_type(name: str) -> str:
    if name not in MATRIX_TYPES:
        raise UnknownType(name)
    return name


def write_twister(twister: DataFrame, inertia: DataFrame, path: str) -> None:
    write_archive({"twister": twister, "inertia": inertia}, "twister", path)


def read_twister(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(twister, inertia); raises if they have different dimensions."""
    tables = read_archive(spark, path, "twister")
    first = tables["twister"].select(F.size("weights").alias("n")).first()
    if first is not None and first["n"] != tables["inertia"].count():
        raise MismatchedTwisterFiles(f"{first['n']} and {tables['inertia'].count()} dimensions")
    return tables["twister"], tables["inertia"]


def read_keep_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.btrim("value", F.lit(" \t\r")).alias("kmer")).where("kmer <> ''").distinct()


def summary_lines(summaries: DataFrame, precision: int = 15) -> DataFrame:
    """(line) of neighbour summaries in label order: label, mean, deviation, median, MAD, then label, distance and z of each neighbour; a z that is null is nan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for row in batch.to_pylist():
                fields = [row["label"], *_numbers([row[c] for c in ("mean", "stddev", "median", "mad")], precision)]
                for n in row["neighbours"]:
                    fields += [n["label"], *_numbers([n["distance"], float("nan") if n["z"] is None else n["z"]], precision)]
                lines.append("\t".join(fields))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    return summaries.orderBy("label").select("label", "mean", "stddev", "median", "mad", "neighbours").mapInArrow(run, "line string")


def write_summary(summaries: DataFrame, path: str, precision: int = 15) -> None:
    summary_lines(summaries, precision).write.text(path)


def split_lines_of(splits: DataFrame, members: DataFrame | None = None, precision: int = 10) -> DataFrame:
    """(line) of splits: number, weight with ``precision`` digits, and the members' labels.

    Gap splits have gap, dim and position; their ``members`` (dim, position, label), see
    ``member_ranges``, are those of the dimension up to the position. Centroid splits hold
    weight and members themselves. A line holds all members of its split.
    """
    if members is not None:
        held = splits.join(members.select("dim", F.col("position").alias("_at"), "label"), "dim").where(F.col("_at") <= F.col("position"))
        splits = held.groupBy("split_id", F.col("gap").alias("weight")).agg(F.array_sort(F.collect_list("label")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("split_id", "weight", "members")))
            yield pa.RecordBatch.from_arrays([pa.array(["\t".join([str(i), *_numbers([w], precision), *m]) for i, w, m in rows], pa.string())], names=["line"])

    return splits.select("split_id", "weight", "members").mapInArrow(run, "line string")


def write_splits(splits: DataFrame, path: str, members: DataFrame | None = None, precision: int = 10) -> None:
    split_lines_of(splits, members, precision).write.text(path)


def write_distill(table: DataFrame, path: str, precision: int = 15) -> None:
    """Distill table as a matrix: k-mers as rows, statistics as columns."""
    names = [c for c in table.columns if c != "kmer"]
    write_matrix(table.select(F.col("kmer").alias("label"), F.array(*names).alias("coords")), path, names, precision)


def counts_table(cells: DataFrame, value: str, labels: list[str], transposed: bool = False, kmers: list[str] | None = None) -> DataFrame:
    """Dense table: k-mers as rows and the given labels as columns, or the reverse with the given k-mers; missing counts are 0."""
    if transposed:
        return cells.groupBy("label").pivot("kmer", kmers).agg(F.sum(value)).fillna(0)
    return cells.groupBy("kmer").pivot("label", labels).agg(F.sum(value)).fillna(0)


def dense_rows(values: DataFrame, zeros: DataFrame | None = None, transposed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (name, cells) of the dense table of values (label, kmer, value), and its columns (name, at).

    Rows are k-mers and columns labels, or the reverse; both are in order of their names.
    ``zeros`` (label, value) says what a count of 0 becomes for each label, else it is 0. A
    row is one value for each column, as the table asks for; nothing is collected.
    """
    row, column = ("label", "kmer") if transposed else ("kmer", "label")
    columns = number_rows(values.select(F.col(column).alias("label"))).select(F.col("label").alias(column), "at")
    placed = values.join(columns, column).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("_m"))
    width = columns.agg(F.count("*").alias("_w"))
    if zeros is None:
        filled = placed.join(F.broadcast(width), F.lit(True)).withColumn("_z", F.array_repeat(F.lit(0.0), F.col("_w").cast("int")))
    elif transposed:
        filled = placed.join(zeros.select("label", F.col("value").alias("_one")), "label").join(F.broadcast(width), F.lit(True)).withColumn("_z", F.array_repeat("_one", F.col("_w").cast("int")))
    else:
        one = zeros.join(columns, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("_z"))  # one value for each column
        filled = placed.join(F.broadcast(one), F.lit(True))
    cells = F.transform("_z", lambda z, i: F.coalesce(F.element_at("_m", i.cast("bigint")), z))
    return filled.select(F.col(row).alias("name"), cells.alias("cells")), columns.select(F.col(column).alias("name"), "at")


def dense_lines(values: DataFrame, zeros: DataFrame | None = None, metadata: DataFrame | None = None, transposed: bool = False, row_names: bool = True, column_names: bool = True, precision: int = 15) -> DataFrame:
    """(part, name, line) of the dense table as text: header (part 0), metadata rows (part 1), table rows (part 2), each part in order of name.

    With k-mers as rows, metadata come as a row for each field before them; transposed, as a
    column for each field before the counts. Row names and the header can be left out.
    """
    rows, columns = dense_rows(values, zeros, transposed)
    fields = [] if metadata is None else [c for c in metadata.columns if c != "label"]
    head = columns.agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("h")).select(F.transform("h", lambda x: x["name"]).alias("h"))
    out = []
    if column_names:
        names = F.concat(F.array(*(F.lit(f) for f in fields)).cast("array<string>"), "h") if transposed else F.col("h")
        out.append(head.select(F.lit(0).alias("part"), F.lit("").alias("name"), F.array_join(F.concat(F.array(F.lit("")), names) if row_names else names, "\t").alias("line")))
    if fields and not transposed:
        described = metadata.select(F.col("label").alias("_l"), F.array(*(F.struct(F.lit(f).alias("f"), F.coalesce(F.col(f"`{f}`"), F.lit("")).alias("v")) for f in fields)).alias("_x"))
        none = F.array(*(F.struct(F.lit(f).alias("f"), F.lit("").alias("v")) for f in fields))
        known = columns.join(described, F.col("name") == F.col("_l"), "left")
        of_field = known.select("at", F.explode(F.coalesce("_x", none)).alias("x")).groupBy(F.col("x.f").alias("name")).agg(F.array_sort(F.collect_list(F.struct("at", F.col("x.v").alias("v")))).alias("c"))
        values_of = F.transform("c", lambda x: x["v"])
        out.append(of_field.select(F.lit(1).alias("part"), "name", F.array_join(F.concat(F.array("name"), values_of) if row_names else values_of, "\t").alias("line")))
    texts = format_rows(rows.select(F.to_json(F.struct("name")).alias("name"), "cells"), precision).select(F.split("line", "\t", 2).alias("p"))
    body = texts.select(F.get_json_object(F.col("p")[0], "$.name").alias("name"), F.col("p")[1].alias("cells"))
    if fields and transposed:
        before = F.concat_ws("\t", *(F.coalesce(F.col(f"`{f}`"), F.lit("")) for f in fields))
        body = body.join(metadata.select(F.col("label").alias("_l"), before.alias("_before")), F.col("name") == F.col("_l"), "left").select("name", F.concat(F.coalesce("_before", F.lit("\t" * (len(fields) - 1))), F.lit("\t"), "cells").alias("cells"))
    out.append(body.select(F.lit(2).alias("part"), "name", F.concat_ws("\t", "name", "cells").alias("line") if row_names else F.col("cells").alias("line")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def write_dense_table(lines: DataFrame, path: str) -> None:
    """Text files that together, in order of their names, are the table."""
    lines.orderBy("part", "name").select("line").write.text(path)


def database_summary(cells: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(spectra, kmers, fields): sizes of a count database."""
    fields = [] if metadata is None else [c for c in metadata.columns if c != "label"]
    return cells.agg(F.count_distinct("label").alias("spectra"), F.count_distinct("kmer").alias("kmers")).withColumn("fields", F.lit(",".join(fields)))


def database_listing(cells: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(kind, name): every spectrum, k-mer and metadata field of a count database, each once."""
    fields = [] if metadata is None else [c for c in metadata.columns if c != "label"]
    labels = cells.select("label") if metadata is None else cells.select("label").union(metadata.select("label"))
    parts = [labels.select(F.lit("spectrum").alias("kind"), F.col("label").alias("name")), cells.select(F.lit("kmer").alias("kind"), F.col("kmer").alias("name"))]
    named = parts[0].unionByName(parts[1]).where("name is not null").distinct()
    return named.unionByName(cells.sparkSession.createDataFrame([("field", f) for f in fields], "kind string, name string"))
