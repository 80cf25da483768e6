"""Loading of spectra lines, with the lines that fail set aside and told why.

Every distinct value of a column is cast once; what can't be cast makes a dictionary of
invalid values with reasons, which is joined back to the lines beside the structural checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralmill.operators.carry import carry_forward
from spectralmill.operators.skew import HOT_KEYS, join_margins
from spectralmill.scratch import Scratch

KMER = r"\A[ACGTacgt]{12}\z"
NUMBER = r"\A[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
MOST = 2147483647


def _unquoted(field: Column) -> Column:
    pair = (F.length(field) >= 2) & field.startswith('"') & field.endswith('"')
    return F.when(pair, field.substr(F.lit(2), F.length(field) - 2)).otherwise(field)


def split_lines(lines: DataFrame) -> DataFrame:
    """line_id, file_name, line_no, name, v and ``structure``, the structural reason to fail or null."""
    body = F.when(F.col("line").endswith("\r"), F.col("line").substr(F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    fields = F.split(body, "\t", -1)
    cut = lines.select("line_id", "file_name", "line_no", fields.alias("_f"))
    two = F.coalesce(F.size("_f") == 2, F.lit(False))
    cut = cut.withColumn("_two", two).withColumns({"name": F.when(F.col("_two"), _unquoted(F.col("_f")[0])), "v": F.when(F.col("_two"), _unquoted(F.col("_f")[1]))})
    structure = F.when(~F.col("_two"), "columns").when(F.col("name").contains('"') | F.col("v").contains('"'), "quoting").when((F.col("line_no") == 1) & (F.col("name") != ""), "header")
    return cut.select("line_id", "file_name", "line_no", "name", "v", structure.alias("structure"))


def value_dictionary(values: DataFrame) -> DataFrame:
    """(column, value, n, number, reason): every distinct value once, its number if it has one, and why it is invalid or null."""
    distinct = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    number = F.when((F.col("column") == "v") & F.col("value").rlike(NUMBER), F.col("value").try_cast("double"))
    reason = (
        F.when((F.col("column") == "name") & (F.col("value") != "") & ~F.col("value").rlike(KMER), "name")
        .when((F.col("column") == "label") & (F.col("value") == ""), "value")
        .when((F.col("column") == "v") & (F.col("number").isNull() | (F.col("number") > MOST)), "value")
    )
    return distinct.withColumn("number", number).withColumn("reason", reason)


def _checked(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split lines that are written once, each with the keys (column, value) of its values, and the dictionary of all values, written once too."""
    scratch = Scratch(lines.sparkSession, "lines")
    column = F.when(F.col("name") == "", "label").otherwise("v")
    sound = F.col("structure").isNull()
    split = split_lines(lines).withColumns({
        "_name": F.when(sound, F.struct(F.lit("name").alias("column"), F.col("name").alias("value"))),
        "_v": F.when(sound, F.struct(column.alias("column"), F.col("v").alias("value"))),
    })
    split = scratch.save(split)
    values = split.where("structure is null").select(F.explode(F.array("_name", "_v")).alias("x")).select("x.*")
    return split, scratch.save(value_dictionary(values))


def _judge(split: DataFrame, names: DataFrame, others: DataFrame) -> DataFrame:
    """Adds ``reason``, given the reasons of names and of other values; a value without entry is valid."""
    names = names.select(F.struct("column", "value").alias("_name"), "n", F.col("reason").alias("_bad_name"))
    others = others.select(F.struct("column", "value").alias("_v"), "n", "number", F.col("reason").alias("_bad_v"))
    joined = join_margins(join_margins(split, names, "_name", "n", "left").drop("n"), others, "_v", "n", "left")
    return joined.select("line_id", "file_name", "line_no", "name", "v", "number", F.coalesce("structure", "_bad_name", "_bad_v").alias("reason"))


def check_lines(lines: DataFrame) -> DataFrame:
    """Every line with name, v, number and ``reason``, the first reason to fail or null.

    ``lines`` has line_id, file_name, line_no and line; other columns are ignored. The
    reasons, in order: columns (null, or not two tab-separated fields), quoting (a double
    quote left after one pair around a field), header (a first line that starts no spectrum),
    name (neither empty nor 12 of the letters ACGT), value (a spectrum without label, or a
    k-mer whose value is no plain number up to 2147483647). One trailing carriage return is
    no part of a line. Lines with equal ids are judged one by one.
    """
    split, known = _checked(lines)
    return _judge(split, _entries(known, "column = 'name'"), known.where("column <> 'name'"))


def _entries(known: DataFrame, which: str) -> DataFrame:
    """The invalid values, and those so frequent that a join has to know them; all others are valid if they are missing."""
    frequent = F.col("n") * HOT_KEYS > known.agg(F.sum("n")).scalar() / 2  # every line has two values
    return known.where(which).where(F.col("reason").isNotNull() | frequent)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the lines that fail; see ``check_lines``. Only invalid values are joined back."""
    split, known = _checked(lines)
    return _judge(split, _entries(known, "column = 'name'"), _entries(known, "column <> 'name'")).where("reason is not null").select("line_id", "reason")


def load_lines(lines: DataFrame) -> DataFrame:
    """(file_name, line_no, label, name, v) of the valid k-mer lines.

    label is that of the last line before in the file whose first field is empty; null if
    that line is not valid or there is none, so that counts never go to a wrong spectrum.
    """
    checked = check_lines(lines)
    starts = F.when(F.col("name") == "", F.struct(F.when(F.col("reason").isNull(), F.col("v")).alias("label")))
    carried = carry_forward(checked, "file_name", "line_no", starts, "_head")
    return carried.where("reason is null and name <> ''").select("file_name", "line_no", F.col("_head.label").alias("label"), F.upper("name").alias("name"), F.col("number").alias("v"))
