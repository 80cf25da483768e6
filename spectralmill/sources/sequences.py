"""FASTA and FASTQ readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralmill.errors import MixedInputs, WrongFormat
from spectralmill.operators.order import place_rows

SCHEMA = "tag string, segm int, seq string"


def _tag(header):
    return F.element_at(F.split(F.btrim(header), r"\s+"), 1)


def read_fasta(spark: SparkSession, paths: str | list[str], whole_header: bool = False) -> DataFrame:
    """(tag, segm, seq) of FASTA files, split between records by Spark, so one file is read by many tasks.

    The tag is the first word of the header, or all of it. Lines of a sequence are joined
    without blanks; an empty record is left out. Line ends may be of either kind.
    """
    records = spark.read.option("lineSep", "\n>").text(paths)
    text = F.regexp_replace(F.regexp_replace("value", r"\A>", ""), "\r", "")
    lines = F.split(text, "\n")
    header = lines[0]
    seq = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1)), ""), r"\s", "")
    return records.select((F.btrim(header) if whole_header else _tag(header)).alias("tag"), F.lit(0).alias("segm"), seq.alias("seq")).where((F.length("tag") > 0) | (F.length("seq") > 0))


def read_fastq(spark: SparkSession, paths: str | list[str], segm: int = 0) -> DataFrame:
    """(tag, segm, seq) of FASTQ files of four-line records; the tag is the first word of the header.

    A file is read by many tasks. Each line's number in its file comes from the start of its
    split and its place there, and four lines make a record, because a quality line may
    begin like a header. A file whose lines aren't full records fails when it is read.
    """
    lines = spark.read.text(paths).select(F.regexp_replace("value", "\r", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    placed = place_rows(lines, ["file"], ["split", "id"], "n")
    role = lambda i: F.max(F.when((F.col("n") - 1) % 4 == i, F.col("line")))
    records = placed.groupBy("file", F.floor((F.col("n") - 1) / 4).alias("record")).agg(role(0).alias("h"), role(1).alias("s"), role(2).alias("p"), F.count("*").alias("lines"))
    records = records.where(~((F.col("lines") == 1) & (F.col("h") == "")))  # an empty line at the end
    sound = F.col("h").startswith("@") & F.col("p").startswith("+")
    tag = F.when(sound, _tag(F.substr(F.col("h"), F.lit(2)))).otherwise(F.raise_error(F.concat(F.lit("WrongFormat: no FASTQ record: "), F.col("h"))))
    return records.select(tag.alias("tag"), F.lit(segm).alias("segm"), F.col("s").alias("seq"))


def read_paired_fastq(spark: SparkSession, first: str | list[str], second: str | list[str]) -> DataFrame:
    """Both segments of paired reads: segm 0 and 1."""
    return read_fastq(spark, first, 0).unionByName(read_fastq(spark, second, 1))


def read_sequences(spark: SparkSession, fasta: list[str] | None = None, single: list[str] | None = None, paired: list[tuple[str, str]] | None = None) -> DataFrame:
    """All inputs of one run; FASTA and FASTQ can't be mixed."""
    if fasta and (single or paired):
        raise MixedInputs("FASTA and FASTQ inputs can't be mixed")
    if fasta:
        return read_fasta(spark, fasta)
    if not single and not paired:
        raise WrongFormat("no input")
    parts = [read_fastq(spark, single)] if single else []
    parts += [read_paired_fastq(spark, a, b) for a, b in paired or []]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def write_fasta(sequences: DataFrame, path: str) -> None:
    """FASTA text of (tag, seq), one line for each sequence; null tags and sequences are empty."""
    empty = F.lit("")
    sequences.select(F.concat(F.lit(">"), F.coalesce("tag", empty), F.lit("\n"), F.coalesce("seq", empty)).alias("value")).write.text(path)


def write_fastq(sequences: DataFrame, path: str) -> None:
    """FASTQ text of (tag, seq) with a quality of I for every base."""
    empty = F.lit("")
    seq = F.coalesce("seq", empty)
    sequences.select(F.concat(F.lit("@"), F.coalesce("tag", empty), F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq))).alias("value")).write.text(path)
