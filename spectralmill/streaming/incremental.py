"""Counting of spectra as rows arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spectralmill.functions.cleaning import clean_kmer, clean_label


def stream_counts(spectra: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Streaming (label, kmer, count), to be written in update or complete mode.

    Rows delivered again, equal in label, k-mer, count and batch, count once if they come
    within ``lateness`` of each other by loaded_at; the state kept for that is dropped later.
    """
    rows = spectra.select(clean_label(F.col("label")).alias("label"), clean_kmer(F.col("kmer")).alias("kmer"), "count", "batch", "loaded_at")
    once = rows.where("label is not null and kmer is not null and count > 0").withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["label", "kmer", "count", "batch"])
    return once.groupBy("label", "kmer").agg(F.sum("count").alias("count"))


def start_counts(counts: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write every update as Parquet under ``folder``/batch=N; the last value of a key is that of its greatest batch."""

    def store(part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_counts(updates: DataFrame) -> DataFrame:
    """The current (label, kmer, count) from the stored updates (label, kmer, count, batch)."""
    return updates.groupBy("label", "kmer").agg(F.max_by("count", "batch").alias("count"))
