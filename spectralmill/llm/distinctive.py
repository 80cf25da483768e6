"""How distinctive a term is for a record: correspondence-analysis residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.operators.skew import join_margins
from spectralmill.scratch import Scratch


def distinctive_terms(cells: DataFrame, record: str = "record", term: str = "term", weight: str = "weight") -> DataFrame:
    """Score every (record, term) of a contingency table against independence.

    ``cells`` has one row for each record and term with a positive weight; other columns are
    ignored. Rows with a null record or term, or a weight that is null or not positive, are
    left out. Result: record, term, weight, record_total, terms, term_total, holders,
    records, grand_total, expected, residual, adjusted_residual.

    expected = record_total * term_total / grand_total; residual = (weight - expected) /
    sqrt(expected), the entry of the matrix that correspondence analysis decomposes times
    sqrt(grand_total); adjusted_residual divides it by sqrt((1 - row mass) (1 - column mass))
    and is null where a margin is the whole table. An empty table gives an empty result.
    """
    rows = cells.select(F.col(record).alias("record"), F.col(term).alias("term"), F.col(weight).alias("weight")).where("record is not null and term is not null and weight > 0")
    of_record = rows.groupBy("record").agg(F.sum("weight").alias("record_total"), F.count("*").alias("terms"))
    of_term = rows.groupBy("term").agg(F.sum("weight").alias("term_total"), F.count("*").alias("holders"))
    of_record = Scratch(cells.sparkSession, "distinctive").save(of_record)
    whole = of_record.agg(F.sum("record_total").alias("n"), F.count("*").alias("records")).first()
    grand, records = F.lit(whole["n"]), F.lit(whole["records"])
    joined = join_margins(join_margins(rows, of_record, "record", "terms"), of_term, "term", "holders")
    n = F.col("grand_total").cast("double")
    row_mass, column_mass = F.col("record_total") / n, F.col("term_total") / n
    return (
        joined.withColumns({"grand_total": grand, "records": records})
        .withColumn("expected", F.col("record_total") * column_mass)
        .withColumn("residual", (F.col("weight") - F.col("expected")) / F.sqrt("expected"))
        .withColumn("adjusted_residual", F.try_divide(F.col("residual"), F.sqrt(F.greatest(F.lit(0.0), (1 - row_mass) * (1 - column_mass)))))
        .select("record", "term", "weight", "record_total", "terms", "term_total", "holders", "records", "grand_total", "expected", "residual", "adjusted_residual")
    )
