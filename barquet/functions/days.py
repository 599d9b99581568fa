"""Facts with one row per trading day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_day(rows: DataFrame, index_code: str | None = None) -> DataFrame:
    """Rows of one index, so that a join on the date cannot multiply a panel.

    With a code the other indices go. Without one the rows must be of one index: a date
    with several fails the job that reads it, and no job runs before.
    """
    if index_code is not None and "index_code" in rows.columns:
        rows = rows.filter(F.col("index_code") == index_code)
    sides = [c for c in rows.columns if c != "trade_date"]
    whole = F.struct(*sides)
    found = rows.groupBy("trade_date").agg(F.first(whole).alias("__day"), F.count("*").alias("__n"))
    kept = F.when(F.col("__n") == 1, F.col("__day")).otherwise(
        F.raise_error(F.concat(F.lit("several index rows on "), F.col("trade_date").cast("string"), F.lit(": choose one index_code")))
    )
    return found.select("trade_date", kept.alias("__day")).select(
        "trade_date", *(F.col("__day")[c].alias(c) for c in sides)
    ).select(*rows.columns)
