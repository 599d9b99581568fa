"""Incremental ingest: what to fetch next and what is new.

The daily job is a batch that picks up where the stored panel ends. Time is
always a parameter, so a rerun for a past day gives that day's answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, PRICE_COLUMNS
from barquet.sources.sinks import absent_rows


def last_closed_session(now_utc: datetime) -> date:
    """Latest day whose session is over at `now_utc`."""
    r = DEFAULTS.cleaning
    closed = now_utc.replace(
        hour=r.market_close_utc_hour, minute=r.market_close_utc_minute,
        second=0, microsecond=0,
    )
    today = now_utc.date()
    return today if now_utc >= closed else today - timedelta(days=1)


def trusted_date(day: Column, as_of: date) -> Column:
    """A stored last date, or null when it lies in the future."""
    return F.when(day <= F.lit(as_of), day)


def fetch_plan(
    symbols: DataFrame, prices: DataFrame, cutoff: date, as_of: date
) -> DataFrame:
    """Per symbol: full history, the missing tail, or nothing.

    symbol, latest_date, mode (historical / incremental / skip), start_date,
    end_date.
    """
    latest = prices.groupBy("symbol").agg(F.max("trade_date").alias("latest_date"))
    plan = symbols.select("symbol").join(latest, "symbol", "left").withColumn(
        "latest_date", trusted_date(F.col("latest_date"), as_of)
    )
    mode = (
        F.when(F.col("latest_date").isNull(), "historical")
        .when(F.col("latest_date") >= F.lit(cutoff), "skip")
        .otherwise("incremental")
    )
    return plan.withColumn("mode", mode).withColumns(
        {
            "start_date": F.when(
                F.col("mode") == "incremental", F.date_add("latest_date", 1)
            ),
            "end_date": F.when(F.col("mode") != "skip", F.lit(cutoff)),
        }
    )


def closed_bars(bars: DataFrame, cutoff: date) -> DataFrame:
    """Drop bars of a session that has not closed yet."""
    return bars.filter(F.col("trade_date") <= F.lit(cutoff))


def new_bars(
    batch: DataFrame, stored: DataFrame, key: Sequence[str] = ("symbol", "trade_date")
) -> DataFrame:
    """Bars of a batch that are not stored yet; appending them is idempotent."""
    return absent_rows(batch.select(*PRICE_COLUMNS), stored, key)
