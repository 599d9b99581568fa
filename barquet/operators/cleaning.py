"""Row filters that make a price or feature panel trustworthy."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, FEATURE_COLUMNS, PRICE_COLUMNS
from barquet.functions.predicates import not_nan, ratio
from barquet.schemas import PRICES, conform, require
from barquet.sources.sinks import unique_rows

KEY = ("symbol", "trade_date")


def valid_candles(bars: DataFrame) -> DataFrame:
    """Possible candles only, one per symbol and day.

    Broken rows go first, so a broken copy never displaces a good bar.
    """
    o, h, l, c, v = (
        F.col(n) for n in ("open_price", "high_price", "low_price", "close_price", "volume")
    )
    rows = conform(require(bars, PRICE_COLUMNS), PRICES)
    rows = rows.withColumns(
        {n: not_nan(F.col(n)) for n in ("open_price", "high_price", "low_price", "close_price")}
    ).dropna(subset=list(PRICE_COLUMNS))
    rows = rows.filter(
        (o > 0) & (h > 0) & (l > 0) & (c > 0) & (v >= 0)
        & (h >= l) & (h >= o) & (h >= c) & (l <= o) & (l <= c)
    )
    return unique_rows(rows, KEY)


def plausible_bars(bars: DataFrame) -> DataFrame:
    """Ingest filter: possible prices and no split-like day move."""
    rows = require(bars, PRICE_COLUMNS).dropna(
        subset=[c for c in PRICE_COLUMNS if c != "symbol"]
    )
    move = F.abs(ratio(F.col("close_price"), F.col("open_price")))
    rows = rows.filter(
        (F.col("high_price") >= F.col("low_price"))
        & (F.col("open_price") > 0) & (F.col("close_price") > 0)
        & (F.col("volume") >= 0)
        & (move < DEFAULTS.cleaning.max_daily_move_ratio)
    )
    return unique_rows(rows, KEY)


def without_volume_spikes(bars: DataFrame) -> DataFrame:
    """Drop volumes far above the symbol's median.

    The exact median needs a symbol's volumes together; the unique panel key
    bounds them by one per calendar day. As a window the panel is shuffled once
    on symbol, where a join with a median table would read it twice.
    """
    limit = DEFAULTS.cleaning.max_volume_multiplier
    median = F.percentile(F.col("volume"), F.lit(0.5)).over(Window.partitionBy("symbol"))
    return (
        bars.withColumn("__median", median)
        .filter(
            (F.col("__median") <= 0) | (F.col("volume") < F.col("__median") * limit)
        )
        .select(*bars.columns)
    )


def valid_features(features: DataFrame) -> DataFrame:
    """Feature rows fit for signals: numeric, keyed, with a close."""
    numeric = [c for c in FEATURE_COLUMNS if c not in KEY]
    rows = require(features, ("symbol", "trade_date", "close_price"))
    rows = rows.withColumns(
        {c: F.col(c).try_cast("double") if dict(rows.dtypes)[c] == "string" else F.col(c)
         for c in numeric if c in rows.columns}
    )
    return unique_rows(rows.dropna(subset=["symbol", "trade_date", "close_price"]), KEY)


def valid_price_action_rows(rows: DataFrame) -> DataFrame:
    return unique_rows(
        rows.dropna(subset=[*KEY, "close_price", "ema_50", "relative_volume"]), KEY
    )


def valid_timeframe_rows(rows: DataFrame) -> DataFrame:
    return unique_rows(rows.dropna(subset=[*KEY, "close_price"]), KEY)


def usable_earnings_dates(raw: DataFrame, as_of: date) -> DataFrame:
    """Calendar day of each announcement, far-future estimates dropped."""
    limit = F.date_add(F.lit(as_of), DEFAULTS.staleness.earnings_max_future_days)
    return (
        raw.withColumn("earnings_date", F.to_date("earnings_date"))
        .filter(F.col("earnings_date") <= limit)
    )
