"""Weekly and monthly averages and their agreement score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.config import DEFAULTS
from barquet.functions.predicates import all_of, flag
from barquet.functions.windows import (
    asof_backward, ema, month_label, resample_last, series, week_label,
)
from barquet.schemas import require
from barquet.sources.scans import TIMEFRAME_INPUT

C = F.col
TIMEFRAME_COLUMNS = (
    "symbol", "trade_date", "mtf_w_ema_fast", "mtf_w_ema_slow", "mtf_m_ema_fast",
    "mtf_m_ema_slow", "mtf_weekly_trend", "mtf_monthly_trend", "mtf_score",
)


def period_averages(
    df: DataFrame, label: Column, end: str, fast: int, slow: int, min_bars: int
) -> DataFrame:
    """Average pair per completed period, shifted one period back.

    Null for symbols with fewer than `min_bars` periods in their whole history.
    """
    bars = resample_last(df, label, end)
    bars = ema(bars, (fast, slow), order=end, names={fast: "__fast", slow: "__slow"})
    w = series(order=end)
    enough = F.count("*").over(Window.partitionBy("symbol")) >= min_bars
    return bars.select(
        "symbol", end,
        F.when(enough, F.lag("__fast").over(w)).alias("fast"),
        F.when(enough, F.lag("__slow").over(w)).alias("slow"),
    )


def weekly_averages(df: DataFrame) -> DataFrame:
    r = DEFAULTS.timeframes
    return period_averages(
        df, week_label(), "week_end", r.weekly_fast, r.weekly_slow, r.weekly_min_bars
    )


def monthly_averages(df: DataFrame) -> DataFrame:
    r = DEFAULTS.timeframes
    return period_averages(
        df, month_label(), "month_end", r.monthly_fast, r.monthly_slow, r.monthly_min_bars
    )


def timeframe_averages(features: DataFrame) -> DataFrame:
    """Daily rows with the averages of the latest closed week and month."""
    days = require(features, TIMEFRAME_INPUT).select(*TIMEFRAME_INPUT)
    merged = asof_backward(
        days,
        {
            "__w": (weekly_averages(days), "week_end"),
            "__m": (monthly_averages(days), "month_end"),
        },
    )
    return merged.withColumns(
        {
            "mtf_w_ema_fast": C("__w.fast"), "mtf_w_ema_slow": C("__w.slow"),
            "mtf_m_ema_fast": C("__m.fast"), "mtf_m_ema_slow": C("__m.slow"),
        }
    ).drop("__w", "__m")


def timeframe_trend(df: DataFrame) -> DataFrame:
    """Trend flags of both frames and their sum."""
    close = C("close_price")
    return df.withColumns(
        {
            f"mtf_{name}_trend": flag(
                all_of(close > C(f"mtf_{p}_ema_fast"),
                       C(f"mtf_{p}_ema_fast") > C(f"mtf_{p}_ema_slow"))
            )
            for name, p in (("weekly", "w"), ("monthly", "m"))
        }
    ).withColumn("mtf_score", C("mtf_weekly_trend") + C("mtf_monthly_trend"))


def timeframes(features: DataFrame) -> DataFrame:
    return (
        timeframe_averages(features).transform(timeframe_trend).select(*TIMEFRAME_COLUMNS)
    )
