"""Daily technical features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, EMA_SPANS, FEATURE_COLUMNS
from barquet.functions.predicates import all_of, change, flag, ratio
from barquet.functions.windows import Extreme, ema, lag, roll, with_extremes
from barquet.schemas import require

C = F.col


def moving_averages(bars: DataFrame) -> DataFrame:
    """Five exponential averages of the close."""
    return ema(require(bars, ("symbol", "trade_date", "close_price")), EMA_SPANS)


def trend_score(df: DataFrame) -> DataFrame:
    """0-4: one point per ordered pair of averages, one for close above EMA 21."""
    return df.withColumn(
        "trend_score",
        flag(C("ema_21") > C("ema_50")) + flag(C("ema_50") > C("ema_150"))
        + flag(C("ema_150") > C("ema_200")) + flag(C("close_price") > C("ema_21")),
    )


def weinstein_stage(df: DataFrame) -> DataFrame:
    """Stage 1-4 from the position around, and the slope of, the long average."""
    r = DEFAULTS.features
    band = r.flat_band_pct
    df = _layer(df, {"__ema_200_lag": lag("ema_200", r.slope_bars)})
    slope = F.coalesce(change(C("ema_200"), C("__ema_200_lag")) * 100, F.lit(0.0))
    staged = df.withColumn("__slope", slope)
    close = C("close_price")
    advancing = all_of(
        close > C("ema_200"), close > C("ema_150"), C("ema_50") > C("ema_150"),
        C("ema_150") > C("ema_200"), C("__slope") > 0,
    )
    declining = all_of(
        close < C("ema_200"), C("ema_50") < C("ema_150"), C("ema_150") < C("ema_200"),
        C("__slope") < -band,
    )
    basing = all_of(close < C("ema_200"), C("__slope").between(-band, band))
    return staged.withColumn(
        "weinstein_stage",
        F.when(advancing, 2).when(declining, 4).when(basing, 1).otherwise(3),
    ).drop("__slope", "__ema_200_lag")


def _layer(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are not there yet, as one window operator."""
    missing = {n: c for n, c in columns.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def _volume_windows() -> dict[str, Column]:
    volume = C("volume").cast("double")
    return {
        "avg_volume_10": roll(F.avg, volume, 10),
        "avg_volume_20": roll(F.avg, volume, 20),
    }


def volume_averages(df: DataFrame) -> DataFrame:
    """10- and 20-bar average volume and today's multiple of the latter."""
    return _layer(df, _volume_windows()).withColumn(
        "relative_volume", ratio(C("volume"), C("avg_volume_20"))
    )


def volatility(df: DataFrame) -> DataFrame:
    """Range, true range average, range volatility and its contraction."""
    r = DEFAULTS.features
    n = r.volatility_bars
    df = _layer(df, {"__prev_close": lag("close_price")})
    true_range = F.greatest(
        C("high_price") - C("low_price"),
        F.abs(C("high_price") - C("__prev_close")), F.abs(C("low_price") - C("__prev_close")),
    )
    return (
        df.withColumns(
            {
                "daily_range_pct": ratio(C("high_price") - C("low_price"), C("close_price")) * 100,
                "__tr": true_range,
            }
        )
        .withColumns(
            {
                "atr_14": roll(F.avg, C("__tr"), r.atr_bars, 1),
                "volatility_10": roll(F.stddev_samp, C("daily_range_pct"), n, 1),
            }
        )
        .withColumn(
            "volatility_contraction",
            ratio(C("volatility_10"), roll(F.avg, C("volatility_10"), n, 1)),
        )
        .drop("__tr", "__prev_close")
    )


def year_range(df: DataFrame) -> DataFrame:
    """52-week high and low of the close."""
    r = DEFAULTS.features
    wanted = {
        "high_52w": Extreme(F.max, "close_price", r.year_bars, r.year_min_bars),
        "low_52w": Extreme(F.min, "close_price", r.year_bars, r.year_min_bars),
    }
    missing = {n: e for n, e in wanted.items() if n not in df.columns}
    return with_extremes(df, missing) if missing else df


def _bar_windows(df: DataFrame) -> DataFrame:
    """All windows over averages and bars alone, in one operator but for the 52-week range."""
    return _layer(
        df,
        {
            **_volume_windows(), "__prev_close": lag("close_price"),
            "__ema_200_lag": lag("ema_200", DEFAULTS.features.slope_bars),
        },
    )


def earnings_mark(df: DataFrame, earnings: DataFrame | None) -> DataFrame:
    """1 on announcement days."""
    if earnings is None:
        return df.withColumn("is_earnings_day", F.lit(0))
    days = earnings.select(
        "symbol", C("earnings_date").alias("trade_date"), F.lit(1).alias("__hit")
    ).distinct()
    return (
        df.join(days, ["symbol", "trade_date"], "left")
        .withColumn("is_earnings_day", F.coalesce("__hit", F.lit(0)))
        .drop("__hit")
    )


def build_features(bars: DataFrame, earnings: DataFrame | None = None) -> DataFrame:
    """The whole feature row.

    The earnings join comes first: it shuffles by (symbol, trade_date) at most
    once, and every window after it shares one exchange on symbol.
    """
    return (
        earnings_mark(bars, earnings)
        .transform(moving_averages)
        .transform(_bar_windows)
        .transform(trend_score)
        .transform(weinstein_stage)
        .transform(volume_averages)
        .transform(volatility)
        .transform(year_range)
        .select(*FEATURE_COLUMNS)
    )
