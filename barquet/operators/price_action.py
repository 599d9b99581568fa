"""Price-action features and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.config import DEFAULTS
from barquet.functions.predicates import all_of, b, change, clip, flag, half_even, ratio
from barquet.functions.windows import (
    asof_backward, lag, resample_last, roll, series, week_label,
)
from barquet.schemas import require
from barquet.sources.scans import PRICE_ACTION_INPUT

C = F.col
PRICE_ACTION_COLUMNS = (
    "symbol", "trade_date", "pa_hh_daily", "pa_hl_daily", "pa_hh_weekly",
    "pa_hl_weekly", "pa_close_position", "pa_vol_quality", "pa_roc_10",
    "pa_roc_20", "pa_momentum_accel", "pa_extension_ok", "pa_score", "pa_signal",
)


def daily_structure(df: DataFrame) -> DataFrame:
    """Higher highs and lows, candle position, volume quality, momentum, extension."""
    r = DEFAULTS.price_action
    close = C("close_price")
    n = r.daily_bars
    staged = df.withColumns(
        {
            "__top": roll(F.max, close, n, shift=1),
            "__low": roll(F.min, close, n, shift=1),
            "pa_roc_10": change(close, lag("close_price", 10)) * 100,
            "pa_roc_20": change(close, lag("close_price", 20)) * 100,
        }
    )
    extension = change(close, C("ema_50"))
    return staged.withColumns(
        {
            "pa_hh_daily": flag(C("__top") > lag("__top", r.daily_shift)),
            "pa_hl_daily": flag(C("__low") > lag("__low", r.daily_shift)),
            "pa_close_position": clip(
                ratio(close - C("low_price"), C("high_price") - C("low_price")), 0.0, 1.0
            ),
            "pa_vol_quality": flag(C("relative_volume").between(r.volume_min, r.volume_max)),
            "pa_momentum_accel": flag(
                (C("pa_roc_10") > C("pa_roc_20")) & (C("pa_roc_20") > r.min_roc_20)
            ),
            "pa_extension_ok": flag(extension.between(r.min_extension, r.max_extension)),
        }
    ).drop("__top", "__low")


def weekly_bars(df: DataFrame) -> DataFrame:
    """Weekly closes with the higher-high / higher-low flags of completed weeks."""
    r = DEFAULTS.price_action
    n, back = r.weekly_bars, r.weekly_shift
    w = series(order="week_end")
    weeks = resample_last(df, week_label(), "week_end")
    weeks = weeks.withColumns(
        {
            "__top": roll(F.max, C("close_price"), n, shift=1, over=w),
            "__low": roll(F.min, C("close_price"), n, shift=1, over=w),
            "__weeks": F.count("*").over(Window.partitionBy("symbol")),
        }
    )
    enough = C("__weeks") >= n + back + 1
    return weeks.select(
        "symbol", "week_end",
        flag(enough & (C("__top") > F.lag("__top", back).over(w))).alias("hh"),
        flag(enough & (C("__low") > F.lag("__low", back).over(w))).alias("hl"),
    )


def weekly_structure(df: DataFrame) -> DataFrame:
    """Attach the latest closed week's flags to each day."""
    merged = asof_backward(df, {"__week": (weekly_bars(df), "week_end")})
    return merged.withColumns(
        {
            "pa_hh_weekly": F.coalesce(C("__week.hh"), F.lit(0)),
            "pa_hl_weekly": F.coalesce(C("__week.hl"), F.lit(0)),
        }
    ).drop("__week")


def price_action_score(df: DataFrame) -> DataFrame:
    """Weighted 0-100 score; the signal also needs the weekly structure."""
    r = DEFAULTS.price_action
    daily = all_of(C("pa_hh_daily") >= 1, C("pa_hl_daily") >= 1)
    weekly = all_of(C("pa_hh_weekly") >= 1, C("pa_hl_weekly") >= 1)
    parts = (
        (daily, r.score_daily),
        (weekly, r.score_weekly),
        (C("pa_close_position") >= r.min_close_position, r.score_close),
        (C("pa_vol_quality") >= 1, r.score_volume),
        (C("pa_momentum_accel") >= 1, r.score_momentum),
        (C("pa_extension_ok") >= 1, r.score_extension),
    )
    score = sum((flag(test) * F.lit(float(points)) for test, points in parts), F.lit(0.0))
    return df.withColumn("pa_score", half_even(score, 1)).withColumn(
        "pa_signal", flag(b(C("pa_score") >= r.min_signal_score) & weekly)
    )


def price_action(features: DataFrame) -> DataFrame:
    """All price-action columns of a feature panel."""
    return (
        require(features, PRICE_ACTION_INPUT).select(*PRICE_ACTION_INPUT)
        .transform(daily_structure)
        .transform(weekly_structure)
        .transform(price_action_score)
        .select(*PRICE_ACTION_COLUMNS)
    )
