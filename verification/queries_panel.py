"""Feature and signal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.functions import windows
from barquet.functions.custom import per_symbol
from barquet.functions.predicates import half_even
from barquet.operators import features, price_action, signals, targets, timeframes
from barquet.operators.sector import with_sector
from barquet.plans.daily import feature_table
from barquet.sources.scans import price_action_panel, timeframe_panel
from verification.registry import register
from verification.sql_stages import CTE, chg, div, lag, roll, yes
from verification.stages import Stages

C = F.col


def show(df: DataFrame, *cols: str, **places: int) -> DataFrame:
    """Key columns, plain columns and columns rounded to some places."""
    return df.select(
        "symbol", "trade_date", *cols,
        *[half_even(C(c), n).alias(c) for c, n in places.items()],
    )


def shown(src: str, *cols: str, **places: int) -> str:
    """The SQL twin of show()."""
    parts = ["symbol", "trade_date", *cols]
    parts += [f"round_even({c}, {n}) AS {c}" for c, n in places.items()]
    return f"SELECT {', '.join(parts)} FROM {src}"


EMAS = {f"ema_{s}": 4 for s in (10, 21, 50, 150, 200)}


@register("ema", shown("features", **EMAS))
def _(s: Stages):
    """Five exponential averages."""
    return show(features.moving_averages(s.bars()), **EMAS)


@register("trend_score", shown("features", "trend_score"))
def _(s: Stages):
    """W2."""
    return show(s.bars().transform(features.moving_averages).transform(features.trend_score),
                "trend_score")


@register("trend_score_counts", """
SELECT symbol, trend_score, count(*) AS bars, round(sum(close_price), 2) AS closes
FROM features GROUP BY 1, 2""")
def _(s: Stages):
    """W1 and W2 rolled up per symbol."""
    scored = s.bars().transform(features.moving_averages).transform(features.trend_score)
    return scored.groupBy("symbol", "trend_score").agg(
        F.count("*").alias("bars"), F.round(F.sum("close_price"), 2).alias("closes")
    )


@register("weinstein_stage", shown("features", "weinstein_stage"))
def _(s: Stages):
    """W3."""
    return show(s.bars().transform(features.moving_averages)
                .transform(features.weinstein_stage), "weinstein_stage")


@register("volume_averages",
          shown("features", avg_volume_10=2, avg_volume_20=2, relative_volume=6))
def _(s: Stages):
    """W4."""
    return show(features.volume_averages(s.bars()),
                avg_volume_10=2, avg_volume_20=2, relative_volume=6)


VOL = dict(daily_range_pct=6, atr_14=6, volatility_10=6, volatility_contraction=6)


@register("volatility", shown("features", **VOL))
def _(s: Stages):
    """W5-W7."""
    return show(features.volatility(s.bars()), **VOL)


@register("year_range", shown("features", high_52w=2, low_52w=2))
def _(s: Stages):
    """W8."""
    return show(features.year_range(s.bars()), high_52w=2, low_52w=2)


@register("earnings_mark", shown("f0", "is_earnings_day"))
def _(s: Stages):
    """J14."""
    return show(features.earnings_mark(s.bars(), s.earnings()), "is_earnings_day")


FULL = ("trend_score", "weinstein_stage", "is_earnings_day")


@register("feature_table", shown("features", "close_price", *FULL, **EMAS, **VOL,
                                 avg_volume_20=2, relative_volume=6, high_52w=2, low_52w=2))
def _(s: Stages):
    """The whole feature row for every symbol in one plan."""
    return show(feature_table(s.bars(), s.earnings()), "close_price", *FULL, **EMAS, **VOL,
                avg_volume_20=2, relative_volume=6, high_52w=2, low_52w=2)


# ------------------------------------------------------------------ price action
PA_DAY = ("pa_hh_daily", "pa_hl_daily", "pa_vol_quality", "pa_momentum_accel", "pa_extension_ok")
PA_NUM = dict(pa_close_position=6, pa_roc_10=4, pa_roc_20=4)


@register("price_action_daily", shown("pa1", *PA_DAY, **PA_NUM))
def _(s: Stages):
    """W9-W13."""
    return show(price_action.daily_structure(price_action_panel(s.features())),
                *PA_DAY, **PA_NUM)


@register("weekly_resample", "SELECT symbol, week_end, close_price FROM weeks0")
def _(s: Stages):
    """A1."""
    return windows.resample_last(s.bars(), windows.week_label(), "week_end")


@register("monthly_resample", "SELECT symbol, month_end, close_price FROM months0")
def _(s: Stages):
    """A2."""
    return windows.resample_last(s.bars(), windows.month_label(), "month_end")


@register("price_action_weekly", shown("pa2", "pa_hh_weekly", "pa_hl_weekly"))
def _(s: Stages):
    """W14 with J8."""
    return show(price_action.weekly_structure(timeframe_panel(s.bars())),
                "pa_hh_weekly", "pa_hl_weekly")


@register("price_action_signal", shown("price_action", *PA_DAY, "pa_hh_weekly", "pa_hl_weekly",
                                       "pa_score", "pa_signal", **PA_NUM))
def _(s: Stages):
    """G16 over the whole price-action row."""
    return show(price_action.price_action(s.features()), *PA_DAY, "pa_hh_weekly",
                "pa_hl_weekly", "pa_score", "pa_signal", **PA_NUM)


MTF = dict(mtf_w_ema_fast=4, mtf_w_ema_slow=4, mtf_m_ema_fast=4, mtf_m_ema_slow=4)


@register("timeframe_averages", shown("timeframes", **MTF))
def _(s: Stages):
    """W15 with J8."""
    return show(timeframes.timeframe_averages(timeframe_panel(s.bars())), **MTF)


@register("timeframe_signal",
          shown("timeframes", "mtf_weekly_trend", "mtf_monthly_trend", "mtf_score", **MTF))
def _(s: Stages):
    """G15."""
    return show(timeframes.timeframes(s.features()),
                "mtf_weekly_trend", "mtf_monthly_trend", "mtf_score", **MTF)


@register("asof_weekly_close", """
SELECT d.symbol, d.trade_date, w.close_price AS week_close
FROM bars d ASOF LEFT JOIN weeks0 w ON w.symbol = d.symbol AND w.week_end <= d.trade_date""")
def _(s: Stages):
    """J8 on its own: latest closed weekly bar of each day."""
    weeks = windows.resample_last(s.bars(), windows.week_label(), "week_end")
    days = s.bars().select("symbol", "trade_date", "close_price")
    return windows.asof_backward(days, {"w": (weeks, "week_end")}).select(
        "symbol", "trade_date", C("w.close_price").alias("week_close")
    )


@register("custom_per_symbol", """
SELECT symbol, trade_date, round(close_price / max(close_price) OVER (
         PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1, 6) AS off_peak
FROM bars""")
def _(s: Stages):
    """2.12: a user's own per-symbol function on Arrow batches."""

    def off_peak(pdf):
        pdf = pdf.sort_values("trade_date")
        pdf["off_peak"] = (pdf["close_price"] / pdf["close_price"].cummax() - 1).round(6)
        return pdf[["symbol", "trade_date", "off_peak"]]

    return per_symbol(
        timeframe_panel(s.bars()), off_peak, "symbol string, trade_date date, off_peak double"
    )


# ------------------------------------------------------------------ signals
@register("trend_signal", shown("signals", "trend_signal"))
def _(s: Stages):
    """G1."""
    return show(signals.trend_signal(s.features()), "trend_signal")


@register("stage2_signal", shown("signals", "stage2_signal"))
def _(s: Stages):
    """G2."""
    return show(signals.stage2_signal(s.features()), "stage2_signal")


@register("stage2_age", shown("signals", "stage2_days", "stage2_started_date"))
def _(s: Stages):
    """G3."""
    return show(s.features().transform(signals.stage2_signal).transform(signals.stage2_age),
                "stage2_days", "stage2_started_date")


CONTRACTION = ("ema_alignment_signal", "volume_contraction_signal",
               "volatility_contraction_signal")


@register("contraction_signals", shown("signals", *CONTRACTION))
def _(s: Stages):
    """G4."""
    return show(signals.contraction_signals(s.features()), *CONTRACTION)


@register("vcp_signal", shown("signals", "vcp_signal"))
def _(s: Stages):
    """G5."""
    return show(s.features().transform(signals.stage2_signal)
                .transform(signals.contraction_signals).transform(signals.vcp_signal),
                "vcp_signal")


@register("liquidity_signal", shown("signals", "liquidity_signal"))
def _(s: Stages):
    """G6."""
    return show(signals.liquidity_signal(s.features()), "liquidity_signal")


@register("quality_signal", shown("signals", "quality_signal"))
def _(s: Stages):
    """G7."""
    return show(signals.attach_context(s.features(), None, s.fundamentals())
                .transform(signals.stage2_signal).transform(signals.quality_signal),
                "quality_signal")


PIVOT = ("pivot_price", "base_low_price", "distance_from_pivot_pct",
         "distance_from_52w_high_pct")


@register("pivot_levels", shown("signals", *PIVOT))
def _(s: Stages):
    """G8."""
    return show(signals.pivot_levels(s.features()), *PIVOT)


@register("breakout_signal", shown("signals", "breakout_signal", "breakout_ready_signal"))
def _(s: Stages):
    """G9 and G10."""
    return show(s.features().transform(signals.stage2_signal).transform(signals.stage2_age)
                .transform(signals.pivot_levels).transform(signals.breakout_signal)
                .transform(signals.breakout_ready_signal),
                "breakout_signal", "breakout_ready_signal")


@register("relative_strength", shown("signals", "rs_signal", "rs_value", "rs_new_high"))
def _(s: Stages):
    """G11, G12 with J13."""
    return show(signals.attach_context(s.features(), s.index_bars())
                .transform(signals.relative_strength).transform(signals.rs_new_high),
                "rs_signal", "rs_value", "rs_new_high")


@register("relative_strength_of_two", shown("signals", "rs_signal", "rs_value", "rs_new_high"))
def _(s: Stages):
    """J13 where the index table holds a second index."""
    two = s.index_bars().unionByName(s.index_bars().withColumns(
        {"index_code": F.lit("OTHER"), "close": F.col("close") * 2 + F.dayofyear("trade_date")}))
    code = s.index_bars().select("index_code").first()[0]
    return show(signals.attach_context(s.features(), two, index_code=code)
                .transform(signals.relative_strength).transform(signals.rs_new_high),
                "rs_signal", "rs_value", "rs_new_high")


@register("minervini_signal", shown("signals", "minervini_signal"))
def _(s: Stages):
    """G13."""
    return show(signals.attach_context(s.features(), s.index_bars())
                .transform(signals.relative_strength).transform(signals.minervini_signal),
                "minervini_signal")


@register("darvas_signal", shown("signals", "darvas_signal"))
def _(s: Stages):
    """G14."""
    return show(s.features().transform(signals.pivot_levels).transform(signals.darvas_signal),
                "darvas_signal")


@register("composite_score", shown("signals", "composite_score", "institutional_candidate",
                                   composite_rank=4))
def _(s: Stages):
    """G17 and G18."""
    return show(signals.raw_signals(s.features(), s.index_bars(), s.fundamentals()),
                "composite_score", "institutional_candidate", composite_rank=4)


PRICES = ("base_range_pct", "target_1_price", "target_1_pct", "target_2_price",
          "target_2_pct", "target_3_price", "target_3_pct")
LATER = ("position_stage", "trailing_stop_price", "risk_reward_t2", "upside_prob_pct", "ev_score")


@register("price_targets", shown("signals", *PRICES))
def _(s: Stages):
    """G19."""
    return show(s.features().transform(signals.pivot_levels).transform(targets.price_targets),
                *PRICES)


@register("position_stage", shown("signals", "position_stage", "trailing_stop_price"))
def _(s: Stages):
    """G20 and G21."""
    return show(s.features().transform(signals.pivot_levels).transform(targets.price_targets)
                .transform(targets.position_stage).transform(targets.trailing_stop),
                "position_stage", "trailing_stop_price")


@register("expected_value", shown("signals", *LATER))
def _(s: Stages):
    """G22 over the full signal row."""
    return show(targets.targets(signals.raw_signals(
        s.features(), s.index_bars(), s.fundamentals())), *LATER)


_GATED = """
SELECT s.symbol, s.trade_date,
       CASE WHEN g.cash THEN 0 ELSE s.trend_signal END AS trend_signal,
       CASE WHEN g.cash THEN 0 ELSE s.stage2_signal END AS stage2_signal,
       CASE WHEN g.cash OR g.shut THEN 0 ELSE s.vcp_signal END AS vcp_signal,
       CASE WHEN g.cash OR g.shut THEN 0 ELSE s.breakout_signal END AS breakout_signal,
       CASE WHEN g.cash OR g.shut THEN 0 ELSE s.breakout_ready_signal END AS breakout_ready_signal,
       s.liquidity_signal, s.quality_signal, s.composite_score AS old_score, g.d AS gated,
       s.institutional_candidate AS old_ic
FROM signals s LEFT JOIN (
  SELECT (SELECT max(trade_date) FROM signals) AS d, e.cash_mode AS cash,
         NOT e.allow_breakouts OR coalesce(x.distribution_count, 0) >= 5 AS shut
  FROM environment e LEFT JOIN distribution x ON x.trade_date = e.trade_date
  ORDER BY e.trade_date DESC LIMIT 1) g
ON g.d = s.trade_date"""
_RESCORED = """round_even((trend_signal * 20 + stage2_signal * 20 + liquidity_signal * 10
 + quality_signal * 20 + vcp_signal * 15 + breakout_signal * 15) / 100.0::DOUBLE * 100, 2)"""


@register("regime_gate", f"""
SELECT symbol, trade_date, trend_signal, stage2_signal, vcp_signal, breakout_signal,
       breakout_ready_signal, composite_score, institutional_candidate
FROM (SELECT *, CASE WHEN gated IS NOT NULL THEN {_RESCORED} ELSE old_score END AS composite_score,
             CASE WHEN gated IS NOT NULL THEN {yes(_RESCORED + ' >= 70')} ELSE old_ic END
               AS institutional_candidate
      FROM ({_GATED}))""")
def _(s: Stages):
    """Latest date suppressed by the newest regime row."""
    from barquet.operators import regime

    gate = regime.gate_rows(s.environment(), regime.distribution_days(s.index_bars()))
    return show(signals.regime_gate(s.signals(), gate, s.features()),
                "trend_signal", "stage2_signal", "vcp_signal", "breakout_signal",
                "breakout_ready_signal", "composite_score", "institutional_candidate")


@register("sector_attach", """
SELECT s.symbol, s.trade_date, coalesce(u.sector, 'Unknown') AS sector
FROM signals s LEFT JOIN universe u ON u.symbol || '.NS' = s.symbol
WHERE s.breakout_signal = 1""")
def _(s: Stages):
    """Universe lookup by panel symbol."""
    hits = s.signals().filter(C("breakout_signal") == 1)
    return show(with_sector(hits, s.universe()), "sector")


@register("screen_flagship", """
SELECT s.symbol, s.trade_date, s.composite_score, s.ev_score, s.pivot_price,
       s.distance_from_pivot_pct, s.stage2_days, s.position_stage, s.trailing_stop_price
FROM signals s WHERE s.breakout_ready_signal = 1 AND s.liquidity_signal = 1
  AND s.composite_score >= 70""")
def _(s: Stages):
    """Bars to ranked breakout candidates in one plan, no stored stage but the inputs."""
    feats = feature_table(s.bars(), s.earnings())
    rows = targets.targets(signals.raw_signals(feats, s.index_bars(), s.fundamentals()))
    return show(
        rows.filter(
            (C("breakout_ready_signal") == 1) & (C("liquidity_signal") == 1)
            & (C("composite_score") >= 70)
        ),
        "composite_score", "ev_score", "pivot_price", "distance_from_pivot_pct",
        "stage2_days", "position_stage", "trailing_stop_price",
    )


assert CTE and chg and div and lag and roll  # shared SQL helpers
