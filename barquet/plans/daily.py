"""The daily tables: features, signals, price action, timeframes, regime."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barquet.operators.cleaning import valid_candles
from barquet.operators.features import build_features
from barquet.operators.signals import raw_signals, regime_gate
from barquet.operators.targets import targets

# The columns of the signal table, in the order in which they are computed here.
SIGNAL_COLUMNS = (
    "symbol", "trade_date", "close_price", "trend_signal", "stage2_signal",
    "stage2_days", "stage2_started_date", "ema_alignment_signal",
    "volume_contraction_signal", "volatility_contraction_signal", "vcp_signal",
    "liquidity_signal", "quality_signal", "breakout_signal",
    "breakout_ready_signal", "pivot_price", "base_low_price",
    "distance_from_pivot_pct", "distance_from_52w_high_pct", "rs_signal",
    "rs_value", "rs_new_high", "minervini_signal", "darvas_signal",
    "composite_score", "composite_rank", "institutional_candidate",
    "base_range_pct", "target_1_price", "target_1_pct", "target_2_price",
    "target_2_pct", "target_3_price", "target_3_pct", "position_stage",
    "trailing_stop_price", "risk_reward_t2", "upside_prob_pct", "ev_score",
)


def feature_table(bars: DataFrame, earnings: DataFrame | None = None) -> DataFrame:
    return build_features(valid_candles(bars), earnings)


def signal_table(
    features: DataFrame,
    index_bars: DataFrame | None = None,
    fundamentals: DataFrame | None = None,
    pass_score: int = 6,
    gate: DataFrame | None = None,
) -> DataFrame:
    """All signal columns; with `gate`, the newest date is suppressed by regime."""
    out = targets(raw_signals(features, index_bars, fundamentals, pass_score)).select(
        *SIGNAL_COLUMNS
    )
    return out if gate is None else regime_gate(out, gate, features)
