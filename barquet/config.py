"""Thresholds, weights and lookup tables.

Everything here is a fixed value: results only agree with the figures users
already have when these numbers, names and labels are kept exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- symbols
SYMBOL_SUFFIX = ".NS"
UNKNOWN_SECTOR = "Unknown"
UNKNOWN_REGIME = "UNKNOWN"

# ---------------------------------------------------------------- columns
PRICE_COLUMNS = (
    "symbol", "trade_date", "open_price", "high_price", "low_price",
    "close_price", "volume",
)
EMA_SPANS = (10, 21, 50, 150, 200)
FEATURE_COLUMNS = PRICE_COLUMNS + (
    "ema_10", "ema_21", "ema_50", "ema_150", "ema_200",
    "trend_score", "weinstein_stage",
    "avg_volume_10", "avg_volume_20", "relative_volume",
    "daily_range_pct", "atr_14", "volatility_10", "volatility_contraction",
    "high_52w", "low_52w", "is_earnings_day",
)


@dataclass(frozen=True)
class CleaningRules:
    """Fixed values of the ingest filters."""

    max_daily_move_ratio: float = 5.0
    max_volume_multiplier: float = 100.0
    market_close_utc_hour: int = 10
    market_close_utc_minute: int = 0
    gap_check_sessions: int = 5


@dataclass(frozen=True)
class FeatureRules:
    """Fixed values of the technical features."""

    slope_bars: int = 20
    flat_band_pct: float = 0.50
    atr_bars: int = 14
    volatility_bars: int = 10
    year_bars: int = 252
    year_min_bars: int = 63


@dataclass(frozen=True)
class SignalRules:
    """Fixed values of the signal tests."""

    trend_long_slope: int = 20
    trend_short_slope: int = 10
    stage2_range_position: float = 0.75
    min_avg_volume_20: int = 500_000
    min_traded_value: int = 50_000_000
    min_composite: float = 70.0
    proxy_trend_score: int = 3
    # contraction pattern
    vcp_volume_ratio: float = 0.70
    vcp_volatility_ratio: float = 0.80
    vcp_atr_ratio: float = 0.65
    vcp_atr_bars: int = 90
    vcp_atr_min_bars: int = 20
    # breakout
    pivot_bars: int = 20
    pivot_min_bars: int = 10
    breakout_volume: float = 1.5
    breakout_max_extension: float = 0.10
    breakout_near_pivot: float = 0.03
    breakout_close_position: float = 0.50
    breakout_max_gap: float = 0.03
    breakout_max_stage2_days: int = 60
    breakout_dry_up: float = 0.75
    breakout_max_below_high: float = 0.25
    breakout_max_base_range: float = 0.15
    breakout_min_gain_from_low: float = 0.30
    # relative strength
    rs_bars: int = 63
    rs_high_bars: int = 252
    rs_high_min_bars: int = 126
    # trend template
    template_slope: int = 20
    template_min_gain_from_low: float = 0.30
    template_max_below_high: float = 0.25
    # box breakout
    box_bars: int = 20
    box_min_bars: int = 10
    box_max_range: float = 0.12
    box_max_below_high: float = 0.10
    box_volume: float = 1.5
    # streak age bands
    stage2_early_days: int = 20
    stage2_mid_days: int = 60
    # market gate
    distribution_gate: int = 5


# Composite score weights (sum 100).
COMPOSITE_WEIGHTS = {
    "trend_signal": 20,
    "stage2_signal": 20,
    "liquidity_signal": 10,
    "quality_signal": 20,
    "vcp_signal": 15,
    "breakout_signal": 15,
}


@dataclass(frozen=True)
class TargetRules:
    """Fixed values of targets, stops and probabilities."""

    t1: float = 0.50
    t2: float = 1.00
    t3: float = 0.25
    stop_loss: float = 0.07
    near_t1: float = 0.97
    stop_below_target: float = 0.98
    atr_multiple: float = 1.5
    base_prob: float = 40.0
    prob_breakout: float = 5.0
    prob_minervini: float = 8.0
    prob_rs_new_high: float = 5.0
    prob_darvas: float = 7.0
    prob_high_score: float = 5.0
    prob_fresh_stage2: float = 3.0
    prob_late_stage2: float = -5.0
    high_score: float = 80.0
    fresh_days: int = 20
    late_days: int = 60
    max_prob: float = 75.0
    min_prob: float = 20.0
    hold_days_t1: int = 30
    hold_days_t2: int = 60
    hold_days_t3: int = 20
    min_samples: int = 30


@dataclass(frozen=True)
class PriceActionRules:
    """Fixed values of the price-action features and score."""

    daily_bars: int = 20
    daily_shift: int = 20
    weekly_bars: int = 4
    weekly_shift: int = 4
    min_close_position: float = 0.60
    volume_min: float = 1.1
    volume_max: float = 3.0
    min_extension: float = -0.05
    max_extension: float = 0.20
    min_roc_20: float = 0.0
    score_daily: int = 25
    score_weekly: int = 25
    score_close: int = 15
    score_volume: int = 15
    score_momentum: int = 10
    score_extension: int = 10
    min_signal_score: float = 70.0


@dataclass(frozen=True)
class MultiTimeframeRules:
    """Fixed values of the weekly and monthly averages."""

    weekly_fast: int = 10
    weekly_slow: int = 30
    weekly_min_bars: int = 52
    monthly_fast: int = 10
    monthly_slow: int = 21
    monthly_min_bars: int = 24


@dataclass(frozen=True)
class RegimeRules:
    """Fixed values of the index regime and breadth tests."""

    points: int = 20
    warmup_bars: int = 220
    peak_bars: int = 20
    higher_high_shift: int = 20
    slope_bars: int = 20
    breadth_min_stocks: int = 20
    breadth_threshold: float = 0.50
    distribution_bars: int = 25
    distribution_drop: float = 0.002
    follow_min_rise: float = 0.017
    follow_min_day: int = 4
    follow_peak_bars: int = 20
    follow_peak_min_bars: int = 5
    correction: float = 0.05
    risk_off_level: float = 20.0


@dataclass(frozen=True)
class SectorRules:
    """Fixed values of the sector ranking."""

    min_stocks: int = 5
    lookback_days: int = 20
    window_days: int = 2
    trend_weight: float = 0.30
    rs_weight: float = 0.35
    stage2_weight: float = 0.25
    score_weight: float = 0.10


@dataclass(frozen=True)
class BacktestRules:
    """Fixed values of the back-test."""

    stop_loss: float = 0.07
    target: float = 0.20
    max_holding_days: int = 60
    min_composite: float = 50.0
    trading_days: int = 252
    histogram_bins: int = 30
    blocked_state: str = "DEFENSIVE"


ENTRY_SIGNALS = (
    "breakout_signal", "vcp_signal", "breakout_ready_signal",
    "pa_signal", "combined_pa_ema",
)

# (name, entry signal, lowest multi-timeframe score or None)
STRATEGIES = (
    ("Composite", "breakout_signal", None),
    ("Breakout MTF>=1", "breakout_signal", 1),
    ("Breakout MTF=2", "breakout_signal", 2),
    ("VCP MTF=2", "vcp_signal", 2),
    ("Price Action", "pa_signal", None),
    ("Combined PA+EMA", "combined_pa_ema", None),
)


@dataclass(frozen=True)
class QualityRules:
    """Fixed values of the data-quality checks."""

    price_tolerance: float = 0.01
    max_gap_days: int = 5
    gap_lookback_days: int = 60
    critical_bars: int = 63
    warning_bars: int = 200
    caution_bars: int = 252
    report_days: int = 7


@dataclass(frozen=True)
class StalenessRules:
    """Fixed values of the refresh decisions."""

    fundamentals_days: int = 30
    earnings_days: int = 7
    earnings_max_future_days: int = 365


@dataclass(frozen=True)
class ScreenRules:
    """Fixed values of the screens."""

    top_n: int = 100
    fetch_n: int = 2000
    recent_dates: int = 60
    detail_bars: int = 252
    watchlist_score: float = 70.0
    tier_threshold: float = 50.0


# Market states: code, lowest and highest score, exposure, position size,
# breakouts allowed, pyramiding allowed, cash mode, active.
MARKET_STATES = (
    ("STRONG_BULL", 100, 100, 1.0, 1.0, True, True, False, True),
    ("BULL", 80, 99, 0.8, 0.8, True, False, False, True),
    ("NEUTRAL", 60, 79, 0.5, 0.5, True, False, False, True),
    ("DEFENSIVE", 40, 59, 0.3, 0.3, False, False, False, True),
    ("CORRECTION", 20, 39, 0.2, 0.2, False, False, False, True),
    ("BEAR", 0, 19, 0.0, 0.0, False, False, True, True),
    ("HIGH_VOLATILITY", None, None, 0.2, 0.2, False, False, False, False),
)
FALLBACK_STATE = "BEAR"

# Fundamental filters: name, threshold.
FUNDAMENTAL_FILTERS = (
    ("roe_min", 12.0),
    ("roce_min", 12.0),
    ("debt_to_equity_max", 1.0),
    ("sales_growth_min", 10.0),
    ("profit_growth_min", 10.0),
    ("promoter_holding_min", 40.0),
    ("promoter_pledge_max", 20.0),
    ("opm_min", 10.0),
    ("market_cap_min_cr", 500.0),
    ("quality_pass_score", 6.0),
)

# Indices: code, name.
INDEX_LIST = (
    ("NIFTY50", "NIFTY 50"),
    ("NIFTY500", "NIFTY 500"),
    ("MIDCAP150", "NIFTY Midcap 150"),
    ("SMALLCAP250", "NIFTY Smallcap 250"),
)

# Equity series kept when normalising an exchange listing.
LISTED_SERIES = ("EQ", "BE", "BZ")

# Screen presets: name -> signal weights. The first one is the default.
PRESETS = {
    "Composite (Default)": {
        "trend_signal": 20, "stage2_signal": 20, "liquidity_signal": 10,
        "quality_signal": 20, "vcp_signal": 15, "breakout_signal": 15,
        "rs_signal": 0,
    },
    "VCP Setup": {
        "trend_signal": 15, "stage2_signal": 20, "liquidity_signal": 5,
        "quality_signal": 10, "vcp_signal": 40, "breakout_signal": 10,
        "rs_signal": 0,
    },
    "Breakout Day": {
        "trend_signal": 10, "stage2_signal": 10, "liquidity_signal": 10,
        "quality_signal": 5, "vcp_signal": 15, "breakout_signal": 50,
        "rs_signal": 0,
    },
    "RS Leaders": {
        "trend_signal": 20, "stage2_signal": 15, "liquidity_signal": 10,
        "quality_signal": 10, "vcp_signal": 5, "breakout_signal": 5,
        "rs_signal": 35,
    },
    "Quality Growth": {
        "trend_signal": 15, "stage2_signal": 15, "liquidity_signal": 5,
        "quality_signal": 40, "vcp_signal": 15, "breakout_signal": 10,
        "rs_signal": 0,
    },
    "Minervini A+": {"minervini_signal": 50, "vcp_signal": 30, "rs_signal": 20},
    "Darvas Breakout": {"darvas_signal": 60, "minervini_signal": 30, "rs_signal": 10},
    "Price Action": {
        "pa_signal": 60, "rs_signal": 20, "liquidity_signal": 10,
        "quality_signal": 10,
    },
    "Combined PA+EMA": {
        "pa_signal": 30, "stage2_signal": 15, "trend_signal": 15,
        "rs_signal": 15, "quality_signal": 15, "liquidity_signal": 5,
        "breakout_signal": 5,
    },
    "Trend Continuation": {
        "rs_new_high": 35, "rs_signal": 25, "minervini_signal": 20,
        "trend_signal": 10, "stage2_signal": 10,
    },
    "Intraday Picks": {
        "liquidity_signal": 35, "breakout_signal": 30, "rs_signal": 25,
        "trend_signal": 10,
    },
    "Swing Trading": {
        "vcp_signal": 30, "breakout_ready_signal": 25, "trend_signal": 20,
        "rs_signal": 15, "liquidity_signal": 10,
    },
    "Short Term Momentum": {
        "breakout_signal": 35, "pa_signal": 20, "rs_signal": 20,
        "trend_signal": 15, "stage2_signal": 10,
    },
    "Long Term Position": {
        "stage2_signal": 25, "minervini_signal": 25, "rs_new_high": 20,
        "quality_signal": 20, "trend_signal": 10,
    },
    "Trending Leaders": {
        "rs_new_high": 30, "minervini_signal": 25, "stage2_signal": 20,
        "rs_signal": 15, "trend_signal": 10,
    },
}
DEFAULT_PRESET = "Composite (Default)"

# Screen fields: display name -> column.
SCREEN_FIELDS = {
    "IC": "institutional_candidate",
    "Trend": "trend_signal",
    "Stage2": "stage2_signal",
    "VCP": "vcp_signal",
    "Breakout": "breakout_signal",
    "BO Ready": "breakout_ready_signal",
    "Liquid": "liquidity_signal",
    "Quality": "quality_signal",
    "RS": "rs_signal",
    "Score": "composite_score",
    "S2 Age(d)": "stage2_days",
    "Dist Pivot%": "distance_from_pivot_pct",
    "Dist 52w%": "distance_from_52w_high_pct",
    "Fund Score": "fund_quality_score",
    "ROE%": "fund_roe",
    "ROCE%": "fund_roce",
    "Promoter%": "fund_promoter_pct",
}
# Words accepted in place of 1 and 0.
VALUE_WORDS = {
    "tick": 1.0, "true": 1.0, "yes": 1.0, "on": 1.0,
    "cross": 0.0, "false": 0.0, "no": 0.0, "off": 0.0,
}

# Classifier inputs and settings.
ML_FEATURES = (
    "composite_score", "stage2_days", "stage2_signal", "trend_signal",
    "vcp_signal", "rs_signal", "minervini_signal", "quality_signal",
    "liquidity_signal", "pa_score", "mtf_score", "regime_score",
    "distance_from_pivot_pct", "base_range_pct",
)


@dataclass(frozen=True)
class MLRules:
    """Fixed values of the classifier."""

    win_reason: str = "TARGET"
    trees: int = 400
    patience: int = 50
    depth: int = 5
    learning_rate: float = 0.04
    min_child: int = 15
    subsample: float = 0.80
    feature_share: float = 0.80
    seed: int = 42
    min_rows: int = 50
    test_share: float = 0.20
    threshold: float = 0.60
    entry_signal: str = "breakout_signal"
    min_composite: float = 40.0


@dataclass(frozen=True)
class Settings:
    """All rule groups together."""

    cleaning: CleaningRules = field(default_factory=CleaningRules)
    features: FeatureRules = field(default_factory=FeatureRules)
    signals: SignalRules = field(default_factory=SignalRules)
    targets: TargetRules = field(default_factory=TargetRules)
    price_action: PriceActionRules = field(default_factory=PriceActionRules)
    timeframes: MultiTimeframeRules = field(default_factory=MultiTimeframeRules)
    regime: RegimeRules = field(default_factory=RegimeRules)
    sector: SectorRules = field(default_factory=SectorRules)
    backtest: BacktestRules = field(default_factory=BacktestRules)
    quality: QualityRules = field(default_factory=QualityRules)
    staleness: StalenessRules = field(default_factory=StalenessRules)
    screen: ScreenRules = field(default_factory=ScreenRules)
    ml: MLRules = field(default_factory=MLRules)


DEFAULTS = Settings()
