"""Read-side reports over the stored tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, PRESETS, UNKNOWN_SECTOR
from barquet.functions.predicates import all_of, b, change, flag
from barquet.functions.scalars import option_label, with_suffix
from barquet.operators.fundamentals import latest_fundamentals
from barquet.operators.screen import best_first
from barquet.operators.universe import current_members

C = F.col
R = DEFAULTS.screen

FUND = {"quality_score": "fund_quality_score", "promoter_holding": "fund_promoter_pct",
        "roe": "fund_roe", "roce": "fund_roce"}
# Report columns.
SCANNER_SIGNALS = (
    "symbol", "trade_date", "composite_score", "composite_rank",
    "institutional_candidate", "trend_signal", "stage2_signal", "vcp_signal",
    "breakout_signal", "breakout_ready_signal", "liquidity_signal", "quality_signal",
    "rs_signal", "rs_new_high", "minervini_signal", "darvas_signal",
    "distance_from_pivot_pct", "distance_from_52w_high_pct", "stage2_days",
    "stage2_started_date", "pivot_price", "base_range_pct", "target_3_price",
    "target_3_pct", "target_1_price", "target_1_pct", "target_2_price",
    "target_2_pct", "risk_reward_t2", "upside_prob_pct", "ev_score",
    "position_stage", "trailing_stop_price",
)
CONFIDENCES = ("confidence_t1", "confidence_t2", "confidence_t3")


def with_company(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Company name (the symbol where unknown) and sector ('Unknown')."""
    names = universe.select(
        with_suffix(C("symbol")).alias("symbol"), C("company_name").alias("__name"),
        C("sector").alias("__sector"),
    )
    return rows.join(names, "symbol", "left").withColumns(
        {
            "company_name": F.coalesce("__name", "symbol"),
            "sector": F.coalesce("__sector", F.lit(UNKNOWN_SECTOR)),
        }
    ).drop("__name", "__sector")


def scanner(
    signals: DataFrame,
    day: date,
    universe: DataFrame,
    fundamentals: DataFrame,
    price_action: DataFrame,
    timeframes: DataFrame,
    ml_scores: DataFrame | None = None,
    membership: DataFrame | None = None,
    index_code: str | None = None,
    min_score: float = 0.0,
    fetch_n: int | None = None,
) -> DataFrame:
    """One date's signals with every side table, best rows first.

    Each panel is cut to the date before it is joined, so partitioned tables
    are pruned and all joins meet on symbol alone.
    """
    on_day = C("trade_date") == day
    extra = [c for c in CONFIDENCES if c in signals.columns]
    rows = signals.filter(on_day & (C("composite_score") >= min_score)).select(
        *SCANNER_SIGNALS, *extra
    )
    if index_code is not None:
        rows = current_members(rows, membership, index_code)
    funds = latest_fundamentals(fundamentals).select(
        with_suffix(C("symbol")).alias("symbol"), *[C(c).alias(n) for c, n in FUND.items()]
    )
    pa = price_action.filter(on_day).select(
        "symbol", "pa_signal", C("pa_hh_daily").alias("pa_daily_trend"),
        C("pa_hh_weekly").alias("pa_weekly_trend"), "pa_score",
    )
    frames = timeframes.filter(on_day).select(
        "symbol", "mtf_weekly_trend", "mtf_monthly_trend", "mtf_score"
    )
    out = with_company(rows, universe)
    for side in (funds, pa, frames):
        out = out.join(side, "symbol", "left")
    if ml_scores is None:
        out = out.withColumns(
            {"ml_win_prob": F.lit(None).cast("double"), "ml_signal": F.lit(0)}
        )
    else:
        out = out.join(
            ml_scores.filter(on_day).select("symbol", "ml_win_prob", "ml_signal"),
            "symbol", "left",
        )
    zero_int = ("rs_new_high", "minervini_signal", "darvas_signal", "pa_signal",
                "pa_daily_trend", "pa_weekly_trend", "mtf_weekly_trend",
                "mtf_monthly_trend", "mtf_score", "ml_signal")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero_int}).withColumn(
        "pa_score", F.coalesce("pa_score", F.lit(0.0))
    ).orderBy(*best_first())
    return out.limit(fetch_n) if fetch_n is not None else out


# ------------------------------------------------------------------ pickers
def date_range(signals: DataFrame) -> DataFrame:
    return signals.agg(
        F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date")
    )


def trade_dates(signals: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct dates, newest first."""
    days = signals.select("trade_date").distinct().orderBy(F.desc("trade_date"))
    return days.limit(limit) if limit is not None else days


def nearest_date(signals: DataFrame, target: date) -> DataFrame:
    """Latest date not after the target."""
    return signals.filter(C("trade_date") <= target).agg(
        F.max("trade_date").alias("trade_date")
    )


def latest_price_date(prices: DataFrame, symbol: str) -> DataFrame:
    return prices.filter(C("symbol") == symbol).agg(F.max("trade_date").alias("trade_date"))


def symbols(signals: DataFrame) -> DataFrame:
    return signals.select("symbol").distinct().orderBy("symbol")


def symbol_options(
    signals: DataFrame, universe: DataFrame, day: date | None = None
) -> DataFrame:
    """Symbols with names and search labels, by name."""
    rows = signals if day is None else signals.filter(C("trade_date") == day)
    return (
        with_company(rows.select("symbol").distinct(), universe)
        .select("symbol", "company_name",
                option_label(C("company_name"), C("symbol")).alias("label"))
        .orderBy("company_name", "symbol")
    )


# ------------------------------------------------------------------ environment
ENVIRONMENT = ("trade_date", "market_state", "regime_score", "exposure_level",
               "allow_breakouts", "cash_mode")


def latest_environment(env: DataFrame) -> DataFrame:
    return env.select(*ENVIRONMENT).orderBy(F.desc("trade_date")).limit(1)


def last_active_date(env: DataFrame, before: date | None = None) -> DataFrame:
    """Latest date out of cash, optionally strictly before a date."""
    rows = env.filter(~b(C("cash_mode")))
    if before is not None:
        rows = rows.filter(C("trade_date") < before)
    return rows.agg(F.max("trade_date").alias("trade_date"))


def regime_history(env: DataFrame, limit: int = R.recent_dates) -> DataFrame:
    """Newest sessions, oldest first."""
    return (
        env.select("trade_date", "market_state", "regime_score", "exposure_level")
        .orderBy(F.desc("trade_date")).limit(limit).orderBy("trade_date")
    )


# ------------------------------------------------------------------ stocks
# Report columns.
DETAIL_FEATURES = (
    "symbol", "trade_date", "close_price", "high_52w", "low_52w", "ema_10", "ema_21",
    "ema_50", "ema_150", "ema_200", "atr_14", "volatility_contraction",
)
# Report columns.
DETAIL_SIGNALS = (
    "composite_score", "trend_signal", "stage2_signal", "vcp_signal", "breakout_signal",
    "breakout_ready_signal", "liquidity_signal", "quality_signal", "rs_signal",
    "distance_from_pivot_pct", "distance_from_52w_high_pct", "stage2_days",
    "stage2_started_date",
)


def stock_detail(
    features: DataFrame, signals: DataFrame, timeframes: DataFrame, symbol: str,
    bars: int = R.detail_bars,
) -> DataFrame:
    """Newest bars of one symbol with its signals, oldest first."""
    mine = C("symbol") == symbol
    key = ["symbol", "trade_date"]
    frames = ("mtf_weekly_trend", "mtf_monthly_trend", "mtf_score")
    newest = (
        features.filter(mine).select(*DETAIL_FEATURES)
        .orderBy(F.desc("trade_date")).limit(bars)
    )
    return (
        newest.join(signals.filter(mine).select(*key, *DETAIL_SIGNALS), key, "left")
        .join(timeframes.filter(mine).select(*key, *frames), key, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in frames})
        .orderBy("trade_date")
    )


def sector_stocks(
    signals: DataFrame, universe: DataFrame, day: date, sector: str,
    membership: DataFrame | None = None, index_code: str | None = None,
    top_n: int = R.top_n,
) -> DataFrame:
    """Best-scored stocks of one sector."""
    rows = signals.filter(C("trade_date") == day)
    if index_code is not None:
        rows = current_members(rows, membership, index_code)
    return (
        with_company(rows, universe).filter(C("sector") == sector)
        .select(
            "symbol", "company_name", "sector", "composite_score", "institutional_candidate",
            "trend_signal", "stage2_signal", "vcp_signal", "breakout_signal",
            "breakout_ready_signal", "liquidity_signal", "quality_signal", "rs_signal",
            "distance_from_pivot_pct", "distance_from_52w_high_pct",
        )
        .orderBy(F.desc("composite_score"), "symbol").limit(top_n)
    )


def stock_fundamentals(fundamentals: DataFrame, bare: str) -> DataFrame:
    """Newest fundamentals row of one symbol."""
    return (
        fundamentals.filter(C("symbol") == bare).orderBy(F.desc("trade_date")).limit(1)
    )


# ------------------------------------------------------------------ watchlist
def watchlist(
    signals: DataFrame, features: DataFrame, universe: DataFrame,
    signal_day: date, price_day: date,
    min_score: float = R.watchlist_score, stop_loss: float = DEFAULTS.backtest.stop_loss,
) -> DataFrame:
    """Set-ups of an earlier day and whether they still hold at today's price."""
    flags = ("stage2_signal", "trend_signal", "rs_signal", "liquidity_signal", "quality_signal")
    setups = signals.filter(
        (C("trade_date") == signal_day) & (C("composite_score") >= min_score)
        & all_of(*[C(f) == 1 for f in flags])
    ).select(
        "symbol", "composite_score", "stage2_days", "pivot_price",
        C("distance_from_pivot_pct").alias("dist_pivot_signal_day"),
        "target_1_price", "target_2_price", "ev_score",
    )
    today = features.filter(C("trade_date") == price_day).select(
        "symbol", C("close_price").alias("current_close"), C("ema_50").alias("current_ema50")
    )
    holding = flag(
        all_of(
            C("current_close") >= C("pivot_price") * (1.0 - stop_loss),
            C("current_close") >= C("current_ema50"),
        )
    )
    distance: Column = F.round(change(C("current_close"), C("pivot_price")) * 100, 1)
    return (
        with_company(setups.join(today, "symbol"), universe)
        .withColumns({"is_holding": holding, "current_dist_pivot_pct": distance})
        .orderBy(F.desc("is_holding"), C("current_dist_pivot_pct").desc_nulls_last(), "symbol")
    )


def watchlist_counts(rows: DataFrame) -> DataFrame:
    """Set-ups holding and breaking down."""
    return rows.groupBy("is_holding").agg(F.count("*").alias("stocks"))


# ------------------------------------------------------------------ presets
PRESET_SCHEMA = (
    "preset_name string, signal_name string, weight int, is_active boolean, "
    "is_default boolean, sort_order int"
)


def preset_table(
    spark: SparkSession, presets: Mapping[str, Mapping[str, int]] = PRESETS
) -> DataFrame:
    """Screen presets as a table; the first one is the default."""
    rows = [
        (name, signal, weight, True, i == 0, i + 1)
        for i, (name, weights) in enumerate(presets.items())
        for signal, weight in weights.items()
    ]
    return spark.createDataFrame(rows, PRESET_SCHEMA)


def load_presets(table: DataFrame) -> tuple[dict[str, dict[str, int]], str]:
    """Active presets in display order and the default's name.

    A configuration table of a few dozen rows; built-in presets serve when it
    is empty.
    """
    rows = (
        table.filter(b(C("is_active")))
        .orderBy("sort_order", "preset_name", "signal_name").collect()
    )
    if not rows:
        return {n: dict(w) for n, w in PRESETS.items()}, next(iter(PRESETS))
    out: dict[str, dict[str, int]] = {}
    for row in rows:
        out.setdefault(row.preset_name, {})[row.signal_name] = row.weight
    default = next((r.preset_name for r in rows if r.is_default), next(iter(PRESETS)))
    return out, default
