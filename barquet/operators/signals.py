"""Daily signals of a feature panel.

Each function adds columns and expects the ones before it. Facts keyed by date
or by symbol are joined in `attach_context` before any window, so the chain
after it runs on one exchange (symbol) and one sort (trade_date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.config import COMPOSITE_WEIGHTS, DEFAULTS
from barquet.functions.days import one_per_day
from barquet.functions.predicates import all_of, b, change, clip, flag, half_even, ratio
from barquet.functions.scalars import with_suffix
from barquet.functions.windows import Extreme, lag, last_off, roll, series, streak, streak_inputs, with_extremes
from barquet.schemas import require

C = F.col
R = DEFAULTS.signals



# ------------------------------------------------------------------ context
def latest_quality(fundamentals: DataFrame) -> DataFrame:
    """Newest known quality score per symbol, in panel symbol form."""
    return (
        fundamentals.filter(C("quality_score").isNotNull())
        .groupBy(with_suffix(C("symbol")).alias("symbol"))
        .agg(F.max_by("quality_score", "trade_date").alias("__quality"))
    )


def index_returns(index_bars: DataFrame) -> DataFrame:
    """Index return over the relative-strength lookback, by index and date."""
    w = series("index_code")
    return index_bars.select(
        "index_code", "trade_date",
        change(C("close"), F.lag("close", R.rs_bars).over(w)).alias("__index_return"),
    )


def attach_context(
    features: DataFrame,
    index_bars: DataFrame | None = None,
    fundamentals: DataFrame | None = None,
    index_code: str | None = None,
) -> DataFrame:
    """Join index returns and fundamentals onto the panel.

    The fundamentals side is keyed in panel form, so when it outgrows a
    broadcast the shuffle on symbol is the one the windows need anyway. The
    index side has one row per session, of the index named or of the only one.
    """
    out = features
    if fundamentals is None:
        out = out.withColumn("__quality", F.lit(None).cast("int"))
    else:
        out = out.join(latest_quality(fundamentals), "symbol", "left")
    if index_bars is None:
        return out.withColumn("__index_return", F.lit(None).cast("double"))
    returns = one_per_day(index_returns(index_bars), index_code).select("trade_date", "__index_return")
    return out.join(returns, "trade_date", "left")


# ------------------------------------------------------------------ shared windows
def _window_inputs() -> dict[str, Column]:
    """Window columns the signals share; all depend on features alone.

    Computed together they are one window operator instead of one per signal. The range peak
    is the only one over many rows and comes in two steps.
    """
    n, need = R.pivot_bars, R.pivot_min_bars
    close = C("close_price")
    return {
        "__ema_200_lag": lag("ema_200", R.trend_long_slope),
        "__ema_50_lag": lag("ema_50", R.trend_short_slope),
        "__bar_no": F.row_number().over(series()),
        "__eve": F.lead("is_earnings_day", 1, 0).over(series()) == 1,
        "__pivot": F.nullif(roll(F.max, close, n, need, shift=1), F.lit(0.0)),
        "__base": F.nullif(roll(F.min, close, n, need, shift=1), F.lit(0.0)),
        "__prev_close": lag("close_price"),
        "__prev_volume_10": lag("avg_volume_10"),
        "__rs_close": lag("close_price", R.rs_bars),
    }


def with_inputs(df: DataFrame, *names: str) -> DataFrame:
    """Add the shared window columns that are still missing."""
    every = _window_inputs()
    missing = [n for n in (names or (*every, "__atr_peak")) if n not in df.columns]
    if "__atr_peak" in missing:
        df = with_extremes(df, {"__atr_peak": Extreme(F.max, "atr_14", R.vcp_atr_bars, R.vcp_atr_min_bars)})
        missing.remove("__atr_peak")
    return df.withColumns({n: every[n] for n in missing}) if missing else df


# ------------------------------------------------------------------ trend
def trend_signal(df: DataFrame) -> DataFrame:
    """Stacked averages, both slopes up."""
    return with_inputs(df, "__ema_200_lag", "__ema_50_lag").withColumn(
        "trend_signal",
        flag(
            all_of(
                C("close_price") > C("ema_50"), C("ema_50") > C("ema_150"), C("ema_150") > C("ema_200"),
                C("ema_200") > C("__ema_200_lag"), C("ema_50") > C("__ema_50_lag"),
            )
        ),
    )


def stage2_signal(df: DataFrame) -> DataFrame:
    """Above rising long averages, in the top quarter of a full year's range.

    The stored 52-week columns equal the full-year range once the symbol has a
    year of bars, so no second 252-row window is evaluated.
    """
    df = with_inputs(df, "__ema_200_lag", "__bar_no")
    full_year = C("__bar_no") >= DEFAULTS.features.year_bars
    position = ratio(C("close_price") - C("low_52w"), C("high_52w") - C("low_52w"))
    return df.withColumn(
        "stage2_signal",
        flag(
            all_of(
                C("close_price") > C("ema_150"), C("close_price") > C("ema_200"),
                C("ema_200") > C("__ema_200_lag"),
                full_year, position >= R.stage2_range_position,
            )
        ),
    )


def stage2_age(df: DataFrame) -> DataFrame:
    """Length and start of the running Stage 2 streak."""
    return streak(df, C("stage2_signal") == 1, "stage2_days", "stage2_started_date")


# ------------------------------------------------------------------ contraction
def contraction_signals(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "ema_alignment_signal": flag(
                all_of(C("close_price") > C("ema_10"), C("ema_10") > C("ema_21"), C("ema_21") > C("ema_50"))
            ),
            "volume_contraction_signal": flag(C("relative_volume") < R.vcp_volume_ratio),
            "volatility_contraction_signal": flag(
                C("volatility_contraction") < R.vcp_volatility_ratio
            ),
        }
    )


def vcp_signal(df: DataFrame) -> DataFrame:
    """Contraction inside Stage 2, not on the eve of an announcement.

    The only look ahead is the next bar's announcement mark, known in advance.
    """
    df = with_inputs(df, "__atr_peak", "__eve")
    atr_share = F.coalesce(ratio(C("atr_14"), C("__atr_peak")), F.lit(1.0))
    return df.withColumn(
        "vcp_signal",
        flag(
            all_of(
                C("stage2_signal") == 1, C("ema_alignment_signal") == 1,
                C("volume_contraction_signal") == 1,
                C("volatility_contraction_signal") == 1,
                atr_share < R.vcp_atr_ratio, ~b(C("__eve")),
            )
        ),
    )


# ------------------------------------------------------------------ liquidity, quality
def liquidity_signal(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "liquidity_signal",
        flag(
            all_of(
                C("avg_volume_20") >= R.min_avg_volume_20,
                C("close_price") * C("avg_volume_20") >= R.min_traded_value,
            )
        ),
    )


def quality_signal(df: DataFrame, pass_score: int = 6) -> DataFrame:
    """Fundamental score where known, technical proxy elsewhere."""
    proxy = all_of(
        C("stage2_signal") == 1, C("trend_score") >= R.proxy_trend_score,
        C("avg_volume_20") >= R.min_avg_volume_20,
    )
    return df.withColumn(
        "quality_signal",
        F.when(C("__quality").isNotNull(), flag(C("__quality") >= pass_score))
        .otherwise(flag(proxy)),
    )


# ------------------------------------------------------------------ breakout
def pivot_levels(df: DataFrame) -> DataFrame:
    """Prior 20-bar high and low of the close, today excluded, and distances."""
    return with_inputs(df, "__pivot", "__base").withColumns(
        {
            "pivot_price": half_even(C("__pivot"), 2),
            "base_low_price": half_even(C("__base"), 2),
            "distance_from_pivot_pct": half_even(change(C("close_price"), C("__pivot")) * 100, 2),
            "distance_from_52w_high_pct": half_even(change(C("close_price"), C("high_52w")) * 100, 2),
        }
    )


def _stacked() -> Column:
    return all_of(
        C("ema_50") > C("ema_150"), C("ema_150") > C("ema_200"), C("close_price") > C("ema_200")
    )


def breakout_signal(df: DataFrame) -> DataFrame:
    """Close over the pivot with thirteen guards."""
    df = with_inputs(df, "__pivot", "__base", "__prev_close", "__prev_volume_10")
    gap = change(C("open_price"), C("__prev_close"))
    gap_trap = all_of(gap > R.breakout_max_gap, C("close_price") < C("open_price"))
    dry_up = ratio(C("__prev_volume_10"), C("avg_volume_20")) < R.breakout_dry_up
    base_range = ratio(C("__pivot") - C("__base"), C("__pivot"))
    close_position = ratio(C("close_price") - C("low_price"), C("high_price") - C("low_price"))
    late = all_of(C("stage2_days") > 0, C("stage2_days") > R.breakout_max_stage2_days)
    return df.withColumn(
        "breakout_signal",
        flag(
            all_of(
                _stacked(),
                C("close_price") > C("__pivot"),
                C("relative_volume") >= R.breakout_volume,
                change(C("close_price"), C("ema_50")) <= R.breakout_max_extension,
                close_position >= R.breakout_close_position,
                ~gap_trap,
                ~b(C("is_earnings_day") == 1),
                base_range < R.breakout_max_base_range,
                change(C("close_price"), C("low_52w")) >= R.breakout_min_gain_from_low,
                C("close_price") > C("ema_50"),
                C("distance_from_52w_high_pct") >= -R.breakout_max_below_high * 100,
                ~late,
                dry_up,
            )
        ),
    )


def breakout_ready_signal(df: DataFrame) -> DataFrame:
    """Within 3 % under the pivot in an uptrend."""
    near = ratio(C("close_price"), C("__pivot")) >= 1.0 - R.breakout_near_pivot
    return df.withColumn(
        "breakout_ready_signal", flag(all_of(_stacked(), near, ~b(C("close_price") > C("__pivot"))))
    )


# ------------------------------------------------------------------ relative strength
def relative_strength(df: DataFrame) -> DataFrame:
    """Return over the lookback against the index."""
    own = change(C("close_price"), C("__rs_close"))
    return with_inputs(df, "__rs_close").withColumn("__own", own).withColumns(
        {
            "rs_signal": flag(C("__own") > C("__index_return")),
            "rs_value": half_even((C("__own") - C("__index_return")) * 100, 2),
        }
    ).drop("__own")


def rs_past(df: DataFrame) -> DataFrame:
    """Highest relative strength of the year before, as `__rs_past`."""
    return with_extremes(df, {"__rs_past": Extreme(F.max, "rs_value", R.rs_high_bars, R.rs_high_min_bars, shift=1)})


def rs_new_high(df: DataFrame) -> DataFrame:
    """Relative strength above its own past year."""
    if "__rs_past" not in df.columns:
        df = rs_past(df)
    return df.withColumn("rs_new_high", flag(C("rs_value") > C("__rs_past"))).drop("__rs_past")


# ------------------------------------------------------------------ templates
def minervini_signal(df: DataFrame) -> DataFrame:
    """Eight-condition trend template."""
    df = with_inputs(df, "__ema_200_lag")
    below_high = ratio(C("high_52w") - C("close_price"), C("high_52w"))
    return df.withColumn(
        "minervini_signal",
        flag(
            all_of(
                C("close_price") > C("ema_150"), C("close_price") > C("ema_200"),
                C("ema_150") > C("ema_200"),
                C("ema_200") > C("__ema_200_lag"),
                C("ema_50") > C("ema_150"), C("ema_50") > C("ema_200"),
                C("close_price") > C("ema_50"),
                change(C("close_price"), C("low_52w")) >= R.template_min_gain_from_low,
                below_high <= R.template_max_below_high,
                C("rs_signal") == 1,
            )
        ),
    )


def darvas_signal(df: DataFrame) -> DataFrame:
    """Break of a tight box near the 52-week high.

    The box spans the same bars as the pivot, so its levels are reused.
    """
    box_range = ratio(C("__pivot") - C("__base"), C("__pivot"))
    below_high = ratio(C("high_52w") - C("close_price"), C("high_52w"))
    return df.withColumn(
        "darvas_signal",
        flag(
            all_of(
                below_high <= R.box_max_below_high,
                box_range < R.box_max_range,
                C("close_price") > C("__pivot"),
                C("relative_volume") >= R.box_volume,
                C("close_price") > C("ema_150"),
                ~b(C("is_earnings_day") == 1),
            )
        ),
    )


# ------------------------------------------------------------------ composite
def weighted_score(weights: dict[str, int], digits: int) -> Column:
    """0-100 score of 0/1 columns."""
    total = sum(weights.values())
    points = sum(
        (clip(F.coalesce(C(s).cast("double"), F.lit(0.0)), 0.0, 1.0) * F.lit(float(w))
         for s, w in weights.items()),
        F.lit(0.0),
    )
    return half_even(points / F.lit(float(total)) * 100, digits)


# Types whose values, cut to 0 and 1, are one of the two.
_WHOLE = ("tinyint", "smallint", "int", "bigint")
# Bits of a word of a set of points.
_WORD = 63


def _places_by_points(points: Column, total: int) -> tuple[dict[str, Column], Column, Column]:
    """(windows, place, number of levels) for whole points from 0 to `total`.

    A symbol's set of points is a bit map of a few words; the place of a row is the number of its
    levels that are not lower.
    """
    whole = Window.partitionBy("symbol")
    words = range(total // _WORD + 1)
    inside = {k: points.between(k * _WORD, k * _WORD + _WORD - 1) for k in words}
    bit = {k: F.when(inside[k], F.call_function("shiftleft", F.lit(1).cast("bigint"), points - k * _WORD)) for k in words}
    sets = {f"__levels_{k}": F.coalesce(F.bit_or(bit[k]).over(whole), F.lit(0).cast("bigint")) for k in words}
    place = sum(
        (F.when(inside[k], F.bit_count(F.call_function("shiftright", C(f"__levels_{k}"), points - k * _WORD)))
         .when(points < k * _WORD, F.bit_count(f"__levels_{k}")).otherwise(F.lit(0)) for k in words), F.lit(0),
    )
    return sets, place, sum((F.bit_count(n) for n in sets), F.lit(0))


def composite(df: DataFrame) -> DataFrame:
    """Composite score, its rank in the symbol's own history, candidate flag.

    The rank is dense and descending: scores take few distinct values, so the
    set of a symbol's scores ranks every row without sorting by score. Whole flags have
    whole points, whose set is a bit map.
    """
    df = df.withColumn("composite_score", weighted_score(COMPOSITE_WEIGHTS, 2))
    types = dict(df.dtypes)
    if all(types[c] in _WHOLE for c in COMPOSITE_WEIGHTS):
        points = sum(
            (F.when(C(c) >= 1, F.lit(w)).otherwise(F.lit(0)) for c, w in COMPOSITE_WEIGHTS.items()), F.lit(0)
        )
        sets, place, levels = _places_by_points(C("__points"), sum(COMPOSITE_WEIGHTS.values()))
        df = df.withColumn("__points", points).withColumns(sets)
    else:
        sets = {
            "__levels": F.sort_array(F.collect_set("composite_score").over(Window.partitionBy("symbol")), asc=False)
        }
        df = df.withColumns(sets)
        place, levels = F.array_position("__levels", C("composite_score")), F.size("__levels")
    return df.withColumns(
        {
            "composite_rank": ratio(place, levels) * 100,
            "institutional_candidate": flag(C("composite_score") >= R.min_composite),
        }
    ).drop("__points", *sets)


# ------------------------------------------------------------------ gate
DIRECTIONAL = (
    "trend_signal", "stage2_signal", "vcp_signal", "breakout_signal",
    "breakout_ready_signal",
)
BREAKOUTS = ("breakout_signal", "vcp_signal", "breakout_ready_signal")


def regime_gate(
    signals: DataFrame, gate: DataFrame, dates: DataFrame | None = None
) -> DataFrame:
    """Suppress signals on the latest date of the panel.

    `dates` is any table with the panel's trade dates; pass a stored one so the
    newest date comes from a one-column scan, not from the signals themselves.

    `gate` has one row per date: trade_date, allow_breakouts, cash_mode,
    distribution_count. Only its newest row counts, and it acts on the panel's
    newest date, so the switch is one row that is broadcast on that date. Past
    rows keep their signals for back-tests; rank, probability and expected
    value are not refreshed.
    """
    days = (dates or signals).select(C("trade_date").alias("day"))
    rules = gate.select(
        C("trade_date").alias("rule_day"),
        F.struct("allow_breakouts", "cash_mode", "distribution_count").alias("g"),
    )
    # One aggregate over both tables gives the one-row switch.
    switch = days.unionByName(rules, allowMissingColumns=True).agg(
        F.max("day").alias("trade_date"), F.max_by("g", "rule_day").alias("g")
    ).select(
        "trade_date",
        F.coalesce(C("g.cash_mode"), F.lit(False)).alias("__cash"),
        (
            ~F.coalesce(C("g.allow_breakouts"), F.lit(True))
            | (F.coalesce(C("g.distribution_count"), F.lit(0)) >= R.distribution_gate)
        ).alias("__shut"),
    )
    out = signals.join(F.broadcast(switch), "trade_date", "left")
    cash, shut = b(C("__cash")), b(C("__shut"))
    off = {
        c: F.when(cash | (shut & F.lit(c in BREAKOUTS)), 0).otherwise(C(c))
        for c in DIRECTIONAL
    }
    score = weighted_score(COMPOSITE_WEIGHTS, 2)
    return (
        out.withColumns(off)
        .withColumn(
            "composite_score", F.when(cash | shut, score).otherwise(C("composite_score"))
        )
        .withColumn(
            "institutional_candidate",
            F.when(cash | shut, flag(C("composite_score") >= R.min_composite))
            .otherwise(C("institutional_candidate")),
        )
        .select(*signals.columns)
    )


SIGNAL_INPUT = (
    "symbol", "trade_date", "open_price", "high_price", "low_price", "close_price",
    "ema_10", "ema_21", "ema_50", "ema_150", "ema_200", "trend_score",
    "avg_volume_10", "avg_volume_20", "relative_volume", "atr_14",
    "volatility_contraction", "high_52w", "low_52w", "is_earnings_day",
)


def raw_signals(
    features: DataFrame,
    index_bars: DataFrame | None = None,
    fundamentals: DataFrame | None = None,
    pass_score: int = 6,
) -> DataFrame:
    """Every signal up to the composite score.

    Windows come in three layers: those of features alone, those of the Stage 2
    flag and relative strength, and the symbol's set of scores.
    """
    base = with_inputs(
        attach_context(
            require(features, SIGNAL_INPUT).select(*SIGNAL_INPUT), index_bars, fundamentals
        ).withColumns(streak_inputs())
    )
    second = (
        base.transform(trend_signal).transform(stage2_signal).transform(relative_strength)
        .withColumn("__off", last_off(C("stage2_signal") == 1)).transform(rs_past)
    )
    return second.transform(later_flags, pass_score).transform(composite)


def later_flags(df: DataFrame, pass_score: int = 6) -> DataFrame:
    """Every flag after trend, Stage 2 and relative strength, whose windows are there."""
    return (
        df
        .transform(stage2_age)
        .transform(rs_new_high)
        .transform(contraction_signals)
        .transform(vcp_signal)
        .transform(liquidity_signal)
        .transform(quality_signal, pass_score)
        .transform(pivot_levels)
        .transform(breakout_signal)
        .transform(breakout_ready_signal)
        .transform(minervini_signal)
        .transform(darvas_signal)
    )
