"""Market regime, environment and breadth.

Index series hold one row per session; their windows are partitioned by index
and bounded by the calendar.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, FALLBACK_STATE
from barquet.functions.days import one_per_day
from barquet.functions.predicates import all_of, b, change, flag
from barquet.functions.windows import ema, roll, series

C = F.col
R = DEFAULTS.regime


def _sessions() -> WindowSpec:
    return series("index_code")


def enrich_index(index_bars: DataFrame) -> DataFrame:
    """Averages, long slope, 20-bar peak and higher highs of an index."""
    out = ema(index_bars, (50, 200), value="close", key="index_code")
    out = out.withColumns(
        {
            "ema_200_slope_pct": F.coalesce(
                change(C("ema_200"), F.lag("ema_200", R.slope_bars).over(_sessions())) * 100, F.lit(0.0)
            ),
            "peak_20": roll(F.max, C("close"), R.peak_bars, over=_sessions()),
        }
    )
    return out.withColumn(
        "higher_highs", b(C("peak_20") > F.lag("peak_20", R.higher_high_shift).over(_sessions()))
    )


def index_score(enriched: DataFrame) -> DataFrame:
    """Five tests of 20 points."""
    tests = (
        C("close") > C("ema_50"), C("close") > C("ema_200"), C("ema_50") > C("ema_200"),
        C("ema_200_slope_pct") > 0, C("higher_highs"),
    )
    return enriched.withColumn(
        "regime_score", sum((flag(t) for t in tests), F.lit(0)) * R.points
    )


def score_states(states: DataFrame) -> DataFrame:
    """One row per integer score: the active state with the highest lower bound.

    Unfolding the bounded integer ranges turns the interval lookup into an
    equi-join on the score.
    """
    return (
        states.filter(b(C("is_active")) & C("score_min").isNotNull() & C("score_max").isNotNull())
        .select(
            F.explode(F.sequence("score_min", "score_max")).alias("regime_score"),
            "state_code", "score_min",
        )
        .groupBy("regime_score")
        .agg(F.max_by("state_code", "score_min").alias("market_status"))
    )


def market_state(scored: DataFrame, states: DataFrame) -> DataFrame:
    """State of each score; scores outside every range are BEAR."""
    return scored.join(
        score_states(states), "regime_score", "left"
    ).withColumn("market_status", F.coalesce("market_status", F.lit(FALLBACK_STATE)))


def _regime_rows(numbered: DataFrame, states: DataFrame) -> DataFrame:
    return market_state(numbered, states).select(
        "index_code", "trade_date", "market_status",
        C("regime_score").cast("double").alias("regime_score"), C("close").alias("index_close"),
        "ema_50", "ema_200", (C("close") > C("ema_50")).alias("above_ema_50"),
        (C("close") > C("ema_200")).alias("above_ema_200"),
        (C("ema_50") > C("ema_200")).alias("ema_50_above_200"),
        "ema_200_slope_pct", "higher_highs",
    )


def regime_history(index_bars: DataFrame, states: DataFrame) -> DataFrame:
    """Regime of every session after the warm-up; nothing for short series."""
    numbered = index_score(enrich_index(index_bars)).withColumn(
        "__n", F.row_number().over(_sessions())
    )
    return _regime_rows(numbered.filter(C("__n") > R.warmup_bars), states)


def current_regime(index_bars: DataFrame, states: DataFrame) -> DataFrame:
    """Regime of the newest session; needs as many bars as the warm-up, not more."""
    whole = Window.partitionBy("index_code")
    numbered = index_score(enrich_index(index_bars)).withColumns(
        {"__n": F.row_number().over(_sessions()), "__bars": F.count("*").over(whole)}
    )
    newest = (C("__n") == C("__bars")) & (C("__bars") >= R.warmup_bars)
    return _regime_rows(numbered.filter(newest), states)


def environment(
    regime: DataFrame, states: DataFrame, index_code: str | None = None
) -> DataFrame:
    """Exposure and permissions of each session's state; unknown states are all off.

    One row per session: of the index named, or of the only one.
    """
    limits = states.select(
        C("state_code").alias("market_state"), "exposure_level", "max_position_size",
        "allow_breakouts", "allow_pyramiding", "cash_mode",
    )
    off = {"exposure_level": 0.0, "max_position_size": 0.0, "allow_breakouts": False,
           "allow_pyramiding": False, "cash_mode": True}
    return (
        one_per_day(regime, index_code)
        .select("trade_date", C("market_status").alias("market_state"), "regime_score")
        .join(limits, "market_state", "left")
        .withColumns({c: F.coalesce(C(c), F.lit(v)) for c, v in off.items()})
        .select("trade_date", "market_state", "regime_score", *off)
    )


def breadth(features: DataFrame) -> DataFrame:
    """Per date: is more than half of the panel above its 50-bar average?

    Null on thin dates. Partial counts combine map-side, so a date holding any
    share of the panel never gathers in one task.
    """
    known = features.filter(C("close_price").isNotNull() & C("ema_50").isNotNull())
    counts = known.groupBy("trade_date").agg(
        F.count("*").alias("total_stocks"),
        F.count_if(C("close_price") > C("ema_50")).alias("above_ema_50"),
    )
    return counts.withColumn(
        "breadth_positive",
        F.when(
            C("total_stocks") >= R.breadth_min_stocks,
            C("above_ema_50") / C("total_stocks") > R.breadth_threshold,
        ),
    )


def distribution_days(index_bars: DataFrame) -> DataFrame:
    """Down days on rising volume among the last 25 sessions, for every date."""
    heavy = all_of(
        change(C("close"), F.lag("close").over(_sessions())) <= -R.distribution_drop,
        C("volume") > F.lag("volume").over(_sessions()),
    )
    return index_bars.withColumn("__heavy", heavy.cast("int")).select(
        "index_code", "trade_date",
        F.sum("__heavy").over(_sessions().rowsBetween(-(R.distribution_bars - 1), 0)).cast("int")
        .alias("distribution_count"),
    )


def follow_through_day(index_bars: DataFrame) -> DataFrame:
    """Whether the latest correction has been answered by a follow-through day.

    Correction: last bar 5 % under its 20-bar peak. Low: first lowest close from
    there on. Rally: first up close after the low. Follow-through: from the
    rally's fourth day on, a rise of 1.7 % on rising volume.
    """
    whole = Window.partitionBy("index_code")
    rows = index_bars.withColumns(
        {
            "__n": F.row_number().over(_sessions()),
            "__prev": F.lag("close").over(_sessions()),
            "__up_volume": b(C("volume") > F.lag("volume").over(_sessions())),
            "__peak": roll(
                F.max, C("close"), R.follow_peak_bars, R.follow_peak_min_bars, over=_sessions()
            ),
        }
    )
    fallen = all_of(C("__n") > 5, C("__peak") > 0,
                    change(C("close"), C("__peak")) <= -R.correction)
    rows = rows.withColumn("__from", F.max(F.when(fallen, C("__n"))).over(whole))
    rows = rows.withColumn(
        "__low",
        F.min(
            F.when(C("__n") >= C("__from"), F.struct(C("close"), C("__n").alias("n")))
        ).over(whole)["n"],
    )
    rising = all_of(C("__n") > C("__low"), C("close") > C("__prev"))
    rows = rows.withColumn("__rally", F.min(F.when(rising, C("__n"))).over(whole))
    answered = all_of(
        C("__n") >= C("__rally") + (R.follow_min_day - 1),
        change(C("close"), C("__prev")) >= R.follow_min_rise, C("__up_volume"),
    )
    return rows.groupBy("index_code").agg(
        F.max("trade_date").alias("trade_date"),
        F.bool_or(answered).alias("follow_through_day"),
    )


def risk_off(volatility_index: DataFrame) -> DataFrame:
    """Latest volatility-index level above 20; null without data."""
    latest = volatility_index.filter(C("close").isNotNull()).agg(
        F.max("trade_date").alias("trade_date"), F.max_by("close", "trade_date").alias("level")
    )
    return latest.withColumn("vix_risk_off", C("level") > R.risk_off_level)


def regime_table(
    index_bars: DataFrame,
    states: DataFrame,
    features: DataFrame | None = None,
    volatility_index: DataFrame | None = None,
) -> DataFrame:
    """Regime history with breadth fields.

    Breadth and distribution days are known for every date; follow-through and
    the volatility level describe the newest session only.
    """
    out = regime_history(index_bars, states).join(
        distribution_days(index_bars), ["index_code", "trade_date"], "left"
    )
    none = F.lit(None).cast("boolean")
    if features is None:
        out = out.withColumn("breadth_positive", none)
    else:
        out = out.join(breadth(features).select("trade_date", "breadth_positive"),
                       "trade_date", "left")
    out = out.join(follow_through_day(index_bars), ["index_code", "trade_date"], "left")
    if volatility_index is None:
        return out.withColumn("vix_risk_off", none)
    return out.join(
        risk_off(volatility_index).select("trade_date", "vix_risk_off"), "trade_date", "left"
    )


def gate_rows(
    env: DataFrame, distribution: DataFrame, index_code: str | None = None
) -> DataFrame:
    """Inputs of the signal gate: permissions and distribution days by date."""
    days = one_per_day(distribution, index_code)
    return env.join(
        days.select("trade_date", "distribution_count"), "trade_date", "left"
    ).select("trade_date", "allow_breakouts", "cash_mode", "distribution_count")


def trading_calendar(regime: DataFrame, sessions: int) -> DataFrame:
    """Last n sessions with their 1-based position, oldest first."""
    recent = regime.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(sessions)
    return recent.withColumn(
        "session_no",
        F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("trade_date")),
    )


def environment_on(env: DataFrame, day: date) -> DataFrame:
    return env.filter(C("trade_date") == day).select(
        "market_state", "regime_score", "allow_breakouts", "cash_mode"
    )
