"""The daily tables one delivery of bars further, without reading history.

A state table has one row per symbol: how many bars there are, the last rows of features and
flags (`RECENT` of them), the values that longer windows look back on (closes, true ranges and relative
strengths of `TAIL` rows), the last two weeks and months with their averages, and how often each
composite score occurs. A delivery is folded into it:

* New bars behind a symbol's last one are laid after its recent rows, and the operators of the full build run over
  that short panel. Windows that look back further come from the tail's values, as arrays. Exponential averages go on
  from the last values, positions and streaks from the counters, week and month averages from the last closed period.
* The row before a delivery changes in one case: its contraction signal looks at the next bar's announcement
  mark. It is computed again with the new rows.
* A rank depends on the set of a symbol's distinct scores. Where a delivery changes the set, and only there,
  the ranks of the symbol's stored rows are written again, from scores and set, without a window.
* Weekly and monthly averages exist once a symbol has enough periods. Where a delivery reaches that
  number, the symbol's timeframe rows are built again.
* Symbols that cannot go on from their state are built again from their bars, and only they: new symbols, late
  bars (before the last one, not stored yet), a changed quality score, a delivery of more than `MOST_BARS` bars, and
  what the caller names (`again`: corrected bars or announcements of past days).

Bars, features, signals (before the market gate, which acts on the newest day when it is served),
price action, timeframes and state are committed together (see `sources.snapshots`): readers see all of a
delivery or nothing, and a delivery that is offered twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, EMA_SPANS, FEATURE_COLUMNS, PRICE_COLUMNS
from barquet.functions.predicates import ratio
from barquet.functions.windows import (
    asof_backward, ema, ema_onward, month_label, resample_last, series, week_label,
)
from barquet.operators import features as feature_operators
from barquet.operators import price_action as actions
from barquet.operators import signals as flags
from barquet.operators.cleaning import valid_candles
from barquet.operators.targets import targets
from barquet.operators.timeframes import TIMEFRAME_COLUMNS, timeframe_trend, timeframes
from barquet.plans.daily import SIGNAL_COLUMNS, feature_table, signal_table
from barquet.session import at_once, discard, materialize
from barquet.sources.layout import Tiles
from barquet.sources.scans import PRICE_ACTION_INPUT
from barquet.sources.snapshots import Snapshots, Transaction

C = F.col
KEY = ("symbol", "trade_date")

_D = DEFAULTS
# The longest window: a year of relative strength before the row, for the last stored row as well.
TAIL = max(_D.signals.rs_high_bars, _D.features.year_bars) + 1
# What all other windows look back on; the contraction of the volatility is a window over another one.
RECENT = 2 + max(
    20, _D.features.slope_bars, _D.features.atr_bars, 2 * _D.features.volatility_bars, _D.signals.pivot_bars,
    _D.signals.trend_long_slope, _D.signals.trend_short_slope,
)
# Price action: a window and its value some days ago, or the weeks of both and those the ends are in.
_STRUCTURE = 1 + max(
    _D.price_action.daily_bars + _D.price_action.daily_shift,
    7 * (_D.price_action.weekly_bars + _D.price_action.weekly_shift + 3),
)
MOST_BARS = 200

# What recent rows keep of a signal row.
_KEPT = ("stage2_signal", "stage2_days", "stage2_started_date", "rs_value", "vcp_signal", "composite_score")
_ROW = tuple(c for c in FEATURE_COLUMNS if c != "symbol") + _KEPT
# What long windows read.
_VALUES = ("trade_date", "close_price", "atr_14", "rs_value")


@dataclass(frozen=True)
class _Frame:
    """A timeframe: its label of a day and the spans of its averages."""

    name: str
    fast: int
    slow: int
    need: int

    def label(self) -> Column:
        return week_label() if self.name == "weeks" else month_label()


_R = DEFAULTS.timeframes
FRAMES = (
    _Frame("weeks", _R.weekly_fast, _R.weekly_slow, _R.weekly_min_bars),
    _Frame("months", _R.monthly_fast, _R.monthly_slow, _R.monthly_min_bars),
)
_PERIOD = ("end", "close", "fast", "slow", "fast_before", "slow_before")


@dataclass(frozen=True)
class Facts:
    """What bars are joined with."""

    earnings: DataFrame | None = None
    index_bars: DataFrame | None = None
    fundamentals: DataFrame | None = None
    pass_score: int = 6


# ------------------------------------------------------------------ state from whole tables
def _last_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(order)))).filter(
        C("__n") <= n
    ).drop("__n")


def _periods(bars: DataFrame, frame: _Frame) -> DataFrame:
    """Last two periods and the number of periods per symbol, from all bars."""
    rows = resample_last(bars.select("symbol", "trade_date", "close_price"), frame.label(), "end")
    rows = ema(rows, (frame.fast, frame.slow), order="end", names={frame.fast: "fast", frame.slow: "slow"})
    w = series(order="end")
    rows = rows.withColumnRenamed("close_price", "close").withColumns(
        {
            "fast_before": F.lag("fast").over(w), "slow_before": F.lag("slow").over(w),
            "__count": F.count("*").over(Window.partitionBy("symbol")),
        }
    )
    last = _last_rows(rows, 2, "end")
    return last.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct(*_PERIOD))).alias(frame.name),
        F.first("__count").alias(f"n_{frame.name}"),
    )


def _quality(facts: Facts) -> DataFrame | None:
    return None if facts.fundamentals is None else flags.latest_quality(facts.fundamentals).withColumnRenamed("__quality", "quality")


def initial_state(features: DataFrame, signals: DataFrame, facts: Facts) -> DataFrame:
    """State rows of symbols from their whole tables."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    rows = features.join(signals.select(*KEY, *_KEPT), list(KEY)).withColumn("__n", back).filter(C("__n") <= TAIL)
    tail = rows.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct(*_VALUES))).alias("tail"),
        F.sort_array(F.collect_list(F.when(C("__n") <= RECENT, F.struct(*_ROW)))).alias("recent"),
    )
    counts = features.groupBy("symbol").agg(F.count("*").alias("bars"), F.max("trade_date").alias("last_date"))
    scores = signals.groupBy("symbol", "composite_score").agg(F.count("*").alias("n")).groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("composite_score", "n"))).alias("scores")
    )
    out = counts.join(tail, "symbol").join(scores, "symbol")
    for frame in FRAMES:
        out = out.join(_periods(features, frame), "symbol")
    quality = _quality(facts)
    out = out.withColumn("quality", F.lit(None).cast("int")) if quality is None else out.join(quality, "symbol", "left")
    return out.select(*_state_columns())


def _state_columns() -> list[str]:
    return ["symbol", "last_date", "bars", "quality", "tail", "recent", "scores", *[c for f in FRAMES for c in (f.name, f"n_{f.name}")]]


# ------------------------------------------------------------------ build
def _after_signals(features: DataFrame, signals: DataFrame, facts: Facts) -> dict[str, DataFrame]:
    """The tables that follow from stored features and signals."""
    return {
        "price_action": actions.price_action(features),
        "timeframes": timeframes(features),
        "state": initial_state(features, signals, facts),
    }


class _Temporary:
    """Tables that one delivery stores for itself."""

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        self._frames.append(materialize(df, name))
        return self._frames[-1]

    def __enter__(self) -> _Temporary:
        return self

    def __exit__(self, *_) -> None:
        discard(*self._frames)


def _built(bars: DataFrame, facts: Facts, temporary: _Temporary) -> dict[str, DataFrame]:
    """All tables of some symbols from their whole histories; features and signals are stored."""
    features = temporary.store(feature_table(bars, facts.earnings), "fold_features")
    signals = temporary.store(
        signal_table(features, facts.index_bars, facts.fundamentals, facts.pass_score), "fold_signals"
    )
    return {"features": features, "signals": signals, **_after_signals(features, signals, facts)}


def build(store: Snapshots, bars: DataFrame, facts: Facts, files: int = 64) -> int:
    """All tables from the whole history, in one transaction; panels lie in tiles of symbols and
    dates, on so many files each. A table is written once, later ones are computed from its tiles."""
    spark = store.spark
    clean = materialize(valid_candles(bars), "fold_clean")
    tiles = Tiles.of(clean, files)
    with store.transaction() as t:
        at_once(
            spark, lambda: t.rebuild(clean, "bars", tiles),
            lambda: t.rebuild(feature_table(clean, facts.earnings), "features", tiles),
        )
        features = t.read("features")
        t.rebuild(signal_table(features, facts.index_bars, facts.fundamentals, facts.pass_score), "signals", tiles)
        rest = _after_signals(features, t.read("signals"), facts)
        at_once(spark, *[
            lambda name=name, df=df: t.rebuild(df, name, () if name == "state" else tiles) for name, df in rest.items()
        ])
    discard(clean)
    return store.version()


# ------------------------------------------------------------------ one delivery
def _sorted_out(
    t: Transaction, delivered: DataFrame, state: DataFrame, facts: Facts, again: DataFrame | None, temporary: _Temporary
):
    """(bars to fold, symbols to build again, all bars that are not stored yet)."""
    heads = state.select("symbol", "last_date", "quality")
    bars = temporary.store(
        valid_candles(delivered).join(heads.select("symbol", "last_date"), "symbol", "left"), "delivered"
    )
    behind = bars.filter(C("trade_date") <= C("last_date"))
    first, last = behind.agg(F.min("trade_date"), F.max("trade_date")).first()
    bars = bars.filter(C("last_date").isNull() | (C("trade_date") > C("last_date")))
    if first is not None:
        # Only now are stored bars looked at, and of these days alone.
        stored = t.read("bars").filter(C("trade_date").between(first, last)).select(*KEY)
        bars = temporary.store(bars.unionByName(behind.join(stored, list(KEY), "left_anti")), "unknown")
    by_symbol = bars.groupBy("symbol").agg(
        F.count("*").alias("n"), F.bool_or(F.coalesce(C("trade_date") <= C("last_date"), F.lit(True))).alias("unfit")
    )
    rebuilt = by_symbol.filter(C("unfit") | (C("n") > MOST_BARS)).select("symbol")
    quality = _quality(facts)
    if quality is not None:
        changed = heads.join(quality.withColumnRenamed("quality", "now"), "symbol", "left")
        rebuilt = rebuilt.unionByName(changed.filter(~C("quality").eqNullSafe(C("now"))).select("symbol"))
    if again is not None:
        rebuilt = rebuilt.unionByName(again.select("symbol"))
    rebuilt = temporary.store(rebuilt.distinct(), "built_again")
    bars = bars.select(*PRICE_COLUMNS)
    return bars.join(rebuilt, "symbol", "left_anti"), rebuilt, bars


def _window(values: Column, n: int, shift: int = 0) -> Column:
    """The last n values of an array, `shift` values before its end."""
    end = F.size(values) - shift
    start = F.greatest(end - n + 1, F.lit(1))
    return F.slice(values, start, F.greatest(end - start + 1, F.lit(0)))


def _extreme(agg: Callable[[Column], Column], values: Column, n: int, min_periods: int, shift: int = 0) -> Column:
    """`roll` over an array: null until the window holds `min_periods` values."""
    seen = _window(values, n, shift)
    return F.when(F.size(F.array_compact(seen)) >= min_periods, agg(seen))


def _short_panel(bars: DataFrame, state: DataFrame, facts: Facts) -> DataFrame:
    """Recent rows followed by new bars with their features; `__new` marks the latter. Every row
    carries its symbol's number of bars before the panel and the last stored row; the last stored row and
    those after it carry the tail as well."""
    r = DEFAULTS.features
    wanted = bars.select("symbol").distinct()
    known = state.join(wanted, "symbol", "left_semi").select(
        "symbol", (C("bars") - F.size("recent")).alias("__before"), F.element_at("recent", -1).alias("__last"), "tail", "recent"
    )
    marked = feature_operators.earnings_mark(bars, facts.earnings)
    onward = ema_onward(marked.join(known.drop("recent"), "symbol"), EMA_SPANS, {s: C(f"__last.ema_{s}") for s in EMA_SPANS})
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    onward = onward.withColumn("__closes", F.concat("tail.close_price", F.collect_list("close_price").over(upto)))
    onward = onward.withColumns(
        {
            "__high_52w": _extreme(F.array_max, C("__closes"), r.year_bars, r.year_min_bars),
            "__low_52w": _extreme(F.array_min, C("__closes"), r.year_bars, r.year_min_bars),
            "__rs_close": _back(C("__closes"), DEFAULTS.signals.rs_bars),
        }
    ).drop("__closes").withColumnRenamed("tail", "__tail")
    is_last = C("__at") == F.size("recent") - 1
    kept = known.select("symbol", "__before", "__last", "tail", "recent", F.posexplode("recent").alias("__at", "__row")).select(
        "symbol", "__before", "__last", F.when(is_last, C("tail")).alias("__tail"), *[C(f"__row.{c}").alias(c) for c in _ROW],
        C("__row.high_52w").alias("__high_52w"), C("__row.low_52w").alias("__low_52w"),
        F.when(is_last, _back(C("tail.close_price"), DEFAULTS.signals.rs_bars)).alias("__rs_close"), F.lit(False).alias("__new"),
    )
    names = [c for c in FEATURE_COLUMNS if c not in onward.columns]
    # Feature operators overwrite their columns on all rows; the stored values of recent rows are put back.
    stored = F.when(~C("__new"), F.struct(*_ROW))
    panel = kept.unionByName(onward.withColumn("__new", F.lit(True)), allowMissingColumns=True).withColumn("__stored", stored)
    panel = (
        panel.drop(*names)
        .withColumnsRenamed({"__high_52w": "high_52w", "__low_52w": "low_52w"})
        .transform(feature_operators._bar_windows)
        .transform(feature_operators.trend_score)
        .transform(feature_operators.weinstein_stage)
        .transform(feature_operators.volume_averages)
        .transform(feature_operators.volatility)
        .transform(feature_operators.year_range)
    )
    return panel.withColumns({c: F.when(C("__new"), C(c)).otherwise(C(f"__stored.{c}")) for c in names}).select(
        *FEATURE_COLUMNS, "__new", "__before", "__last", "__stored", "__tail", "__rs_close"
    )


def _back(values: Column, n: int) -> Column:
    """The value n before an array's last one, null where there is none."""
    return F.get(values, F.size(values) - 1 - n)


def _with_new(name: str) -> Column:
    """The tail's values and those of new rows up to this one; null before the last stored row."""
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    new = F.collect_list(F.when(C("__new"), F.struct(C(name).alias("v")))).over(upto)
    return F.concat(C(f"__tail.{name}"), new["v"])


def _signal_rows(panel: DataFrame, facts: Facts) -> DataFrame:
    """Signals up to the composite score of new rows and of the last stored one."""
    w = series()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    position = C("__before") + F.row_number().over(w)
    r = DEFAULTS.signals
    staged = flags.attach_context(panel, facts.index_bars, facts.fundamentals).withColumns(
        {"__pos": position, "__bar_no": position, "__next": F.lead("trade_date").over(w), "__start": C("trade_date"),
         "__atrs": _with_new("atr_14")}
    )
    staged = flags.with_inputs(
        staged.withColumn("__atr_peak", _extreme(F.array_max, C("__atrs"), r.vcp_atr_bars, r.vcp_atr_min_bars)).drop("__atrs")
    )
    staged = staged.transform(flags.trend_signal).transform(flags.stage2_signal).transform(flags.relative_strength)
    old = ~C("__new")
    staged = staged.withColumns(
        {
            "stage2_signal": F.when(old, C("__stored.stage2_signal")).otherwise(C("stage2_signal")),
            "rs_value": F.when(old, C("__stored.rs_value")).otherwise(C("rs_value")),
        }
    )

    def off(p: Column, d: Column) -> Column:
        return F.struct(p.alias("p"), d.alias("d"))

    # The last row without the flag: among the new ones, else as the streak of the last stored row says.
    fresh_off = F.last(F.when(C("__new") & (C("stage2_signal") != 1), off(C("__pos"), C("__next"))), ignorenulls=True)
    first_new = F.min(F.when(C("__new"), C("trade_date"))).over(Window.partitionBy("symbol"))
    last_pos = F.max(F.when(old, C("__pos"))).over(Window.partitionBy("symbol"))
    staged = staged.withColumns(
        {"__fresh_off": fresh_off.over(upto), "__first_new": first_new, "__last_pos": last_pos, "__rs": _with_new("rs_value")}
    )
    past = _extreme(F.array_max, C("__rs"), r.rs_high_bars, r.rs_high_min_bars, 1)
    staged = staged.withColumn("__rs_past", past).drop("__rs", "__tail")
    carried = off(
        C("__last_pos") - C("__last.stage2_days"), F.coalesce(C("__last.stage2_started_date"), C("__first_new"))
    )
    stored = off(C("__pos") - C("__stored.stage2_days"), C("__stored.stage2_started_date"))
    staged = staged.withColumn("__off", F.when(old, stored).otherwise(F.coalesce(C("__fresh_off"), carried)))
    last_row = C("__pos") == C("__last_pos")
    wanted = staged.withColumn("__wanted", C("__new") | last_row)
    done = wanted.transform(flags.later_flags, facts.pass_score).filter("__wanted")
    score = flags.weighted_score(flags.COMPOSITE_WEIGHTS, 2)
    done = done.withColumns(
        {
            "composite_score": score, "composite_rank": F.lit(None).cast("double"),
            "institutional_candidate": flags.flag(score >= DEFAULTS.signals.min_composite),
        }
    )
    # The stored last row is wanted only where the next bar's announcement silences its contraction signal.
    return targets(done).filter(C("__new") | (C("vcp_signal") != C("__last.vcp_signal")))


def _price_action_rows(panel: DataFrame) -> DataFrame:
    closes = panel.filter(~C("__new") & C("__tail").isNotNull()).select(
        "symbol", F.explode(_window(C("__tail"), _STRUCTURE)).alias("__row"), F.lit(False).alias("__new")
    ).select("symbol", "__row.trade_date", "__row.close_price", "__new")
    rows = panel.filter("__new").select(*PRICE_ACTION_INPUT, "__new").unionByName(closes, allowMissingColumns=True)
    return (
        rows
        .transform(actions.daily_structure).transform(actions.weekly_structure).transform(actions.price_action_score)
        .filter("__new").select(*actions.PRICE_ACTION_COLUMNS)
    )


def _periods_onward(bars: DataFrame, state: DataFrame, frame: _Frame) -> DataFrame:
    """The stored last two periods and those of new bars, with averages and the ones before.

    The first stored one of two is closed and stays; the second may still grow.
    """
    known = state.join(bars.select("symbol").distinct(), "symbol", "left_semi").select(
        "symbol", C(f"n_{frame.name}").alias("__n"), F.posexplode(frame.name).alias("__at", "__p"),
        F.size(frame.name).alias("__size"),
    ).select(
        "symbol", "__n", C("__p.end").alias("end"), C("__p.close").alias("close_price"), F.lit(0).alias("__new"),
        ((C("__size") == 2) & (C("__at") == 0)).alias("__closed"),
        *[C(f"__p.{c}").alias(f"__{c}") for c in _PERIOD[2:]],
    )
    last_end = known.groupBy("symbol").agg(F.max("end").alias("__last_end"), F.first("__n").alias("__n"))
    fresh = resample_last(bars.select("symbol", "trade_date", "close_price"), frame.label(), "end").withColumn("__new", F.lit(1))
    rows = known.drop("__n").unionByName(fresh, allowMissingColumns=True)
    merged = rows.groupBy("symbol", "end").agg(
        F.max_by("close_price", "__new").alias("close_price"), F.bool_or(F.coalesce("__closed", F.lit(False))).alias("__closed"),
        *[F.max(f"__{c}").alias(f"__{c}") for c in _PERIOD[2:]],
    ).join(last_end, "symbol")
    whole, w = Window.partitionBy("symbol"), series(order="end")
    seeds = {
        frame.fast: F.max(F.when(C("__closed"), C("__fast"))).over(whole),
        frame.slow: F.max(F.when(C("__closed"), C("__slow"))).over(whole),
    }
    merged = merged.withColumns(
        {"__seed_fast": seeds[frame.fast], "__seed_slow": seeds[frame.slow],
         "__total": C("__n") + F.sum((C("end") > C("__last_end")).cast("int")).over(whole)}
    )
    closed = merged.filter("__closed").withColumns({"fast": C("__fast"), "slow": C("__slow")})
    open_ = ema_onward(
        merged.filter(~C("__closed")), (frame.fast, frame.slow),
        {frame.fast: C("__seed_fast"), frame.slow: C("__seed_slow")}, order="end",
        names={frame.fast: "fast", frame.slow: "slow"},
    )
    return closed.unionByName(open_).withColumnRenamed("close_price", "close").withColumns(
        {
            "fast_before": F.when(C("__closed"), C("__fast_before")).otherwise(F.lag("fast").over(w)),
            "slow_before": F.when(C("__closed"), C("__slow_before")).otherwise(F.lag("slow").over(w)),
        }
    ).select("symbol", *_PERIOD, "__total", "__n")


def _timeframe_rows(bars: DataFrame, periods: dict[str, DataFrame]) -> DataFrame:
    sides = {}
    for frame in FRAMES:
        enough = C("__total") >= frame.need
        sides[f"__{frame.name}"] = (
            periods[frame.name].select(
                "symbol", "end", F.when(enough, C("fast_before")).alias("fast"), F.when(enough, C("slow_before")).alias("slow")
            ), "end",
        )
    merged = asof_backward(bars.select("symbol", "trade_date", "close_price"), sides)
    return merged.withColumns(
        {
            "mtf_w_ema_fast": C("__weeks.fast"), "mtf_w_ema_slow": C("__weeks.slow"),
            "mtf_m_ema_fast": C("__months.fast"), "mtf_m_ema_slow": C("__months.slow"),
        }
    ).transform(timeframe_trend).select(*TIMEFRAME_COLUMNS)


def _rank(score: Column, scores: Column) -> Column:
    """Dense falling rank of a score among a symbol's distinct scores, in percent."""
    levels = F.sort_array(F.map_keys(scores), asc=False)
    return ratio(F.array_position(levels, score), F.size(levels)) * 100


def _score_changes(fresh: DataFrame) -> DataFrame:
    """How often each score comes or goes, as one map per symbol."""
    scores = fresh.select("symbol", "composite_score", F.lit(1).alias("n"))
    scores = scores.unionByName(
        fresh.filter(~C("__new")).select("symbol", C("__last.composite_score").alias("composite_score"), F.lit(-1).alias("n"))
    )
    return scores.groupBy("symbol", "composite_score").agg(F.sum("n").alias("n")).groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("composite_score", "n"))).alias("__changes")
    )


def _next_state(state: DataFrame, fresh: DataFrame, periods: dict[str, DataFrame]) -> DataFrame:
    """States of the folded symbols after the delivery, with marks: `__moved` where the set of
    scores is another one, `__reached` where there are enough periods for averages now."""
    rows = fresh.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.when(C("__new"), F.struct(*_ROW)))).alias("__rows"),
        F.first(F.when(~C("__new"), F.struct(*_KEPT)), ignorenulls=True).alias("__revised"),
    )
    out = state.join(rows, "symbol").join(_score_changes(fresh), "symbol")
    size = F.size("recent")
    last = F.element_at("recent", -1)
    revised = F.when(
        C("__revised").isNotNull(),
        last.withField("vcp_signal", C("__revised.vcp_signal")).withField("composite_score", C("__revised.composite_score")),
    ).otherwise(last)
    recent = F.concat(F.slice("recent", 1, size - 1), F.array(revised), C("__rows"))
    values = F.transform("__rows", lambda row: F.struct(*[row[c].alias(c) for c in _VALUES]))
    merged = F.map_zip_with("scores", "__changes", lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    out = out.withColumns(
        {
            "tail": _window(F.concat("tail", values), TAIL),
            "recent": _window(recent, RECENT),
            "bars": C("bars") + F.size("__rows"),
            "last_date": F.element_at("__rows", -1)["trade_date"],
            "__old": F.sort_array(F.map_keys("scores")),
            "scores": F.map_filter(merged, lambda k, n: n > 0),
        }
    )
    reached = F.lit(False)
    for frame in FRAMES:
        last_two = _last_rows(periods[frame.name], 2, "end").groupBy("symbol").agg(
            F.sort_array(F.collect_list(F.struct(*_PERIOD))).alias(frame.name), F.first("__total").alias(f"n_{frame.name}")
        )
        out = out.withColumnRenamed(f"n_{frame.name}", f"__n_{frame.name}").drop(frame.name).join(last_two, "symbol")
        reached |= (C(f"__n_{frame.name}") < frame.need) & (C(f"n_{frame.name}") >= frame.need)
    return out.select(
        *_state_columns(), (F.sort_array(F.map_keys("scores")) != C("__old")).alias("__moved"), reached.alias("__reached")
    )


@dataclass(frozen=True)
class Report:
    """What a delivery did; all numbers are symbols but `version`."""

    version: int
    folded: int
    built_again: int
    ranks_rewritten: int
    timeframes_rewritten: int


def apply(store: Snapshots, delivered: DataFrame, facts: Facts, again: DataFrame | None = None) -> Report:
    """Fold a delivery of bars into the stored tables, in one transaction."""
    with _Temporary() as temporary:
        return _folded(store, delivered, facts, again, temporary)


def _folded(
    store: Snapshots, delivered: DataFrame, facts: Facts, again: DataFrame | None, temporary: _Temporary
) -> Report:
    t = store.transaction()
    state = t.read("state")
    bars, rebuilt, unknown = _sorted_out(t, delivered, state, facts, again, temporary)
    n_rebuilt = rebuilt.count()
    if unknown.isEmpty() and n_rebuilt == 0:
        return Report(store.version(), 0, 0, 0, 0)

    # What the fold computes, each piece stored before it is used twice.
    bars = temporary.store(bars, "fold_bars")
    spark = store.spark

    def panel_and_signals() -> tuple[DataFrame, DataFrame]:
        rows = temporary.store(_short_panel(bars, state, facts), "fold_panel")
        return rows, temporary.store(_signal_rows(rows, facts), "fold_signals")

    def built_again() -> dict[str, DataFrame]:
        # Bars first: symbols that are built again read them from here.
        t.append(unknown, "bars")
        return _built(t.read("bars").join(rebuilt, "symbol", "left_semi"), facts, temporary) if n_rebuilt else {}

    (panel, fresh), again_built, *stored = at_once(spark, panel_and_signals, built_again, *[
        lambda f=f: temporary.store(_periods_onward(bars, state, f), f"fold_{f.name}") for f in FRAMES
    ])
    periods = {f.name: df for f, df in zip(FRAMES, stored)}
    folded = state.join(bars.select("symbol").distinct(), "symbol", "left_semi")
    after = temporary.store(_next_state(folded, fresh, periods), "fold_state")
    n_folded, n_moved, n_reached = after.agg(
        F.count("*"), F.count_if("__moved"), F.count_if("__reached")
    ).first()
    # Stored by themselves, so that their size is known and the panels they change need no shuffle.
    moved, revised = at_once(
        spark, lambda: temporary.store(after.filter("__moved").select("symbol", "scores"), "fold_moved"),
        lambda: temporary.store(fresh.filter(~C("__new")).select(*KEY), "fold_revised"),
    )
    reached = after.filter("__reached").select("symbol")

    ranked = fresh.join(after.select("symbol", "scores"), "symbol")
    timeframe_bars = bars.join(reached, "symbol", "left_anti") if n_reached else bars
    parts = {
        "features": [panel.filter("__new").select(*FEATURE_COLUMNS)],
        "signals": [ranked.withColumn("composite_rank", _rank(C("composite_score"), C("scores"))).select(*SIGNAL_COLUMNS)],
        "price_action": [_price_action_rows(panel)],
        "timeframes": [_timeframe_rows(timeframe_bars, periods)],
        "state": [after.select(*_state_columns())],
    }
    if n_reached:
        whole = t.read("bars").select(*KEY, "close_price").join(reached, "symbol", "left_semi")
        parts["timeframes"].append(timeframes(whole))
    for name, df in again_built.items():
        parts[name].append(df)

    # Each table is a chain of its own: what goes, then what comes.
    def panel_table(name: str) -> None:
        if name == "timeframes" and n_reached:
            t.delete(name, reached)
        if n_rebuilt:
            t.delete(name, rebuilt)
        t.append(_together(parts[name]), name)

    def signal_rows() -> None:
        if n_rebuilt or n_moved or not revised.isEmpty():
            _rewrite_signals(t, rebuilt, moved, revised, temporary)
        t.append(_together(parts["signals"]), "signals")

    def states() -> None:
        changed = _together(parts["state"])
        untouched = state.join(changed.select("symbol").unionByName(rebuilt), "symbol", "left_anti")
        t.rebuild(untouched.unionByName(changed), "state")

    at_once(
        spark, signal_rows, states, *[lambda name=name: panel_table(name) for name in ("features", "price_action", "timeframes")]
    )
    return Report(t.commit(), n_folded, n_rebuilt, n_moved, n_reached)


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df.select(*out.columns))
    return out


def _rewrite_signals(
    t: Transaction, rebuilt: DataFrame, moved: DataFrame, revised: DataFrame, temporary: _Temporary
) -> None:
    """Take out rows of symbols built again and revised rows, and give the rows of symbols with
    another set of scores their new ranks; files without such rows stay."""
    hit = rebuilt.unionByName(moved.select("symbol")).unionByName(revised.select("symbol")).distinct()

    def change(rows: DataFrame) -> DataFrame:
        left = rows.join(rebuilt, "symbol", "left_anti").join(revised, list(KEY), "left_anti")
        ranked = left.join(moved, "symbol", "left")
        rank = F.when(C("scores").isNull(), C("composite_rank")).otherwise(_rank(C("composite_score"), C("scores")))
        return ranked.withColumn("composite_rank", rank)

    t.rewrite("signals", temporary.store(hit, "fold_hit"), change)
