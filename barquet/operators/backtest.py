"""Entry extraction, trade exits and performance of signal back-tests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, ENTRY_SIGNALS, UNKNOWN_REGIME
from barquet.functions.days import one_per_day
from barquet.functions.predicates import b, half_even, ratio
from barquet.session import materialize

C = F.col
R = DEFAULTS.backtest
PA_ENTRIES = ("pa_signal", "combined_pa_ema")


def check_entry_signal(name: str) -> str:
    if name not in ENTRY_SIGNALS:
        raise ValueError(f"invalid entry signal {name!r}, expected one of {sorted(ENTRY_SIGNALS)}")
    return name


def signal_entries(
    entry_signal: str,
    start: date,
    end: date,
    signals: DataFrame,
    prices: DataFrame,
    regime: DataFrame,
    timeframes: DataFrame,
    price_action: DataFrame | None = None,
    environment: DataFrame | None = None,
    min_composite: float = R.min_composite,
    min_stage2_days: int | None = None,
    max_stage2_days: int | None = None,
    min_mtf_score: int | None = None,
) -> DataFrame:
    """Entry rows of one signal in a date range.

    Plain signals read the signal panel alone. Price-action entries also need
    the price-action panel and are held back on cash and defensive days.
    Optional bounds add a predicate (and the timeframe join) only when given.
    """
    check_entry_signal(entry_signal)
    needs_pa = entry_signal in PA_ENTRIES
    in_range = C("trade_date").between(start, end)
    rows = signals.filter(in_range & (C("composite_score") >= min_composite))
    if entry_signal == "combined_pa_ema":
        rows = rows.filter(C("breakout_signal") == 1)
    elif not needs_pa:
        rows = rows.filter(C(entry_signal) == 1)
    if min_stage2_days is not None:
        rows = rows.filter(C("stage2_days") >= min_stage2_days)
    if max_stage2_days is not None:
        rows = rows.filter(C("stage2_days") <= max_stage2_days)
    rows = rows.select("symbol", "trade_date", "composite_score", "stage2_days")

    key = ["symbol", "trade_date"]
    if needs_pa:
        hits = price_action.filter(in_range & (C("pa_signal") == 1)).select(*key)
        open_days = environment.filter(
            ~b(C("cash_mode")) & (C("market_state") != R.blocked_state)
        ).select("trade_date")
        rows = rows.join(hits, key, "left_semi").join(
            open_days, "trade_date", "left_semi"
        )
    if min_mtf_score is not None:
        aligned = timeframes.filter(in_range).select(*key, "mtf_score")
        rows = rows.join(aligned, key, "left").filter(
            F.coalesce("mtf_score", F.lit(0)) >= min_mtf_score
        )
    priced = prices.filter(in_range).select(*key, C("close_price").alias("entry_price"))
    states = one_per_day(regime.select("trade_date", C("market_status").alias("regime")))
    return (
        rows.join(priced, key)
        .join(states, "trade_date", "left")
        .select(
            C("trade_date").alias("entry_date"), "symbol", "composite_score", "stage2_days",
            "entry_price", F.coalesce("regime", F.lit(UNKNOWN_REGIME)).alias("regime"),
        )
    )


def strategy_entries(
    strategies: Sequence[tuple[str, str, int | None]],
    start: date,
    end: date,
    signals: DataFrame,
    prices: DataFrame,
    regime: DataFrame,
    timeframes: DataFrame,
    price_action: DataFrame,
    environment: DataFrame,
    min_composite: float = R.min_composite,
) -> DataFrame:
    """Entries of several strategies: (name, entry signal, lowest timeframe score).

    Every panel is read and joined once; a row then unfolds into the strategies
    it belongs to.
    """
    for _, signal, _ in strategies:
        check_entry_signal(signal)
    key = ["symbol", "trade_date"]
    in_range = C("trade_date").between(start, end)
    plain = sorted({s for _, s, _ in strategies if s not in PA_ENTRIES} | {"breakout_signal"})
    days = one_per_day(regime.select("trade_date", C("market_status").alias("regime")))
    open_days = environment.select(
        "trade_date",
        (~b(C("cash_mode")) & (C("market_state") != R.blocked_state)).alias("__open"),
    )
    rows = (
        signals.filter(in_range & (C("composite_score") >= min_composite))
        .select(*key, "composite_score", "stage2_days", *plain)
        .join(price_action.filter(in_range).select(*key, "pa_signal"), key, "left")
        .join(timeframes.filter(in_range).select(*key, "mtf_score"), key, "left")
        .join(open_days, "trade_date", "left")
        .join(days, "trade_date", "left")
    )
    acted = b(C("pa_signal") == 1) & b(C("__open"))

    def holds(signal: str, mtf: int | None) -> Column:
        if signal == "pa_signal":
            test = acted
        elif signal == "combined_pa_ema":
            test = acted & b(C("breakout_signal") == 1)
        else:
            test = b(C(signal) == 1)
        return test if mtf is None else test & (F.coalesce("mtf_score", F.lit(0)) >= mtf)

    member = F.array(*[F.when(holds(s, m), F.lit(n)) for n, s, m in strategies])
    tagged = rows.withColumn("strategy", F.explode(F.array_compact(member)))
    priced = prices.filter(in_range).select(*key, C("close_price").alias("entry_price"))
    return tagged.join(priced, key).select(
        "strategy", C("trade_date").alias("entry_date"), "symbol", "composite_score",
        "stage2_days", "entry_price", F.coalesce("regime", F.lit(UNKNOWN_REGIME)).alias("regime"),
    )


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(width)).cast("int")


# From this holding period on, entries meet blocks of bars before bars.
LONG_HOLD = 120
# Calendar days of a block.
BLOCK_DAYS = 16


def _event_columns() -> list[Column]:
    return [
        F.min(F.when(C("low_price") <= C("__stop"), C("trade_date"))).alias("__stopped"),
        F.min(F.when(C("high_price") >= C("__target"), C("trade_date"))).alias("__reached"),
        F.max("trade_date").alias("__last"),
        F.max_by("close_price", "trade_date").alias("__close"),
    ]


def _events_by_bars(opened: DataFrame, prices: DataFrame, width: int, whole: Sequence[str]) -> DataFrame:
    """First stop, first target and last bar of each entry, from all bars in reach."""
    first = _bucket(F.date_add("entry_date", 1), width)
    last = _bucket(F.date_add("entry_date", width), width)
    reach = opened.withColumn("__bucket", F.explode(F.sequence(first, last)))
    bars = prices.select(
        "symbol", "trade_date", "high_price", "low_price", "close_price",
        _bucket(C("trade_date"), width).alias("__bucket"),
    )
    met = reach.join(bars, ["symbol", "__bucket"]).filter(
        (C("trade_date") > C("entry_date"))
        & (C("trade_date") <= F.date_add("entry_date", width))
    )
    return met.groupBy(*whole).agg(*_event_columns())


def _events_by_blocks(opened: DataFrame, prices: DataFrame, width: int, whole: Sequence[str]) -> DataFrame:
    """The same by blocks of bars with their lowest low and highest high.

    The blocks strictly inside an entry's reach tell which of them closes it first and what the last
    bar before the reach's end is. Bars are met only in the block the reach starts in, and in that first closing
    block or, without one, in the block the reach ends in. Events after the first closing block cannot
    decide anything.
    """
    group = -(-width // BLOCK_DAYS) + 1  # blocks of a reach lie in at most two groups of so many
    bars = prices.select(
        "symbol", "trade_date", "high_price", "low_price", "close_price",
        _bucket(C("trade_date"), BLOCK_DAYS).alias("__block"),
    )
    blocks = bars.groupBy("symbol", "__block").agg(
        F.min("low_price").alias("__low"), F.max("high_price").alias("__high"),
        F.max(F.struct("trade_date", "close_price")).alias("__end"),
    ).withColumn("__group", F.floor(C("__block") / F.lit(group)).cast("int"))
    reach = opened.withColumns(
        {"__b0": _bucket(F.date_add("entry_date", 1), BLOCK_DAYS), "__b1": _bucket(F.date_add("entry_date", width), BLOCK_DAYS)}
    )
    edge = lambda c: F.floor(C(c) / F.lit(group)).cast("int")
    # Left joins: an entry stays, whatever its reach holds.
    grouped = reach.withColumn("__group", F.explode(F.sequence(edge("__b0"), edge("__b1")))).alias("r")
    inside = grouped.join(
        blocks.alias("x"),
        (C("r.symbol") == C("x.symbol")) & (C("r.__group") == C("x.__group"))
        & (C("x.__block") > C("r.__b0")) & (C("x.__block") < C("r.__b1")), "left",
    ).select("r.*", "x.__block", "x.__low", "x.__high", "x.__end")
    closing = F.when((C("__low") <= C("__stop")) | (C("__high") >= C("__target")), C("__block"))
    decided = inside.groupBy(*whole, "__b0", "__b1").agg(F.min(closing).alias("__closing"), F.max("__end").alias("__inner"))
    looked = decided.withColumn(
        "__at", F.explode(F.array_distinct(F.array("__b0", F.coalesce("__closing", "__b1"))))
    ).alias("e")
    met = looked.join(
        bars.alias("p"),
        (C("e.symbol") == C("p.symbol")) & (C("e.__at") == C("p.__block"))
        & (C("p.trade_date") > C("e.entry_date")) & (C("p.trade_date") <= F.date_add("e.entry_date", width)), "left",
    ).select("e.*", "p.trade_date", "p.low_price", "p.high_price", "p.close_price")
    events = met.groupBy(*whole).agg(
        *_event_columns()[:2], F.max(F.when(C("trade_date").isNotNull(), F.struct("trade_date", "close_price"))).alias("__seen"),
        F.first("__inner").alias("__inner"),
    ).withColumn("__tail", F.greatest("__seen", "__inner"))
    return events.filter(C("__tail").isNotNull()).withColumns(
        {"__last": C("__tail.trade_date"), "__close": C("__tail.close_price")}
    ).drop("__seen", "__inner", "__tail")


def trade_exits(
    entries: DataFrame,
    prices: DataFrame,
    stop_loss: float = R.stop_loss,
    target: float = R.target,
    max_holding_days: int = R.max_holding_days,
    key: Sequence[str] = ("strategy", "symbol", "entry_date"),
) -> DataFrame:
    """Close every entry at its first stop or target, or at the last bar in reach.

    Bars up to `max_holding_days` calendar days ahead lie in at most two
    adjacent buckets of that width, so each entry meets only those buckets'
    bars: an equi-join on (symbol, bucket) whose work is entries times bars in
    reach. From `LONG_HOLD` days on entries meet blocks of bars first. A busy symbol is spread
    over its buckets. Exits are minima and maxima that combine before the shuffle.
    """
    opened = entries.filter(C("entry_price") > 0).withColumns(
        {
            "__stop": C("entry_price") * (1.0 - stop_loss),
            "__target": C("entry_price") * (1.0 + target),
        }
    )
    whole = (*key, "entry_price", "composite_score", "regime", "__stop", "__target")
    events = _events_by_blocks if max_holding_days >= LONG_HOLD else _events_by_bars
    closed = events(opened, prices, max_holding_days, whole)
    stopped = C("__stopped").isNotNull() & b(
        C("__reached").isNull() | (C("__stopped") <= C("__reached"))
    )
    reached = C("__reached").isNotNull()
    pick = lambda s, t, o: F.when(stopped, s).when(reached, t).otherwise(o)
    priced = closed.withColumns(
        {
            "__exit": pick(C("__stop"), C("__target"), C("__close")),
            "exit_date": pick(C("__stopped"), C("__reached"), C("__last")),
            "exit_reason": pick(F.lit("STOP"), F.lit("TARGET"), F.lit("TIMEOUT")),
        }
    )
    return priced.select(
        *key,
        half_even(C("entry_price"), 2).alias("entry_price"),
        "exit_date",
        half_even(C("__exit"), 2).alias("exit_price"),
        trade_return(C("entry_price"), C("__exit")).alias("return_pct"),
        F.datediff("exit_date", "entry_date").alias("holding_days"),
        "exit_reason",
        half_even(C("composite_score"), 1).alias("composite_score"),
        "regime",
    )


def trade_return(entry: Column, exit_price: Column) -> Column:
    """Return of a trade in percent, three places."""
    return half_even((ratio(exit_price, entry) - 1.0) * 100.0, 3)


# ------------------------------------------------------------------ metrics
def equity_curve(trades: DataFrame) -> DataFrame:
    """Cumulative return, floored equity and drawdown in trade order.

    Order: entry date, then symbol, per strategy. One strategy may hold any
    share of all trades, so no window runs over a whole strategy: the trades are
    range-partitioned in curve order, written once so that the pieces stay
    fixed, summed per piece, and every piece continues from the totals before
    it. Only one row per piece and strategy meets in a single sort.
    """
    fixed = materialize(
        trades.select(
            "strategy", "entry_date", "symbol",
            F.coalesce("return_pct", F.lit(0.0)).alias("return_pct"),
        )
        .repartitionByRange("strategy", "entry_date", "symbol")
        .withColumn("__piece", F.spark_partition_id()),
        "trades_in_order",
    )
    piece = Window.partitionBy("strategy", "__piece").orderBy("entry_date", "symbol")
    upto = piece.rowsBetween(Window.unboundedPreceding, 0)
    before = (
        Window.partitionBy("strategy").orderBy("__piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0.0)

    totals = fixed.groupBy("strategy", "__piece").agg(
        F.sum("return_pct").alias("__sum"), F.count("*").alias("__rows")
    )
    starts = totals.select(
        "strategy", "__piece",
        F.coalesce(F.sum("__sum").over(before), zero).alias("__start"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
    )
    running = fixed.join(starts, ["strategy", "__piece"]).withColumns(
        {
            "trade_no": C("__offset") + F.row_number().over(piece),
            "cumulative_return": C("__start") + F.sum("return_pct").over(upto),
        }
    ).withColumn("equity", F.greatest(F.lit(100.0) + C("cumulative_return"), zero))
    tops = running.groupBy("strategy", "__piece").agg(F.max("equity").alias("__top"))
    tops = tops.select(
        "strategy", "__piece", F.max("__top").over(before).alias("__top_before")
    )
    out = running.join(tops, ["strategy", "__piece"], "left").withColumn(
        "peak", F.greatest(F.max("equity").over(upto), C("__top_before"))
    )
    return out.select(
        "strategy", "trade_no", "entry_date", "symbol", "return_pct", "cumulative_return",
        "equity", "peak",
        (ratio(C("equity") - C("peak"), F.nullif("peak", zero)) * 100.0).alias("drawdown_pct"),
    )


def max_drawdown(curve: DataFrame) -> DataFrame:
    """Deepest drawdown per strategy, not below -100 %."""
    return curve.groupBy("strategy").agg(
        half_even(F.greatest(F.min("drawdown_pct"), F.lit(-100.0)), 2).alias("max_drawdown_pct")
    )


def performance(trades: DataFrame) -> DataFrame:
    """Win rate, averages, profit factor, Sharpe ratio and exit counts per strategy."""
    r = F.coalesce("return_pct", F.lit(0.0))
    won, lost = F.when(r > 0, r), F.when(r <= 0, r)
    base = trades.groupBy("strategy").agg(
        F.count("*").alias("total_trades"),
        F.count(won).alias("__wins"),
        F.avg(r).alias("__avg"), F.avg(won).alias("__win"), F.avg(lost).alias("__loss"),
        F.sum(won).alias("__gain"), F.sum(lost).alias("__pain"), F.sum(r).alias("__total"),
        F.stddev_samp(r).alias("__std"),
        *[F.count_if(C("exit_reason") == reason).alias(f"{reason.lower()}_count")
          for reason in ("STOP", "TARGET", "TIMEOUT")],
        F.max(r).alias("__best"), F.min(r).alias("__worst"),
        F.avg(F.coalesce("holding_days", F.lit(1))).alias("__hold"),
    )
    pain = F.abs(F.coalesce("__pain", F.lit(0.0)))
    factor = F.when(
        pain > 0, half_even(F.coalesce("__gain", F.lit(0.0)) / F.nullif(pain, F.lit(0.0)), 2)
    ).otherwise(F.lit(float("inf")))
    per_year = F.lit(float(R.trading_days)) / F.greatest(C("__hold"), F.lit(1.0))
    sharpe = F.when(C("__std") > 0, ratio(C("__avg"), C("__std")) * F.sqrt(per_year)).otherwise(
        F.lit(0.0)
    )
    rounded = lambda c, d: half_even(F.coalesce(C(c), F.lit(0.0)), d)
    return base.select(
        "strategy", "total_trades",
        half_even(C("__wins") / C("total_trades") * 100.0, 1).alias("win_rate"),
        rounded("__avg", 2).alias("avg_return_pct"),
        rounded("__win", 2).alias("avg_win_pct"),
        rounded("__loss", 2).alias("avg_loss_pct"),
        factor.alias("profit_factor"),
        half_even(sharpe, 2).alias("sharpe_ratio"),
        rounded("__total", 2).alias("total_return_pct"),
        "stop_count", "target_count", "timeout_count",
        half_even(C("__best"), 2).alias("best_trade_pct"),
        half_even(C("__worst"), 2).alias("worst_trade_pct"),
        half_even(C("__hold"), 1).alias("avg_holding_days"),
    )


def performance_report(trades: DataFrame) -> DataFrame:
    """Performance with the deepest drawdown of each strategy's curve."""
    return performance(trades).join(
        max_drawdown(equity_curve(trades)), "strategy", "left"
    )


def regime_performance(trades: DataFrame) -> DataFrame:
    """Trades, win rate and average return by strategy and regime."""
    r = F.coalesce("return_pct", F.lit(0.0))
    return trades.groupBy("strategy", "regime").agg(
        F.count("*").alias("count"),
        half_even(F.avg((r > 0).cast("double")) * 100, 1).alias("win_rate"),
        half_even(F.avg(r), 2).alias("avg_return_pct"),
    )


def return_histogram(trades: DataFrame, bins: int = R.histogram_bins) -> DataFrame:
    """Equal-width histogram of returns per strategy; the top edge is inclusive."""
    known = trades.filter(C("return_pct").isNotNull())
    ends = known.groupBy("strategy").agg(
        F.min("return_pct").alias("lo"), F.max("return_pct").alias("hi")
    )
    spot = F.floor(ratio(C("return_pct") - C("lo"), C("hi") - C("lo")) * bins)
    placed = known.join(ends, "strategy").withColumn(
        "bin", F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)).cast("int")
    )
    return placed.groupBy("strategy", "bin").agg(
        F.first("lo").alias("__lo"), F.first("hi").alias("__hi"), F.count("*").alias("trades")
    ).select(
        "strategy", "bin",
        (C("__lo") + (C("__hi") - C("__lo")) * C("bin") / bins).alias("bin_start"),
        "trades",
    )
