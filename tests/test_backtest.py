"""Exits against brute force, metrics on chosen trades, curves in many pieces."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barquet.config import ENTRY_SIGNALS, STRATEGIES
from barquet.operators import backtest
from barquet.schemas import TRADES
from tests.conftest import weekdays

BARS = "symbol string, trade_date date, high_price double, low_price double, close_price double"
ENTRIES = ("strategy string, symbol string, entry_date date, composite_score double, "
           "entry_price double, regime string")


def trade(**over):
    row = dict(strategy="s", symbol="A", entry_date=date(2024, 1, 1), entry_price=100.0,
               exit_date=date(2024, 1, 31), exit_price=120.0, return_pct=20.0, holding_days=30,
               exit_reason="TARGET", composite_score=80.0, regime="BULL")
    return tuple({**row, **over}.values())


def trades(spark, *rows):
    return spark.createDataFrame([trade(**r) for r in rows], TRADES)


# ------------------------------------------------------------------ entries
def test_unknown_entry_signal_is_refused_before_any_query():
    for bad in ("", "close_price", "breakout_signal; drop"):
        with pytest.raises(ValueError, match="invalid entry signal"):
            backtest.signal_entries(bad, date(2024, 1, 1), date(2024, 2, 1), *[None] * 4)


def test_configured_strategies_use_known_signals():
    assert {s for _, s, _ in STRATEGIES} <= set(ENTRY_SIGNALS)
    assert len({n for n, _, _ in STRATEGIES}) == len(STRATEGIES) == 6


# ------------------------------------------------------------------ exits
def brute_force(entry, price, bars, stop, target, hold):
    ahead = [b for b in bars if entry < b[0] <= entry + timedelta(days=hold)]
    if not ahead or not price or price <= 0:
        return None
    lo, hi = price * (1 - stop), price * (1 + target)
    for d, h, l, _ in ahead:
        if l <= lo:
            return d, round(lo, 2), "STOP"
        if h >= hi:
            return d, round(hi, 2), "TARGET"
    return ahead[-1][0], round(ahead[-1][3], 2), "TIMEOUT"


@pytest.mark.parametrize("stop, target, hold", [(0.07, 0.2, 60), (0.02, 0.03, 1), (0.04, 0.06, 9)])
def test_exits_match_a_scan_even_when_one_symbol_dominates(spark, stop, target, hold):
    rng = random.Random(hold)
    bars, entries, want = [], [], {}
    for symbol, n in (("HOT", 900), ("A", 40), ("B", 3)):
        c, mine = 100.0, []
        for d in weekdays(n, date(2020, 1, 6)):
            c = max(1.0, c * (1 + rng.uniform(-0.03, 0.03)))
            mine.append((d, c * 1.01, c * 0.99, c))
        bars += [(symbol, *b) for b in mine]
        for d, _, _, c in mine:
            price = c if rng.random() > 0.02 else -1.0
            entries.append(("s", symbol, d, 71.25, price, "BULL"))
            hit = brute_force(d, price, mine, stop, target, hold)
            if hit:
                want[symbol, d] = hit
    got = backtest.trade_exits(
        spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(bars, BARS),
        stop, target, hold,
    ).collect()
    assert len(got) == len(want)
    for r in got:
        d, price, reason = want[r.symbol, r.entry_date]
        assert (r.exit_date, r.exit_reason) == (d, reason)
        assert r.exit_price == pytest.approx(price, abs=0.011)
        assert r.holding_days == (d - r.entry_date).days


def test_stop_wins_a_tie_and_gaps_still_time_out(spark):
    bars = spark.createDataFrame(
        [("A", date(2024, 1, 2), 130.0, 80.0, 100.0), ("B", date(2024, 2, 20), 101.0, 99.0, 100.5),
         ("C", date(2024, 1, 1), 1.0, 1.0, 1.0)], BARS)
    entries = spark.createDataFrame(
        [("s", s, date(2024, 1, 1), 80.0, 100.0, "BULL") for s in "ABC"], ENTRIES)
    got = {r.symbol: r for r in backtest.trade_exits(entries, bars).collect()}
    assert got["A"].exit_reason == "STOP" and got["A"].return_pct == -7.0
    assert got["B"].exit_reason == "TIMEOUT" and got["B"].return_pct == 0.5
    assert "C" not in got  # no bar after the entry


def test_exit_join_is_an_equi_join(spark):
    e = spark.createDataFrame([("s", "A", date(2024, 1, 1), 80.0, 100.0, "BULL")], ENTRIES)
    b = spark.createDataFrame([("A", date(2024, 1, 2), 1.0, 1.0, 1.0)], BARS)
    plan = backtest.trade_exits(e, b)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# ------------------------------------------------------------------ metrics
def test_single_win(spark):
    m = backtest.performance_report(trades(spark, {})).first()
    assert (m.total_trades, m.win_rate, m.avg_return_pct, m.target_count) == (1, 100.0, 20.0, 1)
    assert m.profit_factor == float("inf") and m.sharpe_ratio == 0.0
    assert m.max_drawdown_pct == 0.0 and m.avg_loss_pct == 0.0


def test_single_stop(spark):
    m = backtest.performance_report(
        trades(spark, dict(return_pct=-7.0, exit_reason="STOP", holding_days=5))).first()
    assert (m.win_rate, m.avg_loss_pct, m.profit_factor, m.stop_count) == (0.0, -7.0, 0.0, 1)


def test_timeout_with_no_gain_counts_as_a_loss(spark):
    m = backtest.performance(trades(spark, dict(return_pct=0.0, exit_reason="TIMEOUT"))).first()
    assert (m.win_rate, m.timeout_count, m.profit_factor) == (0.0, 1, float("inf"))


def test_mixed_exits(spark):
    m = backtest.performance_report(trades(
        spark, dict(entry_date=date(2024, 1, 1), return_pct=20.0),
        dict(entry_date=date(2024, 1, 2), return_pct=-7.0, exit_reason="STOP", holding_days=10),
        dict(entry_date=date(2024, 1, 3), return_pct=2.0, exit_reason="TIMEOUT", holding_days=60),
    )).first()
    assert (m.total_trades, m.stop_count, m.target_count, m.timeout_count) == (3, 1, 1, 1)
    assert m.win_rate == 66.7 and m.total_return_pct == 15.0
    assert m.profit_factor == 3.14 and m.avg_win_pct == 11.0 and m.avg_return_pct == 5.0
    assert m.max_drawdown_pct == -5.83 and m.best_trade_pct == 20.0 and m.worst_trade_pct == -7.0
    assert m.avg_holding_days == 33.3
    assert m.sharpe_ratio == pytest.approx(5 / 13.7477 * (252 / 33.3333) ** 0.5, abs=0.01)


def test_equal_returns_have_no_sharpe(spark):
    m = backtest.performance(trades(spark, {}, dict(symbol="B"))).first()
    assert m.sharpe_ratio == 0.0


def test_metrics_by_regime(spark):
    got = backtest.regime_performance(trades(
        spark, {}, dict(symbol="B", return_pct=-7.0), dict(regime="BEAR", return_pct=-7.0)))
    assert {r.regime: (r["count"], r.win_rate, r.avg_return_pct) for r in got.collect()} == {
        "BULL": (2, 50.0, 6.5), "BEAR": (1, 0.0, -7.0)}


def test_no_trades(spark):
    none = spark.createDataFrame([], TRADES)
    assert backtest.performance_report(none).count() == 0
    assert backtest.return_histogram(none).count() == 0


def test_equity_curve_of_a_dominant_strategy_in_many_pieces(spark):
    """One strategy, one entry day and one symbol prefix hold most trades."""
    rng = random.Random(11)
    rows = []
    for i in range(3_000):
        day = date(2024, 1, 1) if i < 2_000 else date(2024, 1, 2) + timedelta(days=i % 9)
        rows.append(dict(strategy="big", entry_date=day, symbol=f"S{i:05d}",
                         return_pct=round(rng.uniform(-9, 8.5), 3)))
    rows += [dict(strategy="small", symbol=f"S{i}", return_pct=-60.0) for i in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        curve = backtest.equity_curve(trades(spark, *rows)).orderBy("strategy", "trade_no")
        got = curve.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted((trade(**r) for r in rows), key=lambda t: (t[0], t[2], t[1]))
    state = {}
    for g, w in zip(got, want):
        n, cum, peak = state.get(w[0], (0, 0.0, float("-inf")))
        n, cum = n + 1, cum + w[6]
        equity = max(100 + cum, 0.0)
        peak = max(peak, equity)
        state[w[0]] = n, cum, peak
        assert (g.strategy, g.symbol, g.trade_no) == (w[0], w[1], n)
        assert g.cumulative_return == pytest.approx(cum, abs=1e-6)
        assert g.equity == pytest.approx(equity, abs=1e-6)
        assert g.peak == pytest.approx(peak, abs=1e-6)
    small = [g for g in got if g.strategy == "small"]
    assert [g.equity for g in small] == [40.0, 0.0, 0.0]
    low = {r.strategy: r.max_drawdown_pct for r in backtest.max_drawdown(curve).collect()}
    assert low["small"] == -100.0


def test_histogram_counts_every_trade(spark):
    rows = [dict(symbol=f"S{i}", return_pct=float(i)) for i in range(61)]
    got = backtest.return_histogram(trades(spark, *rows)).collect()
    assert sum(r.trades for r in got) == 61 and {r.bin for r in got} == set(range(30))
    assert min(r.bin_start for r in got) == 0.0
    assert F
