"""Back-test, calibration and classifier queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from barquet.config import DEFAULTS
from barquet.operators import backtest, calibration, ml
from barquet.plans import backtesting
from verification.queries_market import places
from verification.registry import register
from verification.sql_stages import CTE, entries, exits, roll, yes
from verification.stages import Stages

C = F.col
ENTRY = ["entry_date", "symbol", "composite_score", "stage2_days", "entry_price", "regime"]
_COLS = ", ".join(ENTRY)
_ALL = "AND s.trade_date BETWEEN (SELECT min(trade_date) FROM bars) AND (SELECT d FROM last_day)"


def _entries(s: Stages, signal: str, **bounds):
    return backtesting.entries_for(
        s.panels(), signal, s.first_day(), s.last_day(), **bounds
    ).select(*ENTRY)


@register("entries_plain", f"SELECT {_COLS} FROM ({entries('x', 'breakout_ready_signal')})")
def _(s: Stages):
    """J3."""
    return _entries(s, "breakout_ready_signal")


@register("entries_bounded", f"""SELECT {_COLS} FROM ({entries(
    'x', 'breakout_ready_signal', 2, 30, 's.stage2_days BETWEEN 1 AND 20')})""")
def _(s: Stages):
    """J3 with score, streak-age and timeframe bounds."""
    return _entries(s, "breakout_ready_signal", min_composite=30.0, min_stage2_days=1,
                    max_stage2_days=20, min_mtf_score=2)


@register("entries_price_action", f"SELECT {_COLS} FROM ({entries('x', 'pa_signal')})")
def _(s: Stages):
    """J4."""
    return _entries(s, "pa_signal")


@register("entries_combined", f"SELECT {_COLS} FROM ({entries('x', 'combined_pa_ema', None, 0)})")
def _(s: Stages):
    """J5."""
    return _entries(s, "combined_pa_ema", min_composite=0.0)


@register("backtest_ready", exits(entries("breakout_ready_signal", "breakout_ready_signal")))
def _(s: Stages):
    """Exits of every breakout-ready entry."""
    return backtesting.run(s.panels(), "breakout_ready_signal", s.first_day(), s.last_day())


@register("backtest_short_hold", exits(
    entries("vcp", "breakout_ready_signal", None, 50), 0.03, 0.05, 10))
def _(s: Stages):
    """A9 with other exit rules."""
    return backtesting.run(s.panels(), "breakout_ready_signal", s.first_day(), s.last_day(),
                           0.03, 0.05, 10, name="vcp")


@register("backtest_long_hold", exits(
    entries("long", "breakout_ready_signal", None, 50,
            "s.trade_date <= (SELECT min(trade_date) FROM bars) + 300"), 0.9, 0.9, 200))
def _(s: Stages):
    """J9 and A9 with a holding period beyond the entries' own range."""
    first = s.first_day()
    return backtesting.run(s.panels(), "breakout_ready_signal", first, first + timedelta(days=300),
                           0.9, 0.9, 200, name="long")


@register("strategy_trades", "SELECT * FROM trades")
def _(s: Stages):
    """Six strategies in one job."""
    return backtesting.compare(s.panels(), s.first_day(), s.last_day())


CTE["curve0"] = """
SELECT strategy, entry_date, symbol, return_pct,
       row_number() OVER w AS trade_no, sum(return_pct) OVER w AS cumulative_return
FROM trades WINDOW w AS (PARTITION BY strategy ORDER BY entry_date, symbol ROWS UNBOUNDED PRECEDING)"""
CTE["curve1"] = "SELECT *, greatest(100 + cumulative_return, 0) AS equity FROM curve0"
CTE["curve2"] = """
SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY entry_date, symbol ROWS UNBOUNDED PRECEDING) AS peak
FROM curve1"""
CTE["curve"] = "SELECT *, (equity - peak) / nullif(peak, 0) * 100 AS drawdown_pct FROM curve2"
_C = dict(cumulative_return=6, equity=6, peak=6, drawdown_pct=6)


@register("equity_curve", """
SELECT strategy, trade_no, entry_date, symbol, return_pct, round(cumulative_return, 6) AS cumulative_return,
       round(equity, 6) AS equity, round(peak, 6) AS peak, round(drawdown_pct, 6) AS drawdown_pct
FROM curve""")
def _(s: Stages):
    """U3."""
    return places(backtest.equity_curve(s.trades()), **_C)


CTE["perf"] = """
SELECT strategy, count(*) AS total_trades,
       round_even(count(*) FILTER (return_pct > 0) / count(*) * 100.0, 1) AS win_rate,
       round_even(avg(return_pct), 2) AS avg_return_pct,
       round_even(coalesce(avg(return_pct) FILTER (return_pct > 0), 0), 2) AS avg_win_pct,
       round_even(coalesce(avg(return_pct) FILTER (return_pct <= 0), 0), 2) AS avg_loss_pct,
       CASE WHEN abs(coalesce(sum(return_pct) FILTER (return_pct <= 0), 0)) > 0
            THEN round_even(coalesce(sum(return_pct) FILTER (return_pct > 0), 0)
                            / abs(sum(return_pct) FILTER (return_pct <= 0)), 2)
            ELSE 'inf'::DOUBLE END AS profit_factor,
       round_even(CASE WHEN stddev_samp(return_pct) > 0 THEN avg(return_pct) / stddev_samp(return_pct)
            * sqrt(252.0::DOUBLE / greatest(avg(holding_days), 1)) ELSE 0 END, 2) AS sharpe_ratio,
       round_even(sum(return_pct), 2) AS total_return_pct,
       count(*) FILTER (exit_reason = 'STOP') AS stop_count,
       count(*) FILTER (exit_reason = 'TARGET') AS target_count,
       count(*) FILTER (exit_reason = 'TIMEOUT') AS timeout_count,
       round_even(max(return_pct), 2) AS best_trade_pct, round_even(min(return_pct), 2) AS worst_trade_pct,
       round_even(avg(holding_days), 1) AS avg_holding_days
FROM trades GROUP BY 1"""


@register("performance", """
SELECT p.*, d.max_drawdown_pct FROM perf p LEFT JOIN (
  SELECT strategy, round_even(greatest(min(drawdown_pct), -100.0::DOUBLE), 2) AS max_drawdown_pct
  FROM curve GROUP BY 1) d ON d.strategy = p.strategy""")
def _(s: Stages):
    """A10 and A12."""
    return backtest.performance_report(s.trades())


@register("performance_by_regime", """
SELECT strategy, regime, count(*) AS count,
       round_even(avg(CASE WHEN return_pct > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS win_rate,
       round_even(avg(return_pct), 2) AS avg_return_pct FROM trades GROUP BY 1, 2""")
def _(s: Stages):
    """A11."""
    return backtest.regime_performance(s.trades())


@register("return_histogram", """
SELECT strategy, bin, round(any_value(lo) + (any_value(hi) - any_value(lo)) * bin / 30, 6) AS bin_start,
       count(*) AS trades
FROM (SELECT *, CAST(least(coalesce(floor((return_pct - lo) / nullif(hi - lo, 0) * 30), 0), 29) AS INTEGER) AS bin
      FROM (SELECT strategy, return_pct, min(return_pct) OVER (PARTITION BY strategy) AS lo,
                   max(return_pct) OVER (PARTITION BY strategy) AS hi FROM trades))
GROUP BY 1, 2""")
def _(s: Stages):
    """A16."""
    return places(backtest.return_histogram(s.trades()), bin_start=6)


# ------------------------------------------------------------------ calibration
@register("forward_highs", """
SELECT symbol, trade_date,
       max(high_price) OVER (PARTITION BY symbol ORDER BY trade_date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 30 DAY FOLLOWING) AS high_t1,
       max(high_price) OVER (PARTITION BY symbol ORDER BY trade_date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 60 DAY FOLLOWING) AS high_t2,
       max(high_price) OVER (PARTITION BY symbol ORDER BY trade_date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 20 DAY FOLLOWING) AS high_t3
FROM bars""")
def _(s: Stages):
    """J10."""
    return calibration.forward_highs(s.bars())


@register("target_hits", "SELECT * FROM cal_hits")
def _(s: Stages):
    """J10 with X8."""
    hits = calibration.target_hits(
        calibration.calibration_entries(s.signals(), s.last_day()),
        calibration.forward_highs(s.bars()),
    )
    return hits.select("symbol", "trade_date", "score_bucket", "hit_t1", "hit_t2", "hit_t3")


@register("confidence_model", "SELECT * FROM confidence")
def _(s: Stages):
    """A8."""
    return calibration.confidence_model(
        s.signals(), s.bars(), s.environment(), s.last_day()
    )


def _conf(n: int, derived: str) -> str:
    return f"round_even(coalesce(x.hit_rate_t{n}, u.hit_rate_t{n}, {derived}), 1) AS confidence_t{n}"


_P = "coalesce(s.upside_prob_pct, 40.0)"


@register("apply_confidence", f"""
SELECT s.symbol, s.trade_date, {_conf(1, f"least({_P} * 1.5, 95)")}, {_conf(2, _P)},
       {_conf(3, f"least({_P} * 2.0, 99)")}
FROM (SELECT *, CASE WHEN composite_score >= 70 THEN 70 WHEN composite_score >= 50 THEN 50
             WHEN composite_score >= 30 THEN 30 ELSE 0 END AS bucket FROM signals
      WHERE trade_date = (SELECT d FROM screen_day) AND target_1_price IS NOT NULL) s
LEFT JOIN confidence x ON x.score_bucket = s.bucket AND x.market_regime =
  coalesce((SELECT market_state FROM environment WHERE trade_date = (SELECT d FROM screen_day)), 'UNKNOWN')
LEFT JOIN confidence u ON u.score_bucket = s.bucket AND u.market_regime = 'UNKNOWN'""")
def _(s: Stages):
    """J24."""
    day = s.screen_day()
    state = s.environment().filter(C("trade_date") == day).first()
    rows = calibration.apply_confidence(
        s.signals().filter(C("trade_date") == day), s.confidence(),
        state.market_state if state else None,
    )
    return rows.select("symbol", "trade_date", "confidence_t1", "confidence_t2", "confidence_t3")


# ------------------------------------------------------------------ classifier
CTE["ml_rows"] = """
SELECT s.symbol, s.trade_date, s.composite_score, s.stage2_days, s.stage2_signal, s.trend_signal,
       s.vcp_signal, s.rs_signal, s.minervini_signal, s.quality_signal, s.liquidity_signal,
       coalesce(p.pa_score, 0.0) AS pa_score, coalesce(t.mtf_score, 0) AS mtf_score,
       coalesce(r.regime_score, 50.0) AS regime_score,
       coalesce(s.distance_from_pivot_pct, 0.0) AS distance_from_pivot_pct,
       coalesce(s.base_range_pct, 0.0) AS base_range_pct
FROM signals s LEFT JOIN timeframes t ON t.symbol = s.symbol AND t.trade_date = s.trade_date
LEFT JOIN price_action p ON p.symbol = s.symbol AND p.trade_date = s.trade_date
LEFT JOIN regime r ON r.trade_date = s.trade_date
WHERE s.breakout_ready_signal = 1 AND s.composite_score >= 40"""


def _ml_rows(s: Stages):
    return ml.training_features(
        s.signals(), s.timeframes(), s.price_action(), s.regime(),
        "breakout_ready_signal", s.first_day(), s.last_day(),
    )


@register("ml_features", "SELECT * FROM ml_rows")
def _(s: Stages):
    """J6."""
    return _ml_rows(s)


CTE["ml_trades"] = exits(entries("breakout_ready_signal", "breakout_ready_signal", None, 40))
CTE["ml_labelled"] = f"""
SELECT m.*, t.return_pct, t.exit_reason, {yes("t.exit_reason = 'TARGET'")} AS label
FROM ml_rows m JOIN ml_trades t ON t.symbol = m.symbol AND t.entry_date = m.trade_date"""


def _labelled(s: Stages):
    trades = backtesting.run(
        s.panels(), "breakout_ready_signal", s.first_day(), s.last_day(), min_composite=40.0
    )
    return ml.labelled(trades, _ml_rows(s))


@register("ml_labelled", "SELECT * FROM ml_labelled")
def _(s: Stages):
    """J7 and M1."""
    return _labelled(s)


def _scores(s: Stages):
    model, _metrics = ml.train(s._stored("ml_training", lambda: _labelled(s)))
    return ml.score_date(
        model, s.signals(), s.timeframes(), s.price_action(), s.regime(), s.screen_day()
    )


@register("ml_scores")
def _(s: Stages):
    """M2-M4: train on labelled entries, score one date. Rows only: SQL grows no trees."""
    return s._stored("ml_scores", lambda: _scores(s))


_P_MIN = DEFAULTS.ml.min_composite


@register("ml_scored_keys", f"""
SELECT symbol, trade_date, TRUE AS is_probability, TRUE AS signal_agrees FROM signals
WHERE trade_date = (SELECT d FROM screen_day) AND composite_score >= {_P_MIN}""")
def _(s: Stages):
    """M4: every candidate of the date is scored, and the signal follows the threshold."""
    rows = s._stored("ml_scores", lambda: _scores(s))
    return rows.select(
        "symbol", "trade_date", C("ml_win_prob").between(0, 1).alias("is_probability"),
        (C("ml_signal") == (C("ml_win_prob") >= DEFAULTS.ml.threshold).cast("int")).alias("signal_agrees"),
    )


@register("ml_split", """
SELECT label, count(*) AS rows, TRUE AS share_holds, TRUE AS repeats FROM ml_labelled GROUP BY label""")
def _(s: Stages):
    """M1: the held-out share of each label, and the same rows on another partitioning."""
    rows = s._stored("ml_training", lambda: _labelled(s))
    first = ml.mark_test_rows(rows)
    again = ml.mark_test_rows(rows.repartition(3)).select("symbol", "trade_date", C("is_test").alias("again"))
    share = DEFAULTS.ml.test_share
    return first.join(again, ["symbol", "trade_date"]).groupBy("label").agg(
        F.count("*").alias("rows"),
        (F.abs(F.count_if("is_test") - share * F.count("*")) <= 1 + 0.01 * F.count("*")).alias("share_holds"),
        F.bool_and(C("is_test") == C("again")).alias("repeats"),
    )


CTE["ml_judged"] = """
SELECT year(trade_date) % 2 = 1 AS is_test, label, (composite_score + pa_score) / 200.0::DOUBLE AS p FROM ml_labelled"""
CTE["ml_counts"] = """
SELECT is_test, p, sum(label)::BIGINT AS wins, sum(1 - label)::BIGINT AS losses FROM ml_judged GROUP BY 1, 2"""
CTE["ml_below"] = """
SELECT *, coalesce(sum(losses) OVER (PARTITION BY is_test ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
FROM ml_counts"""


@register("ml_metrics", """
SELECT is_test, sum(wins + losses)::BIGINT AS rows, sum(wins)::DOUBLE / sum(wins + losses) AS win_rate,
  (sum(CASE WHEN p > 0.5 THEN wins ELSE losses END))::DOUBLE / sum(wins + losses) AS accuracy,
  sum(wins * (2 * below + losses))::DOUBLE / nullif(2.0::DOUBLE * sum(wins)::DOUBLE * sum(losses)::DOUBLE, 0) AS auc,
  coalesce(sum(CASE WHEN p > 0.5 THEN wins END)::DOUBLE / nullif(sum(CASE WHEN p > 0.5 THEN wins + losses END), 0), 0) AS precision,
  coalesce(sum(CASE WHEN p > 0.5 THEN wins END)::DOUBLE / nullif(sum(wins), 0), 0) AS recall
FROM ml_below GROUP BY is_test""")
def _(s: Stages):
    """M3: the metrics of a score that SQL can compute, by odd and even years."""
    rows = s._stored("ml_training", lambda: _labelled(s))
    return ml.metrics(rows.select(
        "label", (F.year("trade_date") % 2 == 1).alias("is_test"),
        ((C("composite_score") + C("pa_score")) / 200.0).alias("ml_win_prob"),
    ))


_ = roll
