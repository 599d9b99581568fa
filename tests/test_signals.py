"""Signal operators on hand-made rows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barquet.operators import signals, targets
from barquet.plans.daily import signal_table
from tests.conftest import weekdays

BASE = dict(
    symbol="A", trade_date=date(2024, 1, 1), open_price=100.0, high_price=103.0, low_price=99.0,
    close_price=102.0, ema_10=101.0, ema_21=100.0, ema_50=98.0, ema_150=95.0, ema_200=93.0,
    trend_score=4, avg_volume_10=600_000.0, avg_volume_20=1_000_000.0, relative_volume=2.0,
    atr_14=2.0, volatility_contraction=0.5, high_52w=102.0, low_52w=70.0, is_earnings_day=0,
)


def frame(spark, rows):
    names = list(BASE)
    data = [tuple({**BASE, **r}[c] for c in names) for r in rows]
    types = {"symbol": "string", "trade_date": "date", "trend_score": "int",
             "is_earnings_day": "int"}
    schema = ", ".join(f"{c} {types.get(c, 'double')}" for c in names)
    return spark.createDataFrame(data, schema)


def breakout_rows(**last):
    """21 quiet bars under 100, then a breakout bar."""
    days = weekdays(22)
    quiet = [dict(trade_date=d, open_price=98.0, high_price=99.5, low_price=97.0, close_price=98.0 + i % 2,
                  high_52w=99.0, relative_volume=0.6) for i, d in enumerate(days[:-1])]
    return quiet + [dict(trade_date=days[-1], **last)]


def last_breakout(spark, **last):
    df = frame(spark, breakout_rows(**last)).withColumn("stage2_days", F.lit(last.get("s2", 10)))
    out = df.transform(signals.pivot_levels).transform(signals.breakout_signal).transform(
        signals.breakout_ready_signal
    )
    return out.orderBy(F.desc("trade_date")).first()


def test_breakout_holds(spark):
    row = last_breakout(spark)
    assert row.breakout_signal == 1 and row.breakout_ready_signal == 0
    assert row.pivot_price == 99.0 and row.base_low_price == 98.0


@pytest.mark.parametrize("change", [
    {"close_price": 98.5},                                   # under the pivot
    {"relative_volume": 1.49},                               # no surge
    {"ema_50": 92.0, "ema_150": 90.0, "ema_200": 89.0},      # extended
    {"low_price": 101.5, "high_price": 110.0},               # weak close
    {"open_price": 105.0, "high_price": 106.0, "low_price": 95.0},  # gap trap
    {"is_earnings_day": 1},
    {"low_52w": 90.0},                                       # no prior run
    {"high_52w": 140.0},                                     # far from the high
    {"avg_volume_20": 700_000.0},                            # no dry-up
    {"ema_150": 99.0},                                       # stack broken
    {"ema_50": None},
])
def test_each_breakout_guard(spark, change):
    assert last_breakout(spark, **change).breakout_signal == 0


@pytest.mark.parametrize("days, want", [(0, 1), (60, 1), (61, 0)])
def test_breakout_streak_age(spark, days, want):
    df = frame(spark, breakout_rows()).withColumn("stage2_days", F.lit(days))
    out = df.transform(signals.pivot_levels).transform(signals.breakout_signal)
    assert out.orderBy(F.desc("trade_date")).first().breakout_signal == want


def test_breakout_ready_sits_just_under_the_pivot(spark):
    assert last_breakout(spark, close_price=98.9).breakout_ready_signal == 1
    assert last_breakout(spark, close_price=95.0).breakout_ready_signal == 0


def test_vcp_is_silent_on_the_eve_of_earnings(spark):
    days = weekdays(40)
    rows = [dict(trade_date=d, atr_14=5.0 if i < 30 else 1.0, relative_volume=0.5,
                 is_earnings_day=int(i == 36)) for i, d in enumerate(days)]
    df = frame(spark, rows).withColumn("stage2_signal", F.lit(1))
    out = df.transform(signals.contraction_signals).transform(signals.vcp_signal)
    got = [r.vcp_signal for r in out.orderBy("trade_date").collect()]
    assert got[29] == 0 and got[34] == 1 and got[35] == 0 and got[36] == 1


def test_quality_prefers_fundamentals(spark):
    funds = spark.createDataFrame(
        [("A", date(2024, 1, 1), 7), ("A", date(2023, 1, 1), 2), ("B", date(2024, 1, 1), 5),
         ("C", date(2024, 1, 1), None)],
        "symbol string, trade_date date, quality_score int",
    )
    df = frame(spark, [dict(symbol=f"{s}.NS") for s in "ABCD"]).withColumn(
        "stage2_signal", F.when(F.col("symbol") == "D.NS", 0).otherwise(1)
    )
    out = signals.attach_context(df, None, funds).transform(signals.quality_signal)
    assert {r.symbol: r.quality_signal for r in out.collect()} == {
        "A.NS": 1, "B.NS": 0, "C.NS": 1, "D.NS": 0
    }


def test_relative_strength_needs_both_returns(spark):
    days = weekdays(70)
    rows = [dict(trade_date=d, close_price=100.0 + i) for i, d in enumerate(days)]
    index = spark.createDataFrame(
        [("IX", d, 100.0 + 0.1 * i, 1) for i, d in enumerate(days[:-1])],
        "index_code string, trade_date date, close double, volume long",
    )
    out = signals.attach_context(frame(spark, rows), index).transform(signals.relative_strength)
    got = out.orderBy("trade_date").collect()
    assert got[62].rs_value is None and got[62].rs_signal == 0
    assert got[63].rs_signal == 1 and got[63].rs_value == pytest.approx(56.7)
    assert got[69].rs_value is None and got[69].rs_signal == 0  # no index value that day


def test_composite_rank_is_within_the_symbol(spark):
    flags = dict(trend_signal=1, stage2_signal=1, liquidity_signal=1, quality_signal=1,
                 vcp_signal=1, breakout_signal=1)
    rows = [("A", date(2024, 1, 1), 1, 1, 1, 1, 1, 1), ("A", date(2024, 1, 2), 1, 1, 0, 0, 0, 0),
            ("A", date(2024, 1, 3), 1, 1, 0, 0, 0, 0), ("A", date(2024, 1, 4), 0, 0, 0, 0, 0, 0),
            ("B", date(2024, 1, 1), 0, 0, 1, 0, 0, None)]
    df = spark.createDataFrame(
        rows, "symbol string, trade_date date, " + ", ".join(f"{f} int" for f in flags)
    )
    got = signals.composite(df).orderBy("symbol", "trade_date").collect()
    assert [r.composite_score for r in got] == [100.0, 40.0, 40.0, 0.0, 10.0]
    assert [round(r.composite_rank, 2) for r in got] == [33.33, 66.67, 66.67, 100.0, 100.0]
    assert [r.institutional_candidate for r in got] == [1, 0, 0, 0, 0]


# ------------------------------------------------------------------ targets
def target_row(spark, close, pivot=100.0, base=90.0, atr=2.0):
    df = spark.createDataFrame(
        [("A", close, pivot, base, atr, 1, 0, 0, 0, 100.0, 5)],
        "symbol string, close_price double, pivot_price double, base_low_price double, "
        "atr_14 double, breakout_signal int, minervini_signal int, rs_new_high int, "
        "darvas_signal int, composite_score double, stage2_days int",
    )
    return targets.targets(df).first()


@pytest.mark.parametrize("close, stage, stop", [
    (95.0, "IN_BASE", 93.0), (100.0, "ACTIVE", 97.0), (101.0, "ACTIVE", 98.0),
    (102.0, "NEAR_T1", 99.0), (105.0, "NEAR_T1", 102.0), (106.0, "PAST_T1", 103.0),
    (111.0, "PAST_T2", 108.0),
])
def test_position_stage_and_stop(spark, close, stage, stop):
    row = target_row(spark, close)
    assert (row.target_1_price, row.target_2_price, row.target_3_price) == (105.0, 110.0, 102.5)
    assert row.position_stage == stage and row.trailing_stop_price == stop


def test_no_pivot_means_no_plan(spark):
    row = target_row(spark, 95.0, pivot=None, base=None)
    assert row.position_stage is None and row.trailing_stop_price is None
    assert row.upside_prob_pct is None and row.ev_score is None


def test_probability_and_value(spark):
    row = target_row(spark, 100.0)
    # 40 base + 5 breakout + 5 high score + 3 fresh streak
    assert row.upside_prob_pct == 53.0 and row.target_2_pct == 10.0
    assert row.risk_reward_t2 == 1.43 and row.ev_score == pytest.approx(2.01)


# ------------------------------------------------------------------ gate
@pytest.fixture
def gated(spark):
    def run(allow, cash, days):
        last = date(2024, 1, 2)
        cols = ("trend_signal", "stage2_signal", "vcp_signal", "breakout_signal",
                "breakout_ready_signal", "liquidity_signal", "quality_signal")
        rows = [(s, d, *[1] * 7, 100.0, 1) for s in "AB" for d in (date(2024, 1, 1), last)]
        df = spark.createDataFrame(
            rows, "symbol string, trade_date date, " + ", ".join(f"{c} int" for c in cols)
            + ", composite_score double, institutional_candidate int"
        )
        gate = spark.createDataFrame(
            [(date(2023, 12, 1), True, False, 0), (date(2024, 1, 5), allow, cash, days)],
            "trade_date date, allow_breakouts boolean, cash_mode boolean, distribution_count int",
        )
        out = signals.regime_gate(df, gate).collect()
        old = [r for r in out if r.trade_date != last]
        assert all(r.trend_signal == 1 and r.composite_score == 100.0 for r in old)
        return next(r for r in out if r.trade_date == last)

    return run


@pytest.mark.parametrize("allow, cash, days, want", [
    (True, False, 4, (1, 1, 100.0, 1)), (True, True, 0, (0, 0, 30.0, 0)),
    (False, False, 0, (1, 0, 70.0, 1)), (True, False, 5, (1, 0, 70.0, 1)),
])
def test_gate(gated, allow, cash, days, want):
    row = gated(allow, cash, days)
    assert (row.trend_signal, row.breakout_signal, row.composite_score,
            row.institutional_candidate) == want


def test_signal_table_flags_are_binary(spark):
    days = weekdays(300)
    rows = [dict(trade_date=d, close_price=100 + 0.2 * i + (i % 7)) for i, d in enumerate(days)]
    out = signal_table(frame(spark, rows))
    ints = [c for c, t in out.dtypes if t == "int" and c != "stage2_days"]
    worst = out.agg(*[F.max(F.when(F.col(c).isin(0, 1), 0).otherwise(1)).alias(c) for c in ints])
    assert set(worst.first()) == {0}
    assert out.count() == 300 and timedelta(days=1)
