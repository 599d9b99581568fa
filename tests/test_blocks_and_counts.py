"""Exits over blocks of bars, and hit counts that add up by day."""

import random
import uuid
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barquet.operators import backtest, calibration
from barquet.session import shared_folder
from barquet.sources.snapshots import Snapshots
from tests.conftest import weekdays
from tests.test_snapshots import joined_rows

ENTRIES = "strategy string, symbol string, entry_date date, composite_score double, entry_price double, regime string"
BARS = "symbol string, trade_date date, high_price double, low_price double, close_price double"


def walks(spark, symbols, n, move=0.02, seed=1, gaps=False):
    rng = random.Random(seed)
    bars, entries = [], []
    for symbol in symbols:
        c = 100.0
        for d in weekdays(n, date(2020, 1, 6)):
            c = max(1.0, c * (1 + rng.uniform(-move, move)))
            if gaps and rng.random() < 0.5:
                continue
            bars.append((symbol, d, c * 1.01, c * 0.99, c))
            entries.append(("s", symbol, d, None if rng.random() < 0.1 else 71.0, c, None if rng.random() < 0.1 else "BULL"))
    return spark.createDataFrame(entries, ENTRIES).cache(), spark.createDataFrame(bars, BARS).cache()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("stop, target, hold", [(0.07, 0.2, 200), (0.9, 0.9, 130), (0.03, 0.05, 20), (0.02, 0.02, 1), (0.1, 0.1, 16)])
def test_blocks_equal_bars(spark, monkeypatch, stop, target, hold):
    entries, bars = walks(spark, ["A", "B"], 260, gaps=True)
    monkeypatch.setattr(backtest, "LONG_HOLD", 10**6)
    want = rows(backtest.trade_exits(entries, bars, stop, target, hold))
    monkeypatch.setattr(backtest, "LONG_HOLD", 0)
    got = rows(backtest.trade_exits(entries.unionByName(entries.limit(5)), bars, stop, target, hold))
    assert got == want and want


def test_blocks_meet_a_quarter_of_the_rows(spark, monkeypatch):
    entries, bars = walks(spark, [f"S{k}" for k in range(6)], 500, move=0.012)
    counts = {}
    for name, hold in (("bars", 10**6), ("blocks", 0)):
        monkeypatch.setattr(backtest, "LONG_HOLD", hold)
        counts[name] = joined_rows(backtest.trade_exits(entries, bars, 0.2, 0.5, 200))
    assert counts["blocks"] <= counts["bars"] / 4, counts


# ------------------------------------------------------------------ counts
@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(9)
    signals, bars = [], []
    days = weekdays(200, date(2024, 1, 1))
    for k in range(12):
        c = 100.0
        for d in days:
            c = max(1.0, c * (1 + rng.uniform(-0.02, 0.021)))
            bars.append((f"S{k}", d, c * 1.01))
            signals.append((f"S{k}", d, int(rng.random() < 0.6), 0, rng.choice([35.0, 55.0, 75.0, 85.0]), c, 10.0, c * 1.05, c * 1.1,
                            None if rng.random() < 0.2 else c * 1.02))
    states = [(d, rng.choice(["BULL", "BEAR"])) for d in days[:-40]]
    return (
        spark.createDataFrame(signals, "symbol string, trade_date date, breakout_signal int, breakout_ready_signal int, composite_score double, "
                              "pivot_price double, base_range_pct double, target_1_price double, target_2_price double, target_3_price double").cache(),
        spark.createDataFrame(bars, "symbol string, trade_date date, high_price double").cache(),
        spark.createDataFrame(states, "trade_date date, market_state string").cache(), days[-1],
    )


def test_extended_counts_equal_the_model_of_all_history(spark, history):
    signals, bars, states, last = history
    store = Snapshots(spark, f"{shared_folder(spark)}/counts/{uuid.uuid4().hex}")
    added = []
    for back in (9, 4, 3, 3, 1, 0):
        with store.transaction() as t:
            added.append(calibration.extend_counts(t, "counts", signals, bars, states, last - timedelta(days=back)))
    assert added[0] > 50 and added[3] == 0 and all(n <= 5 for n in added[1:])
    want = calibration.confidence_model(signals, bars, states, last)
    got = calibration.confidence_rates(store.read("counts"))
    assert rows(got) == rows(want) and want.count() > 4
    days = store.read("counts").groupBy("trade_date", "score_bucket", "market_regime").count()
    assert days.filter("count > 1").count() == 0


def test_only_set_ups_that_closed_are_read(history):
    signals, bars, states, last = history
    after = last - timedelta(days=3)
    some = calibration.calibration_entries(signals, last, after)
    low, high = some.agg(F.min("trade_date"), F.max("trade_date")).first()
    assert low > after - timedelta(days=60) and high <= last - timedelta(days=60)
    counts = calibration.confidence_counts(signals, bars, states, last, after)
    assert {r[0] for r in counts.select("trade_date").distinct().collect()} <= {after + timedelta(days=k) for k in (1, 2, 3)}
