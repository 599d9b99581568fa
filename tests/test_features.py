"""Feature operators on small panels."""

import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from barquet.operators import features, price_action, timeframes
from barquet.plans.daily import feature_table
from barquet.schemas import require


def rows(df):
    return df.orderBy("symbol", "trade_date").collect()


def test_missing_column_fails_before_running(panel):
    with pytest.raises(ValueError, match="close_price"):
        features.moving_averages(panel({"A": [1.0]}).drop("close_price"))
    with pytest.raises(ValueError):
        require(panel({"A": [1.0]}), ["nope"])


def test_trend_score_of_a_steady_rise(panel):
    df = panel({"A": [100 + i for i in range(40)]})
    got = rows(df.transform(features.moving_averages).transform(features.trend_score))
    assert got[0].trend_score == 0  # all averages equal the first close
    assert got[-1].trend_score == 4


def test_stages(panel):
    up = [100 * 1.004**i for i in range(120)]
    down = [100 * 0.996**i for i in range(120)]
    df = panel({"D": down, "F": [100.0] * 120, "U": up})
    got = rows(df.transform(features.moving_averages).transform(features.weinstein_stage))
    last = {r.symbol: r.weinstein_stage for r in got}
    assert last == {"D": 4, "F": 3, "U": 2}


def test_volume_needs_full_windows(panel):
    got = rows(features.volume_averages(panel({"A": [100.0] * 25})))
    assert got[8].avg_volume_10 is None and got[9].avg_volume_10 == 1_000_000
    assert got[18].relative_volume is None and got[19].relative_volume == 1.0


def test_volatility_against_plain_python(spark):
    rng = random.Random(3)
    data, c = [], 100.0
    for i in range(40):
        c *= 1 + rng.uniform(-0.02, 0.02)
        data.append((c * 1.01, c * (0.99 - 0.001 * (i % 5)), c))
    from tests.conftest import weekdays

    df = spark.createDataFrame(
        [("A", d, h, l, x) for d, (h, l, x) in zip(weekdays(40), data)],
        "symbol string, trade_date date, high_price double, low_price double, close_price double",
    )
    got = rows(features.volatility(df))
    spans = [(h - l) / x * 100 for h, l, x in data]
    tr = [data[0][0] - data[0][1]] + [
        max(h - l, abs(h - p), abs(l - p))
        for (h, l, _), (_, _, p) in zip(data[1:], data[:-1])
    ]
    std = [None] + [statistics.stdev(spans[max(0, i - 9): i + 1]) for i in range(1, 40)]
    for i in (1, 5, 20, 39):
        window = [s for s in std[max(0, i - 9): i + 1] if s is not None]
        assert got[i].atr_14 == pytest.approx(statistics.mean(tr[max(0, i - 13): i + 1]))
        assert got[i].volatility_10 == pytest.approx(std[i])
        assert got[i].volatility_contraction == pytest.approx(std[i] / statistics.mean(window))
    assert got[0].volatility_10 is None


def test_year_range_starts_after_a_quarter(panel):
    got = rows(features.year_range(panel({"A": [float(i) for i in range(1, 301)]})))
    assert got[61].high_52w is None and got[62].high_52w == 63.0
    assert got[299].low_52w == 49.0


def test_earnings_mark(spark, panel):
    bars = panel({"A": [1.0, 2.0, 3.0]})
    days = [r.trade_date for r in rows(bars)]
    marks = spark.createDataFrame(
        [("A", days[1]), ("A", days[1]), ("B", days[0])], "symbol string, earnings_date date"
    )
    assert [r.is_earnings_day for r in rows(features.earnings_mark(bars, marks))] == [0, 1, 0]
    assert {r.is_earnings_day for r in rows(features.earnings_mark(bars, None))} == {0}


def test_feature_table_drops_broken_candles_and_copies(panel):
    bars = panel({"A": [100.0 + i for i in range(30)]})
    broken = bars.withColumn("high_price", F.lit(1.0)).limit(3)
    got = feature_table(bars.unionByName(bars).unionByName(broken))
    assert got.count() == 30
    assert got.select("symbol", "trade_date").distinct().count() == 30


# ------------------------------------------------------------------ price action
def pa_panel(panel, closes):
    return panel({"A": closes}).withColumns(
        {"ema_50": F.col("close_price") * 0.95, "relative_volume": F.lit(1.5)}
    )


def test_price_action_of_an_uptrend(panel):
    got = rows(price_action.price_action(pa_panel(panel, [100 + 0.5 * i for i in range(60)])))
    last = got[-1]
    assert last.pa_hh_daily == 1 and last.pa_hl_daily == 1
    assert last.pa_hh_weekly == 1 and last.pa_hl_weekly == 1
    assert last.pa_close_position == pytest.approx(0.5)
    assert last.pa_vol_quality == 1 and last.pa_extension_ok == 1
    assert all(r.pa_signal in (0, 1) and 0 <= r.pa_score <= 100 for r in got)


def test_price_action_of_a_flat_line(panel):
    got = rows(price_action.price_action(pa_panel(panel, [100.0] * 60)))
    assert {(r.pa_hh_daily, r.pa_hl_daily, r.pa_hh_weekly) for r in got} == {(0, 0, 0)}


def test_short_history_has_no_weekly_structure(panel):
    got = rows(price_action.price_action(pa_panel(panel, [100.0 + i for i in range(20)])))
    assert {(r.pa_hh_weekly, r.pa_hl_weekly) for r in got} == {(0, 0)}


def test_zero_range_has_no_close_position(panel):
    flat = panel({"A": [100.0] * 3}, spread=0.0).withColumns(
        {"ema_50": F.lit(100.0), "relative_volume": F.lit(1.0)}
    )
    assert {r.pa_close_position for r in rows(price_action.daily_structure(flat))} == {None}


def score_of(spark, **flags):
    base = dict(pa_hh_daily=0, pa_hl_daily=0, pa_hh_weekly=0, pa_hl_weekly=0,
                pa_close_position=0.0, pa_vol_quality=0, pa_momentum_accel=0, pa_extension_ok=0)
    row = {**base, **flags}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    out = price_action.price_action_score(df).first()
    return out.pa_score, out.pa_signal


@pytest.mark.parametrize("flags, want", [
    ({}, (0.0, 0)),
    ({"pa_hh_daily": 1}, (0.0, 0)),
    ({"pa_hh_daily": 1, "pa_hl_daily": 1}, (25.0, 0)),
    ({"pa_hh_weekly": 1, "pa_hl_weekly": 1}, (25.0, 0)),
    ({"pa_close_position": 0.6}, (15.0, 0)),
    ({"pa_close_position": 0.59}, (0.0, 0)),
    # everything but the weekly structure: high score, no signal
    ({"pa_hh_daily": 1, "pa_hl_daily": 1, "pa_close_position": 0.9, "pa_vol_quality": 1,
      "pa_momentum_accel": 1, "pa_extension_ok": 1}, (75.0, 0)),
    # exactly at the threshold
    ({"pa_hh_daily": 1, "pa_hl_daily": 1, "pa_hh_weekly": 1, "pa_hl_weekly": 1,
      "pa_momentum_accel": 1, "pa_extension_ok": 1}, (70.0, 1)),
    ({"pa_hh_daily": 1, "pa_hl_daily": 1, "pa_hh_weekly": 1, "pa_hl_weekly": 1,
      "pa_close_position": 1.0, "pa_vol_quality": 1, "pa_momentum_accel": 1,
      "pa_extension_ok": 1}, (100.0, 1)),
])
def test_price_action_score(spark, flags, want):
    assert score_of(spark, **flags) == want


# ------------------------------------------------------------------ timeframes
def test_timeframes_need_history_and_lag(panel):
    n = 5 * 60
    df = panel({"A": [100 + i * 0.1 for i in range(n)], "B": [50.0] * 100})
    got = rows(timeframes.timeframes(df))
    a = [r for r in got if r.symbol == "A"]
    assert all(r.mtf_w_ema_fast is None for r in got if r.symbol == "B")  # under 52 weeks
    assert all(r.mtf_m_ema_fast is None for r in got)  # under 24 months
    assert a[-1].mtf_weekly_trend == 1 and a[-1].mtf_score == 1
    # Friday sees the week before, Thursday the one before that
    friday = next(i for i, r in enumerate(a) if r.trade_date.weekday() == 4 and i > 200)
    assert a[friday].mtf_w_ema_fast > a[friday - 1].mtf_w_ema_fast
    assert a[friday - 1].mtf_w_ema_fast == a[friday - 4].mtf_w_ema_fast


def test_no_look_ahead_in_daily_features(panel):
    rng = random.Random(5)
    closes = [100.0]
    for _ in range(120):
        closes.append(closes[-1] * (1 + rng.uniform(-0.03, 0.03)))
    whole = rows(feature_table(panel({"A": closes})))
    cut = rows(feature_table(panel({"A": closes[:80]})))
    assert [r.asDict() for r in whole[:80]] == [r.asDict() for r in cut]
    assert whole[0].trade_date == date(2024, 1, 1)
