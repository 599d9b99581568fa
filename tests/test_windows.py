"""Window forms against plain recursions on small series."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barquet.functions import windows
from tests.conftest import weekdays


def recursive_ema(xs, span):
    a, out = 2 / (span + 1), []
    for x in xs:
        out.append(x if not out else a * x + (1 - a) * out[-1])
    return out


def series_frame(spark, data):
    rows = [(k, d, float(x)) for k, xs in data.items() for d, x in xs]
    return spark.createDataFrame(rows, "symbol string, trade_date date, close_price double")


@pytest.mark.parametrize("years", [None, 1, 3])
def test_ema_over_long_series(spark, years):
    rng = random.Random(7)
    n = 9_000  # far beyond where decay ** -n overflows for short spans
    days = weekdays(n, date(1985, 1, 7))
    xs = [100.0]
    for _ in range(n - 1):
        xs.append(max(1.0, xs[-1] * (1 + rng.uniform(-0.03, 0.031))))
    df = series_frame(spark, {"A": list(zip(days, xs)), "B": list(zip(days[:5], xs[:5]))})
    spans = (10, 50, 200) if years else (3, 10, 50, 200)
    rows = windows.ema(df, spans, era_years=years).orderBy("symbol", "trade_date").collect()
    got = [r for r in rows if r.symbol == "A"]
    for s in spans:
        want = recursive_ema(xs, s)
        worst = max(abs(g[f"ema_{s}"] - w) / w for g, w in zip(got, want))
        assert worst < 1e-12, (s, worst)
    assert [r for r in rows if r.symbol == "B"][0].ema_10 == xs[0]


def test_ema_with_gap_of_many_years(spark):
    days = [date(1990, 1, 1), date(1990, 1, 2), date(2020, 6, 1), date(2020, 6, 2)]
    xs = [10.0, 12.0, 11.0, 15.0]
    got = windows.ema(series_frame(spark, {"A": list(zip(days, xs))}), (10,))
    got = [r.ema_10 for r in got.orderBy("trade_date").collect()]
    assert got == pytest.approx(recursive_ema(xs, 10))


def test_roll_needs_enough_values(spark):
    xs = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    df = series_frame(spark, {"A": list(zip(weekdays(6), xs))})
    out = df.select(
        "trade_date",
        windows.roll(F.max, F.col("close_price"), 3).alias("full"),
        windows.roll(F.max, F.col("close_price"), 3, 1).alias("any"),
        windows.roll(F.min, F.col("close_price"), 2, 2, shift=1).alias("prior"),
    ).orderBy("trade_date").collect()
    assert [r.full for r in out] == [None, None, 4.0, 4.0, 5.0, 9.0]
    assert [r.any for r in out] == [3.0, 3.0, 4.0, 4.0, 5.0, 9.0]
    assert [r.prior for r in out] == [None, None, 1.0, 1.0, 1.0, 1.0]


def test_streak_restarts(spark):
    on = [0, 1, 1, 0, 1, 1, 1]
    days = weekdays(7)
    df = series_frame(spark, {"A": list(zip(days, on)), "B": list(zip(days, [1] * 7))})
    out = windows.streak(df, F.col("close_price") == 1, "days", "since")
    rows = out.orderBy("symbol", "trade_date").collect()
    assert [r.days for r in rows[:7]] == [0, 1, 2, 0, 1, 2, 3]
    assert [r.since for r in rows[:7]] == [None, days[1], days[1], None, days[4], days[4], days[4]]
    assert [r.days for r in rows[7:]] == list(range(1, 8))


def test_asof_keeps_the_newest_bar_even_when_null(spark):
    days = series_frame(spark, {"A": [(date(2024, 1, d), d) for d in (1, 5, 8, 12, 15)]})
    bars = spark.createDataFrame(
        [("A", date(2024, 1, 5), 1.0), ("A", date(2024, 1, 12), None), ("B", date(2024, 1, 5), 9.0)],
        "symbol string, end date, v double",
    )
    got = windows.asof_backward(days, {"b": (bars, "end")}).orderBy("trade_date").collect()
    assert [r.b.v if r.b else "none" for r in got] == ["none", 1.0, 1.0, None, None]


def test_week_and_month_labels(spark):
    days = [date(2024, 3, 29), date(2024, 3, 30), date(2024, 4, 1), date(2024, 4, 5)]
    df = series_frame(spark, {"A": [(d, 1) for d in days]})
    got = df.select("trade_date", windows.week_label().alias("w"), windows.month_label().alias("m"))
    rows = got.orderBy("trade_date").collect()
    assert [r.w for r in rows] == [
        date(2024, 3, 29), date(2024, 4, 5), date(2024, 4, 5), date(2024, 4, 5)
    ]
    assert rows[0].m == date(2024, 3, 31)


def test_windows_share_one_exchange(spark):
    """A chain of per-symbol windows and a (symbol, week) roll-up shuffles once."""
    df = series_frame(spark, {"A": [(date(2024, 1, 1) + timedelta(days=i), i) for i in range(30)]})
    out = df.withColumn("p", windows.lag("close_price")).withColumn(
        "m", windows.roll(F.max, F.col("p"), 5)
    ).groupBy("symbol", windows.week_label().alias("w")).agg(F.max("m"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
