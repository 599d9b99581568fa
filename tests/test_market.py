"""Regime, sector, calibration, quality, universe and fundamentals."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barquet.config import FALLBACK_STATE, MARKET_STATES
from barquet.functions.scalars import (
    cagr, clean_number, eps_accelerating, option_label, symbol_of_label, with_suffix,
)
from barquet.operators import calibration, fundamentals, quality, regime, sector, universe
from barquet.schemas import MARKET_STATES as STATES
from barquet.schemas import QUALITY_LOG
from tests.conftest import weekdays

INDEX = "index_code string, trade_date date, close double, volume long"


def index(spark, closes, volumes=None):
    vols = volumes or [100] * len(closes)
    rows = [("IX", d, float(c), v) for d, c, v in zip(weekdays(len(closes)), closes, vols)]
    return spark.createDataFrame(rows, INDEX)


@pytest.fixture
def states(spark):
    return spark.createDataFrame(list(MARKET_STATES), STATES)


# ------------------------------------------------------------------ regime
@pytest.mark.parametrize("score, want", [
    (0, "BEAR"), (20, "CORRECTION"), (40, "DEFENSIVE"), (60, "NEUTRAL"), (80, "BULL"),
    (100, "STRONG_BULL"), (140, FALLBACK_STATE),
])
def test_state_of_a_score(spark, states, score, want):
    df = spark.createDataFrame([(score,)], "regime_score int")
    assert regime.market_state(df, states).first().market_status == want


def test_overlapping_ranges_take_the_highest_lower_bound(spark, states):
    extra = spark.createDataFrame(
        [("ODD", 75, 85, 0.1, 0.1, True, True, False, True)], STATES)
    df = spark.createDataFrame([(80,), (76,)], "regime_score int")
    got = {r.regime_score: r.market_status
           for r in regime.market_state(df, states.unionByName(extra)).collect()}
    assert got == {80: "BULL", 76: "ODD"}


def test_history_starts_after_the_warm_up(spark, states):
    assert regime.regime_history(index(spark, [100.0] * 220), states).count() == 0
    got = regime.regime_history(index(spark, [100.0 + i for i in range(230)]), states).collect()
    assert len(got) == 10 and {r.market_status for r in got} == {"STRONG_BULL"}


def test_unknown_state_is_cash(spark, states):
    row = spark.createDataFrame(
        [(date(2024, 1, 1), "ODD", 50.0)], "trade_date date, market_status string, regime_score double")
    env = regime.environment(row, states).first()
    assert env.cash_mode and not env.allow_breakouts and env.exposure_level == 0.0


def test_distribution_days_fall_out_of_the_window(spark):
    closes = [100.0, 99.0] + [99.0] * 30
    got = regime.distribution_days(index(spark, closes, [1, 2] + [3] * 30))
    counts = [r.distribution_count for r in got.orderBy("trade_date").collect()]
    assert counts[0] == 0 and counts[1] == 1 and counts[25] == 1 and counts[26] == 0


def follow(spark, closes, volumes=None):
    return regime.follow_through_day(index(spark, closes, volumes)).first().follow_through_day


def test_follow_through(spark):
    fall = [100.0] * 22 + [97, 94.9]
    rally = [95.2, 95.4, 95.5, 97.5]  # fourth rally day rises 2.1 %
    vols = [100] * len(fall) + [101, 102, 103, 200]
    assert follow(spark, fall + rally, vols) is True
    assert follow(spark, fall + rally, [100] * 28) is False      # volume not higher
    assert follow(spark, fall + rally[:3], vols[:27]) is False   # too early
    assert follow(spark, [100.0] * 40) is False                  # no correction
    assert follow(spark, fall) is False                          # no rally


def test_breadth_needs_enough_stocks(spark):
    rows = [(f"S{i}", date(2024, 1, 1), 10.0, 9.0 if i < 11 else 11.0) for i in range(20)]
    rows += [("T", date(2024, 1, 2), 10.0, 9.0)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close_price double, ema_50 double")
    got = {r.trade_date.day: r.breadth_positive for r in regime.breadth(df).collect()}
    assert got == {1: True, 2: None}


# ------------------------------------------------------------------ sectors
def test_prior_sector_score_takes_the_nearest_then_the_later(spark):
    day = date(2024, 3, 1)
    rows = [(day, "X", 50.0)] + [
        (day - timedelta(days=20 + k), "X", 40.0 + k) for k in (-2, -1, 1)
    ] + [(day - timedelta(days=23), "X", 1.0)]
    df = spark.createDataFrame(rows, "trade_date date, sector string, momentum_score double")
    got = sector.with_prior_scores(df).filter(F.col("trade_date") == day).first()
    assert got.prev_momentum_score == 39.0 and got.momentum_delta == 11.0


def test_thin_sectors_are_not_ranked_and_unlisted_symbols_are_unknown(spark):
    sig = spark.createDataFrame(
        [(f"S{i}.NS", date(2024, 1, 1), 50.0, 1, 0, 1, 1) for i in range(9)],
        "symbol string, trade_date date, composite_score double, trend_signal int, "
        "stage2_signal int, rs_signal int, liquidity_signal int")
    uni = spark.createDataFrame(
        [(f"S{i}", "Tech" if i < 3 else "Oil") for i in range(4)], "symbol string, sector string")
    got = {r.sector: r.total_stocks for r in sector.sector_signals(sig, uni).collect()}
    assert got == {"Unknown": 5}


@pytest.mark.parametrize("lo, hi, want", [
    (10.0, 80.0, (10.0, 80.0)), (40.0, 50.0, (35.0, 55.0)), (0.0, 4.0, (0.0, 12.0)),
    (95.0, 100.0, (87.5, 100.0)),
])
def test_display_bounds(spark, lo, hi, want):
    df = spark.createDataFrame([(lo,), (hi,)], "m double")
    assert tuple(sector.display_bounds(df, "m").first()) == want


# ------------------------------------------------------------------ calibration
def test_confidence_falls_back(spark):
    model = spark.createDataFrame(
        [(70, "BULL", 60.0, 50.0, 80.0), (70, "UNKNOWN", 1.0, 2.0, 3.0), (50, "UNKNOWN", 10.0, 20.0, 30.0)],
        "score_bucket int, market_regime string, hit_rate_t1 double, hit_rate_t2 double, hit_rate_t3 double")
    sig = spark.createDataFrame(
        [("A", 75.0, 50.0, 1.0), ("B", 55.0, 50.0, 1.0), ("C", 31.0, 50.0, 1.0),
         ("D", 5.0, None, 1.0), ("E", 5.0, 70.0, 1.0), ("F", 90.0, 50.0, None)],
        "symbol string, composite_score double, upside_prob_pct double, target_1_price double")
    got = {r.symbol: (r.confidence_t1, r.confidence_t2, r.confidence_t3)
           for r in calibration.apply_confidence(sig, model, "BULL").collect()}
    assert got == {"A": (60.0, 50.0, 80.0), "B": (10.0, 20.0, 30.0), "C": (75.0, 50.0, 99.0),
                   "D": (60.0, 40.0, 80.0), "E": (95.0, 70.0, 99.0)}


def test_forward_highs_count_calendar_days(spark):
    days = [date(2024, 1, 1), date(2024, 1, 21), date(2024, 1, 22), date(2024, 2, 1)]
    df = spark.createDataFrame(
        [("A", d, float(i)) for i, d in enumerate(days)], "symbol string, trade_date date, high_price double")
    row = calibration.forward_highs(df).orderBy("trade_date").first()
    assert (row.high_t3, row.high_t1, row.high_t2) == (1.0, 2.0, 3.0)


# ------------------------------------------------------------------ quality
def test_stale_runs_and_single_halts(spark):
    rows = [("A", d, 10.0, v) for d, v in zip(weekdays(6), [5, 0, 0, 0, 5, 0])]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close_price double, volume long")
    assert [r.trade_date.day for r in quality.stale_rows(df).orderBy("trade_date").collect()] == [3, 4]
    assert quality.without_stale_rows(df).count() == 4


def test_gaps_only_in_the_recent_past(spark):
    days = [date(2024, 1, 1), date(2024, 1, 20), date(2024, 5, 1), date(2024, 5, 7), date(2024, 5, 12)]
    df = spark.createDataFrame([("A", d) for d in days], "symbol string, trade_date date")
    got = quality.date_gaps(df, date(2024, 5, 15)).collect()
    assert [(r.gap_start, r.gap_days) for r in got] == [(date(2024, 5, 1), 6)]


def test_report_has_every_symbol(spark):
    day = date(2024, 1, 1)
    log = spark.createDataFrame(
        [(day, "thin_history", f"S{i:04d}", "", 1) for i in range(500)]
        + [(day - timedelta(days=9), "thin_history", "OLD", "", 1)], QUALITY_LOG)
    rows = quality.log_report(log, day).collect()
    assert len(rows) == 1 and rows[0].issues == 500 and rows[0].rows_deleted == 500
    named = quality.log_symbols(log, day).collect()
    assert sorted(r.symbol for r in named) == [f"S{i:04d}" for i in range(500)]
    assert {(r.run_date, r.check_type, r.issues) for r in named} == {(day, "thin_history", 1)}


def test_several_indices_are_refused_or_chosen(spark):
    from barquet.functions.days import one_per_day

    day = date(2024, 1, 1)
    rows = spark.createDataFrame(
        [("A", day, 1.0), ("B", day, 2.0), ("A", day + timedelta(days=1), None)],
        "index_code string, trade_date date, x double")
    got = one_per_day(rows, "A").orderBy("trade_date").collect()
    assert [r.x for r in got] == [1.0, None]
    with pytest.raises(Exception, match="choose one index_code"):
        one_per_day(rows).collect()


# ------------------------------------------------------------------ universe
def test_first_missing_session(spark):
    cal = spark.createDataFrame(
        [(d, i + 1) for i, d in enumerate(weekdays(4))], "trade_date date, session_no int")
    d = weekdays(4)
    prices = spark.createDataFrame(
        [("FULL", x) for x in d] + [("HEAD", x) for x in d[:2]] + [("TAIL", x) for x in d[1:]]
        + [("HOLE", d[0]), ("HOLE", d[1]), ("HOLE", d[3]), ("OLD", date(2020, 1, 1))],
        "symbol string, trade_date date")
    symbols = prices.select("symbol").distinct()
    got = {r.symbol: r.first_missing
           for r in universe.first_missing_session(symbols, prices, cal).collect()}
    assert got == {"HEAD": d[2], "TAIL": d[0], "HOLE": d[2], "OLD": d[0]}


def test_listing_merge_prefers_the_first_known_value(spark):
    schema = "symbol string, company_name string, sector string, isin string"
    a = spark.createDataFrame([("A", None, "Tech", None)], schema)
    b = spark.createDataFrame([("A", "Alpha", "Oil", "I1"), ("B", "Beta", None, None)], schema)
    got = {r.symbol: (r.company_name, r.sector, r.isin)
           for r in universe.merge_listings([a, b]).collect()}
    assert got == {"A": ("Alpha", "Tech", "I1"), "B": ("Beta", None, None)}


def test_membership_of_other_indices_is_untouched(spark):
    schema = "symbol string, index_code string, is_current_member boolean, first_added_date date, last_removed_date date"
    old = date(2020, 1, 1)
    stored = spark.createDataFrame(
        [("A", "I1", True, old, None), ("B", "I1", False, old, old), ("A", "I2", True, old, None)], schema)
    fresh = spark.createDataFrame([("B", "I1"), ("C", "I1")], "symbol string, index_code string")
    today = date(2024, 1, 1)
    got = {(r.symbol, r.index_code): (r.is_current_member, r.first_added_date, r.last_removed_date)
           for r in universe.sync_membership(stored, fresh, today).collect()}
    assert got == {("A", "I1"): (False, old, today), ("B", "I1"): (True, old, None),
                   ("C", "I1"): (True, today, None), ("A", "I2"): (True, old, None)}


# ------------------------------------------------------------------ scalars
@pytest.mark.parametrize("text, want", [
    ("₹1,234.56", 1234.56), ("12.5%", 12.5), (" 900 Cr ", 900.0), ("--", None), ("N/A", None),
    ("", None), ("abc", None), ("-3.5", -3.5), ("1 234", None), ("7 %", 7.0), (None, None),
])
def test_clean_number(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean_number(F.col("t")).alias("v")).first().v == want


@pytest.mark.parametrize("values, want", [
    ([100.0, 110.0, 121.0, 133.1], 10.0), ([1.0, 2.0], None), ([-1.0, 1.0, 1.0, 2.0], None),
    ([5.0, 100.0, 110.0, 121.0, 133.1], 10.0), ([], None), ([1.0, 1.0, 1.0, 0.0], None),
])
def test_cagr(spark, values, want):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(cagr(F.col("v"), 3).alias("g")).first().g == want


@pytest.mark.parametrize("values, want", [
    ([1.0] * 8, False), ([10, 10, 10, 10, 10, 11, 13, 16], True), ([1.0] * 7, None),
    ([10, 0, 10, 10, 10, 11, 13, 16], None), ([10, 10, 10, 10, 10, 13, 12, 16], False),
])
def test_eps_acceleration(spark, values, want):
    df = spark.createDataFrame([([float(v) for v in values],)], "v array<double>")
    assert df.select(eps_accelerating(F.col("v")).alias("a")).first().a is want


def test_labels_survive_parentheses(spark):
    df = spark.createDataFrame([("Motors (DVR)", "M.NS"), ("Plain", "P.NS")], "n string, s string")
    out = df.select("s", symbol_of_label(option_label(F.col("n"), F.col("s"))).alias("b"))
    assert all(r.s == r.b for r in out.collect())


def test_suffix_is_added_once(spark):
    df = spark.createDataFrame([("A",), ("A.NS",), ("b.ns",)], "s string")
    assert [r.x for r in df.select(with_suffix(F.col("s")).alias("x")).collect()] == [
        "A.NS", "A.NS", "b.ns"]


def test_unknown_figures_fail_their_test(spark):
    facts = spark.createDataFrame(
        [("A", "top-ratios", "roe", 1, "15%"), ("A", "top-ratios", "roce", 1, "--"),
         ("A", "shareholding", "promoter_pledge_pct", 1, "0%")],
        "symbol string, section string, label string, period int, raw_value string")
    row = fundamentals.fundamentals(facts).first()
    assert row.quality_score == 2 and row.roce is None and row.eps_acceleration is None
    strict = fundamentals.fundamentals(facts, {"roe_min": 16.0}).first()
    assert strict.quality_score == 1
