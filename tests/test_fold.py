"""Deliveries folded into the daily tables against a full rebuild."""

import math
import threading
import uuid
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barquet.functions.windows import roll, series
from barquet.operators import price_action, timeframes
from barquet.plans.daily import feature_table, signal_table
from barquet.session import at_once, shared_folder
from barquet.sources.snapshots import Snapshots
from barquet.streaming import fold
from tests.conftest import weekdays

KEY = ["symbol", "trade_date"]
START = date(2023, 1, 2)


def bar(symbol, day, close, spread=0.01, volume=2_000_000):
    return (symbol, day, close * (1 - spread / 4), close * (1 + spread), close * (1 - spread), close, int(volume))


def walk(symbol, n, drift, wave, spread=0.01, volume=2_000_000):
    days = weekdays(n, START)
    return [bar(symbol, d, 100 * math.exp(drift * k + wave * math.sin(k / 7)), spread, volume + 1000 * (k % 11)) for k, d in enumerate(days)]


def contracting(symbol, n):
    """A steady rise whose ranges and volumes shrink at the end: a contraction signal on every late bar."""
    out = []
    for k, d in enumerate(weekdays(n, START)):
        late = max(0, k - (n - 14))
        spread = 0.03 if not late else 0.03 * 0.72 ** late
        out.append(bar(symbol, d, 100 * math.exp(0.004 * k), spread, 3_000_000 * 0.9 ** late))
    return out


def histories():
    """Each symbol's bars with the number of the delivery they come in."""
    spec = {
        "STEADY.NS": walk("STEADY.NS", 330, 0.001, 0.05),
        "LATE.NS": walk("LATE.NS", 300, 0.0005, 0.08),
        "NEW.NS": walk("NEW.NS", 90, 0.002, 0.02),
        "HALT.NS": walk("HALT.NS", 280, -0.001, 0.03),
        "YEAR.NS": walk("YEAR.NS", 257, 0.001, 0.04),           # reaches 52 weeks in a delivery
        "EVE.NS": contracting("EVE.NS", 320),
        "QUIET.NS": walk("QUIET.NS", 300, 0.0, 0.0, volume=100)[:-1] + [bar("QUIET.NS", weekdays(300, START)[-1], 100.0, volume=10**9)],
    }
    out = []
    for symbol, bars in spec.items():
        n = len(bars)
        for k, row in enumerate(bars):
            number = max(0, 3 - (n - 1 - k)) if symbol != "HALT.NS" else 0
            if symbol == "LATE.NS" and k == n - 20:
                number = 2
            if symbol == "NEW.NS":
                number = max(1, number)
            out.append((*row, number))
    return out


@pytest.fixture(scope="module")
def grown(spark):
    schema = ("symbol string, trade_date date, open_price double, high_price double, low_price double, "
              "close_price double, volume long, delivery int")
    rows = histories()
    bars = spark.createDataFrame(rows, schema).cache()
    index = spark.createDataFrame(
        [("I", d, 1000 * math.exp(0.0005 * k + 0.02 * math.sin(k / 9)), 1) for k, d in enumerate(weekdays(340, START))],
        "index_code string, trade_date date, close double, volume long")
    eve = [r for r in rows if r[0] == "EVE.NS"][-2][1]
    earnings = spark.createDataFrame([("EVE.NS", eve)], "symbol string, earnings_date date")
    facts = fold.Facts(earnings, index)
    store = Snapshots(spark, f"{shared_folder(spark)}/fold/{uuid.uuid4().hex}")
    batch = lambda n: bars.filter(F.col("delivery") == n).drop("delivery")
    fold.build(store, batch(0), facts, files=4)
    before = store.read("signals").filter(F.col("symbol") == "EVE.NS").orderBy(F.desc("trade_date")).first()
    reports = [fold.apply(store, batch(n), facts) for n in (1, 2, 3)]
    return store, facts, bars.drop("delivery"), reports, before, batch


@pytest.fixture(scope="module")
def rebuilt(grown):
    _, facts, bars, *_ = grown
    features = feature_table(bars, facts.earnings).cache()
    return {
        "features": features,
        "signals": signal_table(features, facts.index_bars, facts.fundamentals),
        "price_action": price_action.price_action(features),
        "timeframes": timeframes.timeframes(features),
    }


@pytest.mark.parametrize("name", ["features", "signals", "price_action", "timeframes"])
def test_tables_equal_the_rebuild(grown, rebuilt, name):
    got, want = grown[0].read(name), rebuilt[name]
    assert got.count() == want.count() == got.select(*KEY).distinct().count()
    different = []
    for c, kind in want.dtypes:
        if c in KEY:
            continue
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        same = a.eqNullSafe(b)
        if kind == "double":
            same |= F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.abs(b), F.lit(1.0)), F.lit(False))
        different.append(F.count_if(~same).alias(c))
    found = got.alias("a").join(want.alias("b"), KEY).agg(F.count("*").alias("rows"), *different).first().asDict()
    assert found.pop("rows") == want.count()
    assert {c: n for c, n in found.items() if n} == {}


def test_what_the_deliveries_did(grown):
    first, second, third = grown[3]
    assert first.built_again == 1          # the new symbol
    assert second.built_again == 1         # the late bar
    assert third.built_again == 0
    assert [r.folded for r in grown[3]] == [5, 5, 6]
    assert sum(r.timeframes_rewritten for r in grown[3]) >= 1
    assert sum(r.ranks_rewritten for r in grown[3]) < 6


def test_the_eve_of_an_announcement_is_revised(grown):
    store, before = grown[0], grown[4]
    eve = store.read("signals").filter((F.col("symbol") == "EVE.NS")).orderBy(F.desc("trade_date")).limit(3).collect()[-1]
    assert eve.trade_date > before.trade_date or eve.vcp_signal == 0
    assert store.read("signals").filter("symbol = 'EVE.NS' and vcp_signal = 1").count() > 0


def test_state_is_that_of_the_rebuilt_tables(grown, rebuilt):
    store, facts, *_ = grown
    columns = ["symbol", "last_date", "bars", "n_weeks", "n_months", F.size("tail").alias("tail"),
               F.sort_array(F.map_entries("scores")).alias("scores")]
    want = fold.initial_state(rebuilt["features"], rebuilt["signals"], facts).select(*columns)
    assert sorted(map(str, store.read("state").select(*columns).collect())) == sorted(map(str, want.collect()))


def test_a_delivery_offered_again_changes_nothing(grown):
    store, facts, _, _, _, batch = grown
    version, files = store.version(), store.files("signals")
    report = fold.apply(store, batch(3), facts)
    assert report == fold.Report(version, 0, 0, 0, 0)
    assert store.version() == version and store.files("signals") == files


def test_the_fold_reads_state_and_delivery_only(grown):
    """The plans of new rows hold no scan of a panel's history."""
    store, facts, _, _, _, batch = grown
    state = store.read("state")
    bars = batch(3)
    panel = fold._short_panel(bars, state, facts)
    for df in (panel, fold._signal_rows(panel, facts), fold._periods_onward(bars, state, fold.FRAMES[0])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        files = df.inputFiles()
        assert "part__" in plan and files
        assert all("/data/state/" in f for f in files), files


def test_a_failing_fold_leaves_the_tables(grown, spark):
    store, facts, _, _, _, batch = grown
    version = store.version()
    bad = batch(3).withColumn("trade_date", F.date_add("trade_date", 30)).withColumn(
        "volume", F.when(F.col("symbol") == "EVE.NS", F.raise_error(F.lit("torn")).cast("long")).otherwise(F.col("volume")))
    with pytest.raises(Exception, match="torn"):
        fold.apply(store, bad, facts)
    assert store.version() == version


def test_the_first_build_writes_each_table_once(spark, panel, monkeypatch):
    kept = []
    store = lambda df, name: kept.append(name) or df.cache()
    monkeypatch.setattr(fold, "materialize", store)
    bars = panel({"A.NS": [100 + k % 9 for k in range(60)], "B.NS": [50 + k % 7 for k in range(60)]})
    target = Snapshots(spark, f"{shared_folder(spark)}/fold/{uuid.uuid4().hex}")
    assert fold.build(target, bars, fold.Facts(), files=4) == 1
    assert kept == ["fold_clean"]
    assert target.tables() == ["bars", "features", "price_action", "signals", "state", "timeframes"]
    assert {n: target.read(n).count() for n in target.tables() if n != "state"} == dict.fromkeys(
        ("bars", "features", "price_action", "signals", "timeframes"), 120)


def test_independent_jobs_run_side_by_side(spark):
    met = threading.Barrier(2, timeout=60)
    assert at_once(spark, lambda: met.wait() >= 0, lambda: met.wait() >= 0) == [True, True]
    done = []
    with pytest.raises(ZeroDivisionError):
        at_once(spark, lambda: 1 // 0, lambda: done.append(spark.range(3).count()))
    assert done == [3]


def test_only_recent_rows_go_through_the_windows(grown):
    store, facts, _, _, _, batch = grown
    bars = batch(3)
    panel = fold._short_panel(bars, store.read("state"), facts)
    per_symbol = panel.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("__new").alias("new")).collect()
    assert per_symbol and all(r.n - r.new <= fold.RECENT < 60 < fold.TAIL for r in per_symbol)


def test_windows_over_arrays_equal_rolling_ones(spark, panel):
    closes = [3.0, 9.0, None, 1.0, 7.0, 2.0, None, None, 5.0]
    rows = spark.createDataFrame([("A", k, c) for k, c in enumerate(closes)], "symbol string, trade_date int, x double")
    values = F.collect_list(F.struct("x")).over(series().rowsBetween(Window.unboundedPreceding, 0))["x"]
    for n, need, shift in ((3, 2, 0), (4, 3, 1), (20, 5, 1), (1, 1, 0)):
        got = rows.withColumn("all", values).select(
            "trade_date", fold._extreme(F.array_max, F.col("all"), n, need, shift).alias("top"),
            roll(F.max, F.col("x"), n, need, shift).alias("want"),
            fold._back(F.col("all"), 2).alias("back"))
        for r in got.collect():
            assert r.top == r.want, (n, need, shift, r)
            assert r.back == (closes[r.trade_date - 2] if r.trade_date >= 2 else None)


def test_a_delivery_leaves_no_tables_of_its_own(spark, panel, monkeypatch):
    folder = f"/tmp/fold-{uuid.uuid4().hex}"
    monkeypatch.setattr("barquet.session.shared_folder", lambda _: folder)
    bars = panel({"A.NS": [100 + k % 9 for k in range(60)], "B.NS": [50 + k % 7 for k in range(60)]})
    store = Snapshots(spark, f"{folder}/store")
    last = F.lit(weekdays(60)[-1])
    fold.build(store, bars.filter(F.col("trade_date") < last), fold.Facts(), files=4)
    assert fold.apply(store, bars.filter(F.col("trade_date") == last), fold.Facts()).folded == 2
    assert list(Path(folder, "tables").iterdir()) == []
    assert store.read("signals").count() == 120
