"""Screens, presets, sinks, incremental ingest and the classifier."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barquet import config
from barquet.operators import boosting, cleaning, ml, screen, serving
from barquet.plans.screening import run_screen
from barquet.sources import listings, scans, sinks
from barquet.streaming import incremental
from tests.conftest import weekdays


# ------------------------------------------------------------------ configuration
def test_configured_weights():
    assert sum(config.COMPOSITE_WEIGHTS.values()) == 100
    pa = config.DEFAULTS.price_action
    assert sum((pa.score_daily, pa.score_weekly, pa.score_close, pa.score_volume,
                pa.score_momentum, pa.score_extension)) == 100
    assert pa.volume_min < pa.volume_max and pa.min_extension < pa.max_extension
    assert config.DEFAULT_PRESET == next(iter(config.PRESETS)) and len(config.PRESETS) == 15
    s = config.DEFAULTS.sector
    assert s.trend_weight + s.rs_weight + s.stage2_weight + s.score_weight == pytest.approx(1)


# ------------------------------------------------------------------ screens
@pytest.fixture
def rows(spark):
    data = [
        ("A", 90.0, 10.0, 1, 1, 1, None), ("B", 60.0, None, 0, 1, 1, 5.0), ("C", 40.0, 99.0, 1, 0, 0, 7.0),
        ("D", 10.0, 5.0, 0, 0, 1, 2.0), ("E", 55.0, 30.0, 0, 0, 0, 1.0),
    ]
    return spark.createDataFrame(
        data, "symbol string, composite_score double, ev_score double, vcp_signal int, "
        "breakout_signal int, liquidity_signal int, fund_roe double")


def hits(rows, *conditions):
    return {r.symbol for r in screen.screen(rows, conditions).collect()}


def test_screen_conditions(rows):
    t = screen.Test
    assert hits(rows) == set("ABCDE")
    assert hits(rows, t("Score", ">=", 55)) == set("ABE")
    assert hits(rows, t("ROE%", "<", 100)) == set("BCDE")  # unknown values fail
    assert hits(rows, t("IC", "=", 1)) == set("ABCDE")  # absent columns hold
    assert hits(rows, *screen.between("Score", 40, 60)) == set("BCE")
    assert hits(rows, t("VCP", "=", "tick"), t("Liquid", "=", "yes")) == {"A"}
    assert hits(rows, t("Liquid", "=", "off")) == set("CE")
    assert hits(rows, screen.AnyOf((t("VCP", "=", 1), t("Breakout", "=", 1)))) == set("ABC")
    # left fold: (VCP or Breakout) and Liquid
    assert hits(rows, t("VCP", "=", 1), t("Breakout", "=", 1, "OR"), t("Liquid", "=", 1)) == set("AB")


def test_two_tiers(rows):
    got = screen.two_tier_sort(rows, "Score").collect()
    assert [r.symbol for r in got] == ["E", "A", "B", "C", "D"]
    assert [r.ev_score for r in got] == [30.0, 10.0, None, None, None]
    by_roe = screen.two_tier_sort(rows, "ROE%", ascending=True).collect()
    assert [r.symbol for r in by_roe] == ["E", "D", "B", "C", "A"]  # nobody reaches 50


def test_reweighting_ranks_densely_and_skips_absent_columns(rows):
    got = {r.symbol: (r.composite_score, r.composite_rank) for r in screen.reweight(
        rows, {"vcp_signal": 2, "breakout_signal": 1, "no_signal": 50, "liquidity_signal": 0}
    ).collect()}
    assert got == {"A": (100.0, 1), "C": (66.7, 2), "B": (33.3, 3), "D": (0.0, 4), "E": (0.0, 4)}


def test_conditions_see_only_the_top_rows(rows):
    full = rows.withColumns({c: F.lit(1) for c in (
        "trend_signal", "rs_signal", "rs_new_high", "mtf_score")}).withColumns(
        {"pivot_price": F.lit(10.0), "trailing_stop_price": F.lit(None).cast("double")})
    named = screen.NamedScreen((screen.Test("Liquid", "=", 1),))
    got = run_screen(full, named, top_n=3).collect()  # top 3 by value: C, E, A
    assert [r.symbol for r in got] == ["A"]
    assert got[0].safe_exit_price is None and got[0].trend_health == "TREND"


@pytest.mark.parametrize("flags, want", [
    ((1, 2, 1, 1), "ROCKET"), ((1, 2, 1, 0), "STRONG"), ((1, 1, 0, 0), "TREND"),
    ((1, 0, 1, 1), "COOL"), ((0, 2, 1, 1), "EXIT"), ((1, 2, 0, 1), "TREND"),
])
def test_trend_health(spark, flags, want):
    df = spark.createDataFrame(
        [flags], "trend_signal int, mtf_score int, rs_signal int, rs_new_high int")
    assert screen.trend_health(df).first().trend_health == want


def test_presets_round_trip(spark):
    presets, default = serving.load_presets(serving.preset_table(spark))
    assert presets == config.PRESETS and default == config.DEFAULT_PRESET
    assert list(presets) == list(config.PRESETS)
    empty = serving.preset_table(spark).filter("weight < 0")
    assert serving.load_presets(empty)[0] == config.PRESETS


# ------------------------------------------------------------------ sources
def test_untidy_constituent_headers(spark):
    raw = spark.createDataFrame(
        [(" aa ", "Alpha ", "Tech", "I1"), ("AA", "Alpha ", "Tech", "I1"), ("symbol", "x", "y", "z"),
         (None, "n", "n", "n")], "` Symbol` string, `Company Name` string, `Industry` string, `ISIN Code` string")
    got = listings.normalize_constituents(raw).collect()
    assert [tuple(r) for r in got] == [("AA", "Alpha", "Tech", "I1")]
    with pytest.raises(ValueError):
        listings.normalize_constituents(raw.drop(" Symbol"))


def test_price_file_without_a_date_is_refused(spark):
    raw = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1)], list(listings.PRICE_HEADERS))
    with pytest.raises(ValueError, match="date"):
        listings.normalize_prices(raw)


def test_one_symbol_scan_pushes_its_filter(spark, panel, tmp_path):
    panel({"A": [1.0, 2.0], "B": [3.0]}).write.parquet(str(tmp_path / "p"))
    df = scans.symbol_history(scans.read_prices(spark, str(tmp_path / "p")), "A")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,A)" in plan and df.count() == 2


# ------------------------------------------------------------------ sinks
def test_replace_one_date_twice(spark, panel, tmp_path):
    path = str(tmp_path / "t")
    bars = panel({"A": [1.0, 2.0, 3.0], "B": [4.0, 5.0, 6.0]})
    key = ("symbol", "trade_date")
    sinks.replace_dates(bars, path, key)
    day = weekdays(3)[1]
    new = bars.filter((F.col("trade_date") == day) & (F.col("symbol") == "A")).withColumn(
        "close_price", F.lit(float("nan")))
    for _ in range(2):
        sinks.replace_dates(new, path, key)
    got = spark.read.parquet(path)
    assert got.count() == 5
    assert [r.close_price for r in got.filter(F.col("trade_date") == day).collect()] == [None]


def test_rebuild_by_date_writes_one_file_per_date(spark, panel, tmp_path):
    path = tmp_path / "t"
    bars = panel({f"S{i}": [1.0] * 4 for i in range(20)})
    sinks.rebuild(bars, str(path), config.PRICE_COLUMNS, partition_by="trade_date")
    assert len(list(path.glob("trade_date=*/*.parquet"))) == 4
    assert spark.read.parquet(str(path)).count() == 80


def test_unique_rows_keeps_whole_rows(spark):
    rows = [("A", 1, 1.0, None), ("A", 1, None, 1.0), ("A", 1, None, 1.0), ("B", 1, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, d int, x double, y double")
    got = {tuple(r) for r in sinks.unique_rows(df, ("symbol", "d")).collect()}
    assert len(got) == 2 and got <= set(rows)
    text = df.withColumn("t", F.coalesce(F.col("x").cast("string"), F.lit("-")))
    assert sinks.unique_rows(text, ("symbol", "d")).count() == 2


def test_copies_are_reduced_before_the_shuffle(spark, panel):
    df = panel({"HOT": [100.0] * 3})
    hot = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    out = cleaning.valid_candles(hot)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan
    assert out.count() == 3


def test_bucketed_panels_join_without_a_shuffle(spark, panel, tmp_path):
    bars = panel({f"S{i}": [1.0, 2.0] for i in range(9)})
    for n in ("left", "right"):
        sinks.rebuild_bucketed(bars, f"b_{n}", str(tmp_path / n), config.PRICE_COLUMNS, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.table("b_left").join(
            spark.table("b_right").select("symbol", "trade_date", F.col("volume").alias("v2")),
            ["symbol", "trade_date"])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 18
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in plan


def test_screen_names_resolve_or_fail(rows):
    upper = screen.screen(rows, [screen.Test("Score", ">=", 50)]).count()
    assert 0 < upper < rows.count()
    for name in ("score", " SCORE ", "composite_score"):
        assert screen.screen(rows, [screen.Test(name, ">=", 50)]).count() == upper
    with pytest.raises(ValueError, match="unknown screen field"):
        screen.screen(rows, [screen.Test("Scoer", ">=", 50)])
    with pytest.raises(ValueError, match="unknown operator"):
        screen.screen(rows, [screen.Test("Score", "=>", 50)])
    key = lambda df: [r.symbol for r in df.collect()]
    assert key(screen.two_tier_sort(rows, "nothing")) == key(screen.two_tier_sort(rows, "Score"))


def test_best_round_waits_for_patience():
    falls = [1.0, 0.9, 0.95, 0.96, 0.8, 0.85, 0.86, 0.87, 0.5]
    assert boosting.best_round(falls, 3) == (5, True)
    assert boosting.best_round(falls, 4) == (9, False)
    assert boosting.best_round([3.0], 5) == (1, False)


# ------------------------------------------------------------------ incremental
def test_session_cutoff():
    assert incremental.last_closed_session(datetime(2024, 1, 5, 9, 59)) == date(2024, 1, 4)
    assert incremental.last_closed_session(datetime(2024, 1, 5, 10, 0)) == date(2024, 1, 5)


def test_fetch_plan(spark):
    day = date(2024, 1, 10)
    prices = spark.createDataFrame(
        [("UP", day), ("BEHIND", date(2024, 1, 3)), ("FUTURE", date(2025, 1, 1))],
        "symbol string, trade_date date")
    symbols = spark.createDataFrame([(s,) for s in ("UP", "BEHIND", "FUTURE", "NEW")], "symbol string")
    got = {r.symbol: (r["mode"], r.start_date, r.end_date)
           for r in incremental.fetch_plan(symbols, prices, day, day).collect()}
    assert got == {"UP": ("skip", None, None), "BEHIND": ("incremental", date(2024, 1, 4), day),
                   "FUTURE": ("historical", None, day), "NEW": ("historical", None, day)}


def test_new_bars_are_new(panel):
    bars = panel({"A": [1.0, 2.0, 3.0]})
    stored = bars.filter(F.col("trade_date") < weekdays(3)[2])
    got = incremental.new_bars(bars.unionByName(bars), stored).collect()
    assert [r.close_price for r in got] == [3.0]
    assert incremental.new_bars(bars, bars).count() == 0


def test_ingest_canary(spark):
    row = ("T", date(2000, 1, 3), 100.0, 110.0, 95.0, 108.0, 100000)
    df = spark.createDataFrame([row], "symbol string, trade_date date, open_price double, "
                               "high_price double, low_price double, close_price double, volume long")
    assert [tuple(r) for r in cleaning.valid_candles(df).collect()] == [row]
    assert [tuple(r) for r in cleaning.plausible_bars(df).collect()] == [row]


def test_volume_spikes(spark, panel):
    bars = panel({"A": [10.0] * 9, "ZERO": [10.0] * 3}, volume=100)
    bars = bars.withColumn("volume", F.when(F.col("symbol") == "ZERO", 0).when(
        F.col("trade_date") == weekdays(9)[4], 10_000).otherwise(F.col("volume")).cast("long"))
    got = cleaning.without_volume_spikes(bars)
    assert got.filter("symbol = 'A'").count() == 8 and got.filter("symbol = 'ZERO'").count() == 3


# ------------------------------------------------------------------ classifier
def labelled(spark, n):
    days = weekdays(n)
    rows = []
    for i in range(n):
        win = int(i % 3 == 0)
        rows.append((f"S{i}", days[i], win, *[float((i * 7 + k) % 5) + (3 * win if k == 0 else 0)
                                              for k in range(len(config.ML_FEATURES))]))
    return spark.createDataFrame(
        rows, "symbol string, trade_date date, label int, "
        + ", ".join(f"{c} double" for c in config.ML_FEATURES))


def test_too_few_rows_are_refused(spark):
    with pytest.raises(ValueError, match="need at least 50"):
        ml.train(labelled(spark, 49))


def test_split_keeps_the_label_shares(spark):
    marked = ml.mark_test_rows(labelled(spark, 600))
    share = {r.label: r.s for r in marked.groupBy("label").agg(
        F.avg(F.col("is_test").cast("double")).alias("s")).collect()}
    assert share[0] == pytest.approx(0.2, abs=0.01) and share[1] == pytest.approx(0.2, abs=0.01)
    again = ml.mark_test_rows(labelled(spark, 600).repartition(5))
    key = lambda df: {(r.symbol, r.is_test) for r in df.select("symbol", "is_test").collect()}
    assert key(marked) == key(again)


def test_train_score_save_load(spark, tmp_path):
    rows = labelled(spark, 300).withColumn(
        "pa_score", F.when(F.col("symbol") != "S1", F.col("pa_score")))
    model, metrics = ml.train(rows, trees=5)
    assert 1 <= metrics["trees"] <= 5 and len(model.trees) == metrics["trees"]
    assert metrics["auc"] > 0.7 and metrics["n_train"] + metrics["n_test"] == 300
    assert len(metrics["top_features"]) == 5
    path = str(tmp_path / "model")
    assert ml.load(spark, path) is None
    ml.save(spark, model, path)
    a = ml.score(model, rows).orderBy("symbol").collect()
    b = ml.score(ml.load(spark, path), rows).orderBy("symbol").collect()
    assert a == b and all(0 <= r.ml_win_prob <= 1 for r in a)
    assert all(r.ml_signal == int(r.ml_win_prob >= 0.6) for r in a)
    assert timedelta(days=1)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from barquet.session import shared_folder

    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)
    session.conf.get = lambda *_: "hdfs://shared"
    assert shared_folder(session) == "hdfs://shared"


def test_per_symbol_function_may_fail_for_one_symbol(panel):
    from barquet.functions.custom import per_symbol

    def fn(pdf):
        if pdf["symbol"].iloc[0] == "BAD":
            raise ValueError("no")
        return pdf.groupby("symbol", as_index=False)["close_price"].sum()

    df = panel({"A": [1.0, 2.0], "BAD": [1.0]}).select("symbol", "close_price")
    schema = "symbol string, close_price double"
    assert [tuple(r) for r in per_symbol(df, fn, schema).collect()] == [("A", 3.0)]
    with pytest.raises(Exception, match="no"):
        per_symbol(df, fn, schema, on_error="raise").collect()
