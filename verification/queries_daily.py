"""Queries over tables that grew by deliveries, and over stored panels with history."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet import config
from barquet.operators import calibration, cleaning, quality, serving
from barquet.session import shared_folder
from barquet.sources import scans
from barquet.sources.snapshots import Snapshots
from barquet.streaming import fold
from verification.check import stored_names
from verification.fixtures import supplier_number
from verification.queries_panel import CONTRACTION, EMAS, FULL, LATER, MTF, PA_DAY, PA_NUM, PIVOT, PRICES, VOL, show, shown
from verification.registry import register
from verification.stages import Stages

C = F.col
_GROWN: dict[tuple, Snapshots] = {}


def _store(s: Stages, name: str) -> Snapshots:
    return Snapshots(s.spark, f"{shared_folder(s.spark)}/out/{name}-{uuid.uuid4().hex}")


def deliveries(s: Stages) -> DataFrame:
    """Bars with the delivery they come in: 0 for the first build, then three more.

    Each symbol's last three bars come one by one. Every fifth symbol has halted before; every
    seventh gets an older bar late, with the second delivery; every thirteenth is new in it.
    """
    left = F.count("*").over(Window.partitionBy("symbol")) - 1 - C("i")
    k = supplier_number(C("symbol"))
    number = F.when(k % 13 == 5, 2).when((k % 7 == 3) & (left == 9), 2)
    number = number.when((k % 5 == 2) | (left > 2), 0).otherwise(3 - left)
    return s.raw_bars().select(*config.PRICE_COLUMNS, number.alias("delivery"))


def grown(s: Stages) -> Snapshots:
    """The tables after the first build and three deliveries, the last one offered twice. Nobody reads
    the versions before."""
    key = s._key("grown")
    if key not in _GROWN:
        store, facts = _store(s, "grown"), fold.Facts(s.earnings(), s.index_bars(), s.fundamentals())
        parts = s._stored("deliveries", lambda: deliveries(s))
        batch = lambda n: parts.filter(C("delivery") == n).drop("delivery")
        fold.build(store, batch(0), facts)
        for n in (1, 2, 3):
            fold.apply(store, batch(n), facts)
            store.vacuum()
        fold.apply(store, batch(3), facts)
        _GROWN[key] = store
    return _GROWN[key]


_FLAGS = (
    "close_price", "trend_signal", "stage2_signal", "stage2_days", "stage2_started_date", *CONTRACTION, "vcp_signal",
    "liquidity_signal", "quality_signal", "breakout_signal", "breakout_ready_signal", *PIVOT, "rs_signal", "rs_value",
    "rs_new_high", "minervini_signal", "darvas_signal", "composite_score", "institutional_candidate", *PRICES,
    "position_stage", "trailing_stop_price", *LATER,
)


@register("daily_increment", shown("signals", *_FLAGS, composite_rank=4))
def _(s: Stages):
    """Signals after three deliveries equal the full rebuild.

    The statement names two columns twice; the second of each has the name it gets in a stored table.
    """
    names = ["symbol", "trade_date", *stored_names(_FLAGS), "composite_rank"]
    return show(grown(s).read("signals"), *_FLAGS, composite_rank=4).toDF(*names)


@register("daily_increment_features", shown(
    "features", "close_price", *FULL, **EMAS, **VOL, avg_volume_20=2, relative_volume=6, high_52w=2, low_52w=2))
def _(s: Stages):
    """Features after three deliveries."""
    return show(grown(s).read("features"), "close_price", *FULL, **EMAS, **VOL,
                avg_volume_20=2, relative_volume=6, high_52w=2, low_52w=2)


@register("daily_increment_price_action", shown(
    "price_action", *PA_DAY, "pa_hh_weekly", "pa_hl_weekly", "pa_score", "pa_signal", **PA_NUM))
def _(s: Stages):
    """S13, W9-W14, G16 after three deliveries."""
    return show(grown(s).read("price_action"), *PA_DAY, "pa_hh_weekly", "pa_hl_weekly", "pa_score", "pa_signal", **PA_NUM)


@register("daily_increment_timeframes", shown(
    "timeframes", "mtf_weekly_trend", "mtf_monthly_trend", "mtf_score", **MTF))
def _(s: Stages):
    """S13, W15, G15 after three deliveries."""
    return show(grown(s).read("timeframes"), "mtf_weekly_trend", "mtf_monthly_trend", "mtf_score", **MTF)


# ------------------------------------------------------------------ reads of the grown tables
@register("stored_date_range", "SELECT min(trade_date) AS min_date, max(trade_date) AS max_date FROM bars")
def _(s: Stages):
    """A13 from the manifest: no row is read."""
    return serving.date_range(grown(s).dates("bars"))


@register("stored_trade_dates", "SELECT DISTINCT trade_date FROM signals")
def _(s: Stages):
    """A13, T8 from the manifest and the files that were replaced since."""
    return serving.trade_dates(grown(s).dates("signals"))


@register("stored_nearest_date", """
SELECT max(trade_date) AS trade_date FROM bars WHERE trade_date <= DATE '2021-05-09'""")
def _(s: Stages):
    """T6 from the manifest."""
    return serving.nearest_date(grown(s).dates("bars"), datetime.date(2021, 5, 9))


@register("stored_latest_price_date", "SELECT max(trade_date) AS trade_date FROM bars WHERE symbol = 'S7.NS'")
def _(s: Stages):
    """A13 of one symbol from its state row."""
    return serving.latest_price_date(grown(s).read("state").select("symbol", C("last_date").alias("trade_date")), "S7.NS")


@register("stored_symbol_history", "SELECT * FROM bars WHERE symbol = 'S7.NS'")
def _(s: Stages):
    """S4 on a panel in tiles: only files of its symbol range are read."""
    return scans.symbol_history(grown(s).read("bars"), "S7.NS")


@register("stored_day", shown(
    "signals WHERE trade_date = (SELECT d FROM screen_day)", "composite_score", "breakout_ready_signal", "stage2_days"))
def _(s: Stages):
    """J1, T9 on a panel in tiles: only files of its dates are read."""
    return show(grown(s).read("signals").filter(C("trade_date") == F.lit(s.screen_day())),
                "composite_score", "breakout_ready_signal", "stage2_days")


# ------------------------------------------------------------------ additive calibration
@register("confidence_increment", "SELECT * FROM confidence")
def _(s: Stages):
    """Counts up to five days ago, extended day by day, give the model of all history."""
    store, last = _store(s, "counts"), s.last_day()
    for back in (5, 4, 3, 2, 1, 0, 0):
        with store.transaction() as t:
            calibration.extend_counts(
                t, "counts", s.signals(), s.bars(), s.environment(), last - datetime.timedelta(days=back)
            )
    return calibration.confidence_rates(store.read("counts"))


# ------------------------------------------------------------------ stored panels
def _without_stale(s: Stages) -> Snapshots:
    """A stored panel after its stale rows were deleted twice."""
    store = _store(s, "stale")
    with store.transaction() as t:
        t.rebuild(cleaning.valid_candles(s.dirty_bars()), "prices", ("symbol", "trade_date"))
    for _i in range(2):
        with store.transaction() as t:
            quality.delete_stale(t, "prices", s.last_day())
    return store


@register("stale_delete", "SELECT * EXCLUDE (is_stale) FROM marked WHERE NOT is_stale")
def _(s: Stages):
    """Q1: stale rows are deleted from the stored panel; a second run finds none."""
    return _without_stale(s).read("prices")


@register("stale_delete_log", """
SELECT (SELECT d FROM last_day) AS run_date, 'stale_delete' AS check_type, symbol, count(*) AS rows_affected,
       format('{} stale rows deleted | {} → {} | price={:.2f}', count(*), CAST(min(trade_date) AS VARCHAR),
              CAST(max(trade_date) AS VARCHAR), arg_min(close_price, trade_date)) AS description
FROM marked WHERE is_stale GROUP BY symbol""")
def _(s: Stages):
    """Q1: what the deletion reports is what it deleted."""
    return _without_stale(s).read("quality_log")


_KEY = ("symbol", "trade_date")


@register("snapshot_sinks", """
SELECT symbol, trade_date, roe,
  CASE WHEN quality_score >= 6 THEN -1 WHEN trade_date = (SELECT max(trade_date) FROM fundamentals) THEN quality_score + 1
    ELSE quality_score END AS quality_score
FROM fundamentals WHERE trade_date < (SELECT max(trade_date) FROM fundamentals) OR roe IS NOT NULL""")
def _(s: Stages):
    """S9-S12 as transactions: a rebuild, a date replaced, keys replaced, absent rows inserted twice."""
    store, rows = _store(s, "sinks"), s.fundamentals().select(*_KEY, "roe", "quality_score")
    last = rows.agg(F.max("trade_date").alias("trade_date"))
    with store.transaction() as t:
        t.rebuild(rows.filter(C("quality_score") % 2 == 0), "facts", _KEY)
    for _i in range(2):
        with store.transaction() as t:
            t.insert_absent(rows.unionByName(rows), "facts", _KEY)
    with store.transaction() as t:
        newest = rows.join(F.broadcast(last), "trade_date", "left_semi").filter(C("roe").isNotNull())
        t.replace_dates(newest.withColumn("quality_score", C("quality_score") + 1), "facts", _KEY)
        t.replace_keys(rows.join(t.read("facts"), list(_KEY), "left_semi").filter(C("quality_score") >= 6)
                       .withColumn("quality_score", F.lit(-1)), "facts", _KEY)
    return store.read("facts")
