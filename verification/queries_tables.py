"""Source, sink, cleaning and incremental-ingest queries."""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet import config
from barquet.operators import cleaning
from barquet.plans import store
from barquet.schemas import TRADES
from barquet.session import materialize, shared_folder
from barquet.sources import listings, scans, sinks
from barquet.sources.snapshots import Snapshots
from barquet.streaming import incremental
from verification.registry import register
from verification.sql_stages import CTE
from verification.stages import Stages

C = F.col


def _fresh(s: Stages, name: str) -> str:
    return f"{shared_folder(s.spark)}/out/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ scans
@register("price_scan", """
SELECT symbol, count(*) AS bars, min(trade_date) AS first_day, max(trade_date) AS last_day,
       sum(volume)::BIGINT AS volume, round(sum(close_price), 2) AS closes FROM bars GROUP BY 1""")
def _(s: Stages):
    """Stored panel read back with its declared schema."""
    path = _fresh(s, "prices")
    s.bars().write.parquet(path)
    return scans.read_prices(s.spark, path).groupBy("symbol").agg(
        F.count("*").alias("bars"), F.min("trade_date").alias("first_day"),
        F.max("trade_date").alias("last_day"), F.sum("volume").alias("volume"),
        F.round(F.sum("close_price"), 2).alias("closes"),
    )


@register("feature_scan", """
SELECT symbol, trade_date, close_price, trend_score,
       CASE WHEN trend_score = 2 THEN 0 ELSE is_earnings_day END AS is_earnings_day FROM features""")
def _(s: Stages):
    """A missing earnings mark reads as 0."""
    holes = s.features().withColumn(
        "is_earnings_day", F.when(C("trend_score") != 2, C("is_earnings_day"))
    )
    return scans.feature_panel(holes).select(
        "symbol", "trade_date", "close_price", "trend_score", "is_earnings_day"
    )


@register("pruned_scans", """
SELECT symbol, trade_date, close_price, high_price, low_price, round(ema_50, 4) AS ema_50,
       round(relative_volume, 6) AS relative_volume FROM features""")
def _(s: Stages):
    """S3."""
    return scans.price_action_panel(s.features()).withColumns(
        {"ema_50": F.round("ema_50", 4), "relative_volume": F.round("relative_volume", 6)}
    )


@register("bulk_range", """
SELECT b.symbol, b.trade_date, b.high_price, b.low_price, b.close_price FROM bars b
WHERE b.trade_date BETWEEN DATE '2020-06-01' AND DATE '2021-06-30'
  AND b.symbol IN (SELECT symbol FROM signals WHERE breakout_signal = 1)""")
def _(s: Stages):
    """S5."""
    hits = s.signals().filter(C("breakout_signal") == 1)
    return scans.bulk_range(
        s.bars(), hits, datetime.date(2020, 6, 1), datetime.date(2021, 6, 30)
    )


# ------------------------------------------------------------------ listings
def _csv(s: Stages, df: DataFrame, name: str) -> DataFrame:
    path = _fresh(s, name)
    sinks.export_csv(df, path)
    return s.spark.read.option("header", True).csv(path)


@register("constituent_list", """
SELECT symbol, company_name, sector, isin FROM universe""")
def _(s: Stages):
    """Untidy headers, padding, header echoes and repeats."""
    tidy = s.universe()
    messy = tidy.select(
        F.concat(F.lit(" "), F.lower("symbol")).alias("Symbol "),
        F.concat("company_name", F.lit("  ")).alias("Company Name"),
        C("sector").alias("Industry"), C("isin").alias("ISIN Code"),
    )
    echo = messy.limit(1).select(
        F.lit("Symbol").alias("Symbol "), F.lit("Company Name").alias("Company Name"),
        F.lit("Industry").alias("Industry"), F.lit("ISIN Code").alias("ISIN Code"),
    )
    return listings.normalize_constituents(
        _csv(s, messy.unionByName(messy).unionByName(echo), "constituents")
    )


@register("equity_list", """
SELECT symbol, company_name, NULL::VARCHAR AS sector, isin FROM universe
WHERE NOT is_active OR sector IS DISTINCT FROM 'AFRICA'""")
def _(s: Stages):
    """Tradable series only."""
    series = (
        F.when(~C("is_active"), " BZ").when(C("sector") == "AFRICA", "SM")
        .when(C("sector") == "ASIA", "BE").otherwise("EQ ")
    )
    raw = s.universe().select(
        C("symbol").alias("SYMBOL"), C("company_name").alias("NAME OF COMPANY"),
        series.alias(" SERIES"), C("isin").alias(" ISIN NUMBER"),
    )
    return listings.normalize_equity_list(_csv(s, raw, "equity"))


@register("price_file", """
SELECT symbol, trade_date, CASE WHEN volume > 20000000 THEN NULL ELSE open_price END AS open_price,
       high_price, low_price, close_price, volume FROM bars""")
def _(s: Stages):
    """Text prices, some of them unreadable."""
    raw = s.bars().select(
        "symbol", C("trade_date").cast("timestamp").alias("Date"),
        F.when(C("volume") > 20_000_000, "n/a").otherwise(C("open_price").cast("string"))
        .alias("Open"),
        C("high_price").alias("High"), C("low_price").alias("Low"),
        C("close_price").alias("Close"), C("volume").alias("Volume"),
    )
    return listings.normalize_prices(_csv(s, raw, "prices"))


# ------------------------------------------------------------------ sinks
_SIG = ("symbol", "trade_date", "composite_score", "ev_score", "stage2_days")


@register("sink_rebuild", """
SELECT symbol, trade_date, composite_score, CASE WHEN stage2_days = 0 THEN NULL ELSE ev_score END AS ev_score,
       stage2_days FROM signals""")
def _(s: Stages):
    """Declared columns, repeated keys and NaN cleaned away, written twice."""
    path = _fresh(s, "rebuild")
    rows = s.signals().withColumn(
        "ev_score", F.when(C("stage2_days") == 0, F.lit(float("nan"))).otherwise(C("ev_score"))
    )
    sinks.rebuild(rows.limit(10), path, _SIG)
    sinks.rebuild(rows.unionByName(rows), path, _SIG)
    return s.spark.read.parquet(path)


@register("sink_bucketed", """
SELECT symbol, count(*) AS bars, round(max(close_price), 2) AS top FROM bars GROUP BY 1""")
def _(s: Stages):
    """S9 as a panel bucketed by symbol: the roll-up needs no exchange."""
    name = f"bars_{uuid.uuid4().hex}"
    sinks.rebuild_bucketed(s.bars(), name, _fresh(s, name), config.PRICE_COLUMNS, buckets=8)
    return s.spark.table(name).groupBy("symbol").agg(
        F.count("*").alias("bars"), F.round(F.max("close_price"), 2).alias("top")
    )


_FUND = "symbol, trade_date, roe, quality_score"


@register("sink_replace_dates", f"""
SELECT symbol, trade_date, roe, CASE WHEN trade_date = (SELECT max(trade_date) FROM fundamentals)
  THEN quality_score + 1 ELSE quality_score END AS quality_score
FROM fundamentals WHERE trade_date < (SELECT max(trade_date) FROM fundamentals) OR roe IS NOT NULL""")
def _(s: Stages):
    """One date replaced, the others untouched."""
    path = _fresh(s, "dates")
    rows = s.fundamentals().select(*_FUND.split(", "))
    key = ("symbol", "trade_date")
    sinks.replace_dates(rows, path, key)
    last = rows.agg(F.max("trade_date").alias("trade_date"))
    sinks.replace_dates(
        rows.join(F.broadcast(last), "trade_date", "left_semi").filter(C("roe").isNotNull())
        .withColumn("quality_score", C("quality_score") + 1).select(*rows.columns),
        path, key,
    )
    return s.spark.read.parquet(path).select(*rows.columns)


@register("sink_replace_keys", f"""
SELECT symbol, trade_date, CASE WHEN quality_score >= 6 THEN -1.0 ELSE roe END AS roe, quality_score
FROM fundamentals""")
def _(s: Stages):
    """Only the keys brought along are replaced within a date."""
    path = _fresh(s, "keys")
    rows = s.fundamentals().select(*_FUND.split(", "))
    sinks.replace_dates(rows, path, ("symbol", "trade_date"))
    sinks.replace_keys_on_date(
        rows.filter(C("quality_score") >= 6).withColumn("roe", F.lit(-1.0)), s.spark, path
    )
    return s.spark.read.parquet(path).select(*rows.columns)


@register("sink_insert_absent", "SELECT symbol, earnings_date, fetched_at FROM earnings")
def _(s: Stages):
    """The same batch twice over a partly filled table."""
    path = _fresh(s, "absent")
    rows = s.earnings()
    rows.filter(C("earnings_date") < "2021-01-01").write.parquet(path)
    for _i in range(2):
        sinks.insert_absent(
            rows.unionByName(rows), s.spark, path, ("symbol", "earnings_date")
        )
    return s.spark.read.parquet(path)


@register("sink_csv", """
SELECT strategy, symbol, entry_date, entry_price, exit_date, exit_price, return_pct, holding_days,
       exit_reason, composite_score, regime FROM trades""")
def _(s: Stages):
    """Exported trades read back."""
    path = _fresh(s, "trades")
    sinks.export_csv(s.trades().select(*TRADES.names), path)
    return s.spark.read.schema(TRADES).option("header", True).csv(path)


# ------------------------------------------------------------------ cleaning
@register("valid_candles", "SELECT * FROM clean_dirty")
def _(s: Stages):
    """F1."""
    return cleaning.valid_candles(s.dirty_bars())


CTE["plausible"] = """
SELECT DISTINCT * FROM dirty_bars WHERE high_price >= low_price AND open_price > 0 AND close_price > 0
  AND volume >= 0 AND abs(close_price / open_price) < 5"""


@register("plausible_bars", "SELECT * FROM plausible")
def _(s: Stages):
    """F2."""
    return cleaning.plausible_bars(s.dirty_bars())


@register("without_volume_spikes", """
SELECT p.* FROM plausible p JOIN (SELECT symbol, quantile_cont(volume, 0.5) AS med FROM plausible GROUP BY 1) m
  ON m.symbol = p.symbol WHERE m.med <= 0 OR p.volume < m.med * 100""")
def _(s: Stages):
    """F3."""
    return cleaning.without_volume_spikes(cleaning.plausible_bars(s.dirty_bars()))


@register("closed_bars", "SELECT * FROM bars WHERE trade_date <= (SELECT d FROM screen_day)")
def _(s: Stages):
    """before the close, the day itself is still open."""
    after = datetime.datetime.combine(s.screen_day(), datetime.time(10, 0))
    return incremental.closed_bars(s.bars(), incremental.last_closed_session(after))


_PLAN = """
SELECT symbol, latest_date, mode,
       CASE WHEN mode = 'incremental' THEN CAST(latest_date + 1 AS DATE) END AS start_date,
       CASE WHEN mode <> 'skip' THEN cutoff END AS end_date
FROM (SELECT *, CASE WHEN latest_date IS NULL THEN 'historical' WHEN latest_date >= cutoff THEN 'skip'
                     ELSE 'incremental' END AS mode
      FROM (SELECT t.symbol, {cut} AS cutoff, CASE WHEN b.d <= {asof} THEN b.d END AS latest_date
            FROM tickers t LEFT JOIN (SELECT symbol, max(trade_date) AS d FROM bars GROUP BY 1) b
              ON b.symbol = t.symbol))"""


@register("fetch_plan", _PLAN.format(
    cut="(SELECT d FROM last_day)", asof="(SELECT d FROM last_day)"))
def _(s: Stages):
    """F5."""
    from verification.queries_market import _tickers

    return incremental.fetch_plan(_tickers(s), s.bars(), s.last_day(), s.last_day())


@register("fetch_plan_future_dates", _PLAN.format(
    cut="(SELECT d - 30 FROM last_day)", asof="(SELECT d - 30 FROM last_day)"))
def _(s: Stages):
    """stored dates in the future count as none."""
    from verification.queries_market import _tickers

    day = s.last_day() - datetime.timedelta(days=30)
    return incremental.fetch_plan(_tickers(s), s.bars(), day, day)


@register("valid_features", """
SELECT symbol, trade_date, close_price, trend_score FROM features WHERE weinstein_stage <> 3""")
def _(s: Stages):
    """repeated keys and rows without a close go."""
    rows = s.features().withColumn(
        "close_price", F.when(C("weinstein_stage") != 3, C("close_price"))
    )
    return cleaning.valid_features(rows.unionByName(rows)).select(
        "symbol", "trade_date", "close_price", "trend_score"
    )


@register("valid_price_action_rows", """
SELECT symbol, trade_date, close_price, high_price, low_price, round(ema_50, 4) AS ema_50,
       round(relative_volume, 6) AS relative_volume FROM features WHERE relative_volume IS NOT NULL""")
def _(s: Stages):
    """F8."""
    return cleaning.valid_price_action_rows(scans.price_action_panel(s.features())).withColumns(
        {"ema_50": F.round("ema_50", 4), "relative_volume": F.round("relative_volume", 6)}
    )


@register("valid_timeframe_rows", """
SELECT symbol, trade_date, close_price FROM features WHERE volume < 5000000""")
def _(s: Stages):
    """F8."""
    rows = s.features().withColumn(
        "close_price", F.when(C("volume") < 5_000_000, C("close_price"))
    )
    return cleaning.valid_timeframe_rows(scans.timeframe_panel(rows))


@register("usable_earnings_dates", """
SELECT symbol, earnings_date FROM earnings WHERE earnings_date <= (SELECT min(trade_date) FROM bars) + 465""")
def _(s: Stages):
    """F14."""
    day = s.first_day() + datetime.timedelta(days=100)
    stamped = s.earnings().select("symbol", C("earnings_date").cast("timestamp").alias("earnings_date"))
    return cleaning.usable_earnings_dates(stamped, day)


@register("incremental_append", "SELECT * FROM bars")
def _(s: Stages):
    """The full history offered twice to a half-filled table."""
    path = _fresh(s, "append")
    s.bars().filter(C("trade_date") < "2021-03-01").write.parquet(path)
    for _i in range(2):
        stored = s.spark.read.parquet(path)
        new = incremental.new_bars(s.bars().unionByName(s.bars()), stored)
        materialize(new, "append").write.mode("append").parquet(path)
    return s.spark.read.parquet(path)


# ------------------------------------------------------------------ the whole day
CTE["gated_days"] = """
SELECT e.cash_mode, e.cash_mode OR NOT e.allow_breakouts OR coalesce(x.distribution_count, 0) >= 5 AS shut
FROM environment e LEFT JOIN distribution x ON x.trade_date = e.trade_date ORDER BY e.trade_date DESC LIMIT 1"""


@register("daily_tables", """
SELECT 'features' AS name, count(*) AS rows, sum(trend_score)::BIGINT AS total FROM features
UNION ALL SELECT 'regime', count(*), sum(regime_score)::BIGINT FROM regime
UNION ALL SELECT 'environment', count(*), sum(CASE WHEN cash_mode THEN 1 ELSE 0 END)::BIGINT FROM environment
UNION ALL SELECT 'signals', count(*),
  (sum(breakout_ready_signal) - (SELECT CASE WHEN shut THEN (SELECT coalesce(sum(breakout_ready_signal), 0)
     FROM signals WHERE trade_date = (SELECT d FROM last_day)) ELSE 0 END FROM gated_days))::BIGINT FROM signals
UNION ALL SELECT 'price_action', count(*), sum(pa_signal)::BIGINT FROM price_action
UNION ALL SELECT 'timeframes', count(*), sum(mtf_score)::BIGINT FROM timeframes""")
def _(s: Stages):
    """All daily tables built and stored in order, with one control total each."""
    inputs = store.Inputs(
        s.bars(), s.index_bars(), s.market_states(), s.universe(), s.earnings(),
        s.fundamentals(), s.vol_index(),
    )
    tables = store.build_all(inputs, Snapshots(s.spark, _fresh(s, "day")), s.last_day())
    totals = {
        "features": F.sum("trend_score"), "regime": F.sum("regime_score"),
        "environment": F.sum(C("cash_mode").cast("int")),
        "signals": F.sum("breakout_ready_signal"), "price_action": F.sum("pa_signal"),
        "timeframes": F.sum("mtf_score"),
    }
    parts = [
        tables[n].agg(F.count("*").alias("rows"), total.cast("bigint").alias("total"))
        .select(F.lit(n).alias("name"), "rows", "total")
        for n, total in totals.items()
    ]
    return reduce(DataFrame.unionByName, parts)
