"""Regime, sector, quality, universe and fundamentals queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.config import DEFAULTS
from barquet.functions.scalars import with_suffix
from barquet.operators import cleaning, fundamentals, quality, regime, sector, signals, universe
from barquet.sources.scans import universe_symbols
from verification.registry import register
from verification.sql_stages import CTE, chg, lag, yes
from verification.stages import Stages

C = F.col


def places(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def rounded(src: str, **digits: int) -> str:
    body = ", ".join(f"round({c}, {n}) AS {c}" for c, n in digits.items())
    return f"SELECT * REPLACE ({body}) FROM {src}"


# ------------------------------------------------------------------ regime
@register("index_enriched", """
SELECT index_code, trade_date, close, round(ema_50, 3) AS ema_50, round(ema_200, 3) AS ema_200,
       round(ema_200_slope_pct, 6) AS ema_200_slope_pct, peak_20, higher_highs
FROM index_enriched""")
def _(s: Stages):
    """W16."""
    return places(regime.enrich_index(s.index_bars()).drop("volume"),
                  ema_50=3, ema_200=3, ema_200_slope_pct=6)


@register("index_return",
          "SELECT trade_date, round(index_return, 8) AS index_return FROM index_return")
def _(s: Stages):
    """W17."""
    return signals.index_returns(s.index_bars()).select(
        "trade_date", F.round("__index_return", 8).alias("index_return")
    )


_R = dict(ema_50=3, ema_200=3, ema_200_slope_pct=6)


@register("regime_history", rounded("regime", **_R))
def _(s: Stages):
    """R1, R2 and J11."""
    return places(regime.regime_history(s.index_bars(), s.market_states()), **_R)


@register("current_regime", rounded(
    "(SELECT * FROM regime ORDER BY trade_date DESC LIMIT 1)", **_R))
def _(s: Stages):
    """R1 for the newest session."""
    return places(regime.current_regime(s.index_bars(), s.market_states()), **_R)


@register("environment", "SELECT * FROM environment")
def _(s: Stages):
    """R3 and J12."""
    return regime.environment(
        regime.regime_history(s.index_bars(), s.market_states()), s.market_states()
    )


@register("distribution_days", "SELECT * FROM distribution")
def _(s: Stages):
    """R4."""
    return regime.distribution_days(s.index_bars())


CTE["ftd0"] = f"""
SELECT *, row_number() OVER (ORDER BY trade_date) AS n, lag(close) OVER (ORDER BY trade_date) AS prev,
       coalesce(volume > lag(volume) OVER (ORDER BY trade_date), FALSE) AS up_vol,
       CASE WHEN count(close) OVER w >= 5 THEN max(close) OVER w END AS peak
FROM index_bars WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
CTE["ftd1"] = "SELECT max(n) AS c FROM ftd0 WHERE n > 5 AND peak > 0 AND close / peak - 1 <= -0.05"
CTE["ftd2"] = """
SELECT n AS low_n FROM ftd0 WHERE n >= (SELECT c FROM ftd1) ORDER BY close, n LIMIT 1"""
CTE["ftd3"] = """
SELECT min(n) AS rally FROM ftd0 WHERE n > (SELECT low_n FROM ftd2) AND close > prev"""
CTE["follow"] = """
SELECT index_code, max(trade_date) AS trade_date,
       coalesce(bool_or(n >= (SELECT rally FROM ftd3) + 3 AND close / prev - 1 >= 0.017 AND up_vol), FALSE)
         AS follow_through_day
FROM ftd0 GROUP BY 1"""


@register("follow_through_day", "SELECT * FROM follow")
def _(s: Stages):
    """R5."""
    return regime.follow_through_day(s.index_bars())


CTE["vix_now"] = """
SELECT max(trade_date) AS trade_date, arg_max(close, trade_date) AS level,
       arg_max(close, trade_date) > 20 AS vix_risk_off FROM vol_index"""


@register("risk_off", "SELECT trade_date, round(level, 6) AS level, vix_risk_off FROM vix_now")
def _(s: Stages):
    """R6."""
    return places(regime.risk_off(s.vol_index()), level=6)


CTE["breadth"] = f"""
SELECT trade_date, count(*) AS total_stocks,
       sum({yes('close_price > ema_50')})::BIGINT AS above_ema_50,
       CASE WHEN count(*) >= 20 THEN sum({yes('close_price > ema_50')}) / count(*) > 0.5 END
         AS breadth_positive
FROM features GROUP BY 1"""


@register("breadth", "SELECT * FROM breadth")
def _(s: Stages):
    """A5."""
    return regime.breadth(s.features())


@register("regime_table", """
SELECT r.trade_date, r.market_status, r.regime_score, d.distribution_count, b.breadth_positive,
       f.follow_through_day, v.vix_risk_off
FROM regime r LEFT JOIN distribution d ON d.trade_date = r.trade_date
LEFT JOIN breadth b ON b.trade_date = r.trade_date
LEFT JOIN follow f ON f.trade_date = r.trade_date
LEFT JOIN vix_now v ON v.trade_date = r.trade_date""")
def _(s: Stages):
    """Regime rows with every breadth field."""
    return regime.regime_table(
        s.index_bars(), s.market_states(), s.features(), s.vol_index()
    ).select("trade_date", "market_status", "regime_score", "distribution_count",
             "breadth_positive", "follow_through_day", "vix_risk_off")


# ------------------------------------------------------------------ sectors
CTE["sec0"] = """
SELECT s.*, coalesce(u.sector, 'Unknown') AS sector, coalesce(u.company_name, s.symbol) AS company_name
FROM signals s LEFT JOIN universe u ON u.symbol || '.NS' = s.symbol"""
CTE["sec1"] = """
SELECT trade_date, sector, count(*) AS total_stocks, avg(composite_score) AS avg_composite_score,
       sum(trend_signal)::DOUBLE / count(*) * 100 AS trend_pct,
       sum(stage2_signal)::DOUBLE / count(*) * 100 AS stage2_pct,
       sum(rs_signal)::DOUBLE / count(*) * 100 AS rs_pct,
       sum(liquidity_signal)::DOUBLE / count(*) * 100 AS liquidity_pct
FROM sec0 GROUP BY 1, 2 HAVING count(*) >= 5"""
CTE["sec2"] = """
SELECT *, round_even(trend_pct * 0.30::DOUBLE + rs_pct * 0.35::DOUBLE + stage2_pct * 0.25::DOUBLE
                     + avg_composite_score * 0.10::DOUBLE, 2) AS momentum_score
FROM sec1"""
CTE["sec3"] = """
SELECT *, CAST(dense_rank() OVER (PARTITION BY trade_date ORDER BY momentum_score DESC) AS INTEGER) AS momentum_rank
FROM sec2"""
CTE["sec4"] = """
SELECT a.*, b.momentum_score AS prev_momentum_score,
       round_even(a.momentum_score - b.momentum_score, 2) AS momentum_delta
FROM sec3 a LEFT JOIN sec3 b ON b.sector = a.sector
  AND b.trade_date BETWEEN a.trade_date - 22 AND a.trade_date - 18
QUALIFY row_number() OVER (PARTITION BY a.trade_date, a.sector
  ORDER BY abs(b.trade_date - (a.trade_date - 20)) NULLS LAST, b.trade_date DESC) = 1"""
_S = dict(avg_composite_score=6, trend_pct=6, stage2_pct=6, rs_pct=6, liquidity_pct=6)


@register("sector_signals", rounded("sec1", **_S))
def _(s: Stages):
    """A3."""
    return places(sector.sector_signals(s.signals(), s.universe()), **_S)


@register("sector_momentum", rounded("sec4", **_S))
def _(s: Stages):
    """R7 and R8."""
    return places(sector.sector_momentum(s.signals(), s.universe()), **_S)


def _heat(where: str = "TRUE") -> str:
    return f"""
SELECT sector, count(*) AS total_stocks, sum(stage2_signal)::BIGINT AS stage2_count,
       sum(trend_signal)::BIGINT AS trend_count, sum(liquidity_signal)::BIGINT AS liquidity_count,
       sum(rs_signal)::BIGINT AS rs_count, round(avg(composite_score), 6) AS avg_composite_score,
       round(sum(stage2_signal)::DOUBLE / count(*) * 100, 6) AS stage2_pct,
       round(sum(rs_signal)::DOUBLE / count(*) * 100, 6) AS rs_pct,
       round(sum(liquidity_signal)::DOUBLE / count(*) * 100, 6) AS liquidity_pct,
       round(sum(trend_signal)::DOUBLE / count(*) * 100, 6) AS trend_pct
FROM sec0 WHERE trade_date = (SELECT d FROM screen_day) AND {where} GROUP BY 1"""


CTE["heat"] = _heat()
_MEMBER = """symbol IN (SELECT m.symbol || '.NS' FROM membership m
WHERE m.index_code = 'NIFTY500' AND m.is_current_member)"""
_H = dict(avg_composite_score=6, stage2_pct=6, rs_pct=6, liquidity_pct=6, trend_pct=6)


@register("sector_heatmap", "SELECT * FROM heat")
def _(s: Stages):
    """A4."""
    return places(sector.heatmap(s.signals(), s.universe(), s.screen_day()), **_H)


@register("sector_heatmap_index", _heat(_MEMBER))
def _(s: Stages):
    """A4 with J2."""
    return places(sector.heatmap(
        s.signals(), s.universe(), s.screen_day(), s.membership(), "NIFTY500"), **_H)


@register("sector_bounds", """
SELECT round(CASE WHEN hi - lo < 20 THEN greatest(0.0::DOUBLE, (lo + hi) / 2 - 10) ELSE lo END, 6) AS cmin,
       round(CASE WHEN hi - lo < 20 THEN least(100.0::DOUBLE, (lo + hi) / 2 + 10) ELSE hi END, 6) AS cmax
FROM (SELECT min(liquidity_pct) AS lo, max(liquidity_pct) AS hi FROM heat)""")
def _(s: Stages):
    """A18."""
    heat = sector.heatmap(s.signals(), s.universe(), s.screen_day())
    return places(sector.display_bounds(heat, "liquidity_pct"), cmin=6, cmax=6)


@register("sector_overview", """
SELECT sum(total_stocks)::BIGINT AS total_stocks, count(*) AS sectors,
       (SELECT sector FROM heat ORDER BY rs_pct DESC, sector LIMIT 1) AS top_sector,
       round(max(rs_pct), 6) AS top_value FROM heat""")
def _(s: Stages):
    """A20."""
    heat = sector.heatmap(s.signals(), s.universe(), s.screen_day())
    return places(sector.overview(heat, "rs_pct"), top_value=6)


@register("sector_drilldown", """
SELECT count(*) AS total_stocks, coalesce(sum(stage2_signal), 0)::BIGINT AS stage2_count,
       coalesce(sum(rs_signal), 0)::BIGINT AS rs_count,
       coalesce(sum(liquidity_signal), 0)::BIGINT AS liquidity_count
FROM sec0 WHERE trade_date = (SELECT d FROM screen_day) AND sector = 'ASIA'""")
def _(s: Stages):
    """A17."""
    from barquet.operators import serving

    return sector.drilldown(serving.sector_stocks(
        s.signals(), s.universe(), s.screen_day(), "ASIA", top_n=1_000_000))


# ------------------------------------------------------------------ quality
CTE["clean_dirty"] = """
SELECT DISTINCT * FROM dirty_bars
WHERE open_price > 0 AND high_price > 0 AND low_price > 0 AND close_price > 0 AND volume >= 0
  AND high_price >= low_price AND high_price >= open_price AND high_price >= close_price
  AND low_price <= open_price AND low_price <= close_price"""
CTE["marked"] = f"""
SELECT *, coalesce(volume = 0 AND {lag('volume')} = 0
  AND abs(close_price - {lag('close_price')}) < 0.01, FALSE) AS is_stale FROM clean_dirty"""


@register("stale_rows", "SELECT * EXCLUDE (is_stale) FROM marked WHERE is_stale")
def _(s: Stages):
    """Q1, detection."""
    return quality.stale_rows(cleaning.valid_candles(s.dirty_bars()))


@register("without_stale_rows", "SELECT * EXCLUDE (is_stale) FROM marked WHERE NOT is_stale")
def _(s: Stages):
    """Q1, removal."""
    return quality.without_stale_rows(cleaning.valid_candles(s.dirty_bars()))


def _gap_sql(src: str, col: str, day: str) -> str:
    return f"""
SELECT symbol, prev AS gap_start, d AS gap_end, CAST(d - prev AS INTEGER) AS gap_days
FROM (SELECT symbol, {col} AS d, lag({col}) OVER (PARTITION BY symbol ORDER BY {col}) AS prev
      FROM {src} WHERE {col} >= ({day}) - 60)
WHERE d - prev > 5"""


@register("date_gaps", _gap_sql("raw_bars", "src_date", "SELECT max(src_date) FROM raw_bars"))
def _(s: Stages):
    """Q2 on the sparse source dates."""
    raw = s.raw_bars()
    day = s._date("last_src", lambda: raw.agg(F.max("src_date")))
    return quality.date_gaps(raw, day, "src_date")


CTE["lots"] = """
SELECT DISTINCT 'S' || l_suppkey || l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem
UNION ALL
SELECT DISTINCT 'S' || l_suppkey || 'L' || l_linenumber, CAST(l_shipdate AS DATE) FROM lineitem"""
CTE["thin"] = """
SELECT symbol, count(*) AS days_count, min(trade_date) AS earliest_date,
       CASE WHEN count(*) < 63 THEN 'CRITICAL' WHEN count(*) < 200 THEN 'WARNING' ELSE 'CAUTION' END AS severity
FROM lots GROUP BY 1 HAVING count(*) < 252"""


def _lots(s: Stages) -> DataFrame:
    """Thinner series: one per supplier and return flag, one per supplier and line."""
    line = s.table("lineitem")
    day = F.to_date("l_shipdate").alias("trade_date")
    name = lambda *p: F.concat(F.lit("S"), C("l_suppkey").cast("string"), *p).alias("symbol")
    return (
        line.select(name(C("l_returnflag")), day).distinct()
        .unionByName(
            line.select(name(F.lit("L"), C("l_linenumber").cast("string")), day).distinct()
        )
    )


@register("thin_history", "SELECT * FROM thin")
def _(s: Stages):
    """A6."""
    return quality.thin_history(_lots(s))


# The log run sees the sparse source dates, so that it finds gaps as well.
CTE["sparse"] = """
SELECT r.symbol, r.src_date AS trade_date, d.open_price, d.high_price, d.low_price, d.close_price, d.volume
FROM dirty_once d JOIN raw_bars r ON r.symbol = d.symbol AND r.trade_date = d.trade_date
WHERE d.close_price IS NOT NULL"""
CTE["sparse_day"] = "SELECT max(trade_date) AS d FROM sparse"
CTE["sparse_marked"] = f"""
SELECT *, coalesce(volume = 0 AND {lag('volume')} = 0
  AND abs(close_price - {lag('close_price')}) < 0.01, FALSE) AS is_stale FROM sparse"""
CTE["kept"] = "SELECT * FROM sparse_marked WHERE NOT is_stale"
CTE["qlog"] = f"""
SELECT (SELECT d FROM sparse_day) AS run_date, 'stale_delete' AS check_type, symbol,
       format('{{}} stale rows deleted | {{}} → {{}} | price={{:.2f}}', count(*),
              CAST(min(trade_date) AS VARCHAR), CAST(max(trade_date) AS VARCHAR),
              arg_min(close_price, trade_date)) AS description, count(*) AS rows_affected
FROM sparse_marked WHERE is_stale GROUP BY symbol
UNION ALL
SELECT (SELECT d FROM sparse_day), 'gap_detected', symbol,
       format('{{}} calendar days missing | {{}} → {{}}', gap_days, CAST(gap_start AS VARCHAR), CAST(gap_end AS VARCHAR)), 0
FROM ({_gap_sql("kept", "trade_date", "SELECT d FROM sparse_day")})
UNION ALL
SELECT (SELECT d FROM sparse_day), 'thin_history', symbol,
       format('{{}} | {{}} days | from {{}}',
              CASE WHEN count(*) < 63 THEN 'CRITICAL' WHEN count(*) < 200 THEN 'WARNING' ELSE 'CAUTION' END,
              count(*), CAST(min(trade_date) AS VARCHAR)), 0
FROM kept GROUP BY symbol HAVING count(*) < 252"""


def _qlog(s: Stages) -> tuple[DataFrame, date]:
    raw = s.raw_bars()
    dates = raw.select("symbol", "trade_date", "src_date")
    sparse = (
        s.dirty_bars().distinct().dropna(subset=["close_price"])
        .join(dates, ["symbol", "trade_date"])
        .drop("trade_date").withColumnRenamed("src_date", "trade_date")
    )
    day = s._date("last_src", lambda: raw.agg(F.max("src_date")))
    return quality.quality_log(sparse, day), day


@register("quality_log", "SELECT * FROM qlog")
def _(s: Stages):
    """Q3."""
    return _qlog(s)[0]


@register("quality_summary", """
SELECT check_type, count(*) AS issues, sum(rows_affected)::BIGINT AS rows_affected
FROM qlog GROUP BY 1""")
def _(s: Stages):
    """A7, one run."""
    return quality.log_summary(*_qlog(s))


@register("quality_report", """
SELECT run_date, check_type, count(*) AS issues, sum(rows_affected)::BIGINT AS rows_deleted
FROM qlog GROUP BY 1, 2""")
def _(s: Stages):
    """A7, week report."""
    return quality.log_report(*_qlog(s))


@register("quality_report_symbols", """
SELECT run_date, check_type, symbol, count(*) AS issues FROM qlog GROUP BY 1, 2, 3""")
def _(s: Stages):
    """A7, every symbol of the week report."""
    return quality.log_symbols(*_qlog(s))


# ------------------------------------------------------------------ universe
def _tickers(s: Stages) -> DataFrame:
    """Suppliers and parts as tickers; only suppliers have prices."""
    parts = s.table("part").select(
        F.concat(F.lit("S"), C("p_partkey").cast("string"), F.lit(".NS")).alias("symbol")
    )
    return parts.unionByName(
        s.universe().select(with_suffix(C("symbol")).alias("symbol"))
    ).distinct()


CTE["tickers"] = """
SELECT 'S' || p_partkey || '.NS' AS symbol FROM part UNION SELECT symbol || '.NS' FROM universe"""


@register("new_symbols", "SELECT symbol FROM tickers WHERE symbol NOT IN (SELECT symbol FROM bars)")
def _(s: Stages):
    """J15 and U2."""
    return universe.new_symbols(_tickers(s), s.bars())


@register("first_missing_session", """
SELECT t.symbol, min(c.trade_date) AS first_missing
FROM (SELECT DISTINCT symbol FROM bars) t
CROSS JOIN (SELECT DISTINCT trade_date FROM regime ORDER BY trade_date DESC LIMIT 20) c
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = t.symbol AND b.trade_date = c.trade_date)
GROUP BY 1""")
def _(s: Stages):
    """J16."""
    have = s.bars().select("symbol").distinct()
    return universe.first_missing_session(
        have, s.bars(), regime.trading_calendar(s.regime(), 20)
    )


@register("active_symbols", "SELECT symbol || '.NS' AS symbol FROM universe WHERE is_active")
def _(s: Stages):
    """F10."""
    return universe_symbols(s.universe(), s.bars())


@register("active_symbols_fallback", "SELECT DISTINCT symbol FROM bars")
def _(s: Stages):
    """F10 when no symbol is active."""
    idle = s.universe().withColumn("is_active", F.lit(False))
    return universe_symbols(idle, s.bars())


@register("stale_fundamentals", """
SELECT u.symbol FROM universe u WHERE u.is_active AND NOT EXISTS (
  SELECT 1 FROM fundamentals f WHERE f.symbol = u.symbol
    AND f.trade_date >= (SELECT d FROM last_day) - 30)""")
def _(s: Stages):
    """J17."""
    return universe.stale_fundamentals(s.universe(), s.fundamentals(), s.last_day())


@register("stale_earnings", """
SELECT t.symbol, e.last_fetch FROM (SELECT symbol || '.NS' AS symbol FROM universe) t
LEFT JOIN (SELECT symbol, max(fetched_at) AS last_fetch FROM earnings GROUP BY 1) e ON e.symbol = t.symbol
WHERE e.last_fetch IS NULL OR (SELECT d FROM last_day) - e.last_fetch > 7""")
def _(s: Stages):
    """J18."""
    tickers = s.universe().select(with_suffix(C("symbol")).alias("symbol"))
    return universe.stale_earnings(tickers, s.earnings(), s.last_day())


@register("populated_indices", """
SELECT index_code, index_name FROM index_ref WHERE is_active AND index_code IN (
  SELECT m.index_code FROM membership m WHERE m.is_current_member)""")
def _(s: Stages):
    """J19."""
    return universe.populated_indices(s.index_reference(), s.membership())


CTE["listing_a"] = "SELECT symbol, company_name, sector, isin FROM universe"
CTE["listing_b"] = """
SELECT 'S' || p_partkey AS symbol, p_name AS company_name, p_brand AS sector, NULL AS isin FROM part"""
CTE["merged"] = """
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.company_name, b.company_name) AS company_name,
       coalesce(a.sector, b.sector) AS sector, coalesce(a.isin, b.isin) AS isin
FROM listing_a a FULL JOIN listing_b b ON a.symbol = b.symbol"""


def _merged(s: Stages) -> DataFrame:
    second = s.table("part").select(
        F.concat(F.lit("S"), C("p_partkey").cast("string")).alias("symbol"),
        C("p_name").alias("company_name"), C("p_brand").alias("sector"),
        F.lit(None).cast("string").alias("isin"),
    )
    first = s.universe().select("symbol", "company_name", "sector", "isin")
    return universe.merge_listings([first, second])


@register("merge_listings", "SELECT * FROM merged")
def _(s: Stages):
    """J22 and U1, merging."""
    return _merged(s)


@register("sync_universe", """
SELECT coalesce(o.symbol, m.symbol) AS symbol,
       CASE WHEN m.symbol IS NOT NULL THEN m.company_name ELSE o.company_name END AS company_name,
       CASE WHEN m.symbol IS NOT NULL THEN m.sector ELSE o.sector END AS sector,
       CASE WHEN m.symbol IS NOT NULL THEN m.isin ELSE o.isin END AS isin,
       CASE WHEN m.symbol IS NOT NULL THEN TRUE ELSE o.is_active END AS is_active,
       CASE WHEN o.symbol IS NOT NULL THEN o.first_seen ELSE (SELECT d FROM last_day) END AS first_seen,
       CASE WHEN m.symbol IS NOT NULL THEN (SELECT d FROM last_day) ELSE o.last_seen END AS last_seen
FROM (SELECT * REPLACE (CASE WHEN first_seen > DATE '2020-01-20' THEN 'X' || symbol ELSE symbol END AS symbol)
      FROM universe) o
FULL JOIN merged m ON m.symbol = o.symbol""")
def _(s: Stages):
    """J22, insert or update; some stored symbols are no longer listed."""
    gone = C("first_seen") > F.lit("2020-01-20").cast("date")
    stored = s.universe().withColumn(
        "symbol", F.when(gone, F.concat(F.lit("X"), "symbol")).otherwise(C("symbol"))
    )
    return universe.sync_universe(stored, _merged(s), s.last_day())


CTE["downloaded"] = """
SELECT 'S' || s_suppkey AS symbol,
       CASE WHEN s_acctbal < 5000 THEN 'NIFTY50' ELSE 'SMALLCAP250' END AS index_code FROM supplier"""


@register("sync_membership", """
SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.index_code, n.index_code) AS index_code,
       CASE WHEN n.symbol IS NOT NULL THEN TRUE
            WHEN o.index_code IN ('NIFTY50', 'SMALLCAP250') THEN FALSE ELSE o.is_current_member END AS is_current_member,
       CASE WHEN o.symbol IS NOT NULL THEN o.first_added_date ELSE (SELECT d FROM last_day) END AS first_added_date,
       CASE WHEN n.symbol IS NOT NULL THEN NULL
            WHEN o.index_code IN ('NIFTY50', 'SMALLCAP250') THEN (SELECT d FROM last_day)
            ELSE o.last_removed_date END AS last_removed_date
FROM membership o FULL JOIN downloaded n ON n.symbol = o.symbol AND n.index_code = o.index_code""")
def _(s: Stages):
    """J23."""
    fresh = s.table("supplier").select(
        F.concat(F.lit("S"), C("s_suppkey").cast("string")).alias("symbol"),
        F.when(C("s_acctbal") < 5000, "NIFTY50").otherwise("SMALLCAP250").alias("index_code"),
    )
    return universe.sync_membership(s.membership(), fresh, s.last_day())


# ------------------------------------------------------------------ fundamentals
@register("clean_numbers", """
SELECT symbol, section, label, period, raw_value, value FROM facts_n""")
def _(s: Stages):
    """F13."""
    return fundamentals.parse_facts(s.facts())


@register("fundamental_lines", """
SELECT symbol, len(sales) AS n_sales, len(profit) AS n_profit, len(eps_q) AS n_eps,
       sales[-1] AS last_sales, eps_q[1] AS first_eps FROM fund0""")
def _(s: Stages):
    """Short histories, oldest first."""
    rows = fundamentals.pivot_facts(s.facts())
    return rows.select(
        "symbol", F.size("sales").cast("bigint").alias("n_sales"),
        F.size("profit").cast("bigint").alias("n_profit"),
        F.size("quarterly_eps").cast("bigint").alias("n_eps"),
        F.try_element_at("sales", F.lit(-1)).alias("last_sales"),
        F.try_element_at("quarterly_eps", F.lit(1)).alias("first_eps"),
    )


@register("fundamentals", "SELECT * FROM fund2")
def _(s: Stages):
    """X1, X3, X4, X5."""
    return fundamentals.fundamentals(s.facts())


@register("latest_fundamentals", "SELECT * FROM latest_fund")
def _(s: Stages):
    """T4."""
    return fundamentals.latest_fundamentals(s.fundamentals())


_ = (DEFAULTS, chg)
