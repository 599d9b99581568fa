"""Screen and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.config import PRESETS, SCREEN_FIELDS, VALUE_WORDS
from barquet.functions.scalars import age_band, bare_symbol, score_bucket, symbol_of_label
from barquet.operators import screen, serving
from barquet.operators.fundamentals import latest_fundamentals
from barquet.functions.scalars import with_suffix
from barquet.plans.screening import run_screen
from verification.registry import register
from verification.sql_stages import CTE, yes
from verification.stages import Stages

C = F.col
SIDE_INTS = ("pa_signal", "pa_daily_trend", "pa_weekly_trend", "mtf_weekly_trend",
             "mtf_monthly_trend", "mtf_score")
_OWN = ", ".join(f"s.{c}" for c in serving.SCANNER_SIGNALS if c != "composite_rank")


def _scanner_sql(extra: str = "TRUE") -> str:
    return f"""
SELECT {_OWN}, round(s.composite_rank, 4) AS composite_rank,
       coalesce(u.company_name, s.symbol) AS company_name, coalesce(u.sector, 'Unknown') AS sector,
       f.quality_score AS fund_quality_score, f.promoter_holding AS fund_promoter_pct,
       f.roe AS fund_roe, f.roce AS fund_roce,
       coalesce(p.pa_signal, 0) AS pa_signal, coalesce(p.pa_hh_daily, 0) AS pa_daily_trend,
       coalesce(p.pa_hh_weekly, 0) AS pa_weekly_trend, coalesce(p.pa_score, 0.0) AS pa_score,
       coalesce(t.mtf_weekly_trend, 0) AS mtf_weekly_trend,
       coalesce(t.mtf_monthly_trend, 0) AS mtf_monthly_trend, coalesce(t.mtf_score, 0) AS mtf_score,
       NULL::DOUBLE AS ml_win_prob, 0 AS ml_signal
FROM signals s LEFT JOIN universe u ON u.symbol || '.NS' = s.symbol
LEFT JOIN latest_fund f ON f.symbol || '.NS' = s.symbol
LEFT JOIN price_action p ON p.symbol = s.symbol AND p.trade_date = s.trade_date
LEFT JOIN timeframes t ON t.symbol = s.symbol AND t.trade_date = s.trade_date
WHERE s.trade_date = (SELECT d FROM screen_day) AND {extra}"""


CTE["scan"] = _scanner_sql()


def _show(df: DataFrame) -> DataFrame:
    return df.withColumn("composite_rank", F.round("composite_rank", 4))


@register("scanner", "SELECT * FROM scan")
def _(s: Stages):
    """J1 and T1, all rows of a date."""
    return _show(s.scanner())


@register("scanner_index", _scanner_sql("""s.composite_score >= 20 AND s.symbol IN (
  SELECT m.symbol || '.NS' FROM membership m WHERE m.index_code = 'NIFTY50' AND m.is_current_member)"""))
def _(s: Stages):
    """J2."""
    return _show(serving.scanner(
        s.signals(), s.screen_day(), s.universe(), s.fundamentals(), s.price_action(),
        s.timeframes(), membership=s.membership(), index_code="NIFTY50", min_score=20.0,
    ))


@register("scanner_top", """
SELECT symbol, ev_score, composite_score FROM scan
ORDER BY ev_score DESC NULLS LAST, composite_score DESC, symbol LIMIT 25""")
def _(s: Stages):
    """The top of the report."""
    return serving.scanner(
        s.signals(), s.screen_day(), s.universe(), s.fundamentals(), s.price_action(),
        s.timeframes(), fetch_n=25,
    ).select("symbol", "ev_score", "composite_score")


# ------------------------------------------------------------------ presets
def _points(weights: dict[str, int]) -> str:
    used = {k: w for k, w in weights.items() if w > 0}
    return f"({' + '.join(f'{k} * {w}' for k, w in used.items())}) / {sum(used.values())}.0::DOUBLE * 100"


def _preset_sql(name: str, weights: dict[str, int]) -> str:
    label = name.replace("'", "''")
    if name == next(iter(PRESETS)):
        score, rank, ic = "composite_score", "composite_rank", "institutional_candidate"
    else:
        score = f"round_even({_points(weights)}, 1)"
        rank = f"(dense_rank() OVER (ORDER BY {score} DESC))::DOUBLE"
        ic = yes(f"{score} >= 70")
    return f"""
(SELECT '{label}' AS preset, symbol, {score} AS score, {rank} AS rank, {ic} AS candidate, ev_score
 FROM scan ORDER BY ev_score DESC NULLS LAST, score DESC, symbol LIMIT 100)"""


@register("preset_ranking", " UNION ALL ".join(_preset_sql(n, w) for n, w in PRESETS.items()))
def _(s: Stages):
    """The top 100 under every preset, in one job."""
    return screen.ranked_by_each(s.scanner()).withColumn("rank", F.round("rank", 4)).drop("position")


@register("preset_table_ranking", " UNION ALL ".join(_preset_sql(n, w) for n, w in PRESETS.items()))
def _(s: Stages):
    """The same with the weights of the stored preset table."""
    presets, default = serving.load_presets(serving.preset_table(s.spark))
    presets = {default: presets[default]} | presets
    ranked = screen.ranked_by_each(s.scanner(), presets=presets)
    return ranked.withColumn("rank", F.round("rank", 4)).drop("position")


_ONE = "Trending Leaders"


@register("preset_reranking", _preset_sql(_ONE, PRESETS[_ONE]))
def _(s: Stages):
    """T2 under one preset."""
    return screen.ranked(s.scanner(), _ONE).select(
        F.lit(_ONE).alias("preset"), "symbol", C("composite_score").alias("score"),
        C("composite_rank").cast("double").alias("rank"),
        C("institutional_candidate").alias("candidate"), "ev_score",
    )


# ------------------------------------------------------------------ conditions
def _test_sql(t: screen.Test) -> str:
    word = t.value.lower() if isinstance(t.value, str) else t.value
    value = VALUE_WORDS.get(word, t.value) if isinstance(word, str) else t.value
    return f"coalesce({SCREEN_FIELDS[t.field]} {t.op} {value}, FALSE)"


def _screen_sql(named: screen.NamedScreen) -> str:
    text = "TRUE"
    for cond in named.conditions:
        tests = cond.tests if isinstance(cond, screen.AnyOf) else (cond,)
        row = " OR ".join(_test_sql(t) for t in tests)
        text = f"({text} {'OR' if cond.logic == 'OR' else 'AND'} ({row}))"
    return text


NAMED = {**screen.QUICK_SCREENS, **screen.SAMPLE_SCREENS}
CTE["wide"] = """
SELECT s.*, f.quality_score AS fund_quality_score, f.promoter_holding AS fund_promoter_pct,
       f.roe AS fund_roe, f.roce AS fund_roce, t.mtf_score
FROM signals s LEFT JOIN latest_fund f ON f.symbol || '.NS' = s.symbol
LEFT JOIN timeframes t ON t.symbol = s.symbol AND t.trade_date = s.trade_date"""


def _wide(s: Stages) -> DataFrame:
    funds = latest_fundamentals(s.fundamentals()).select(
        with_suffix(C("symbol")).alias("symbol"),
        *[C(c).alias(n) for c, n in serving.FUND.items()],
    )
    frames = s.timeframes().select("symbol", "trade_date", "mtf_score")
    return s.signals().join(funds, "symbol", "left").join(
        frames, ["symbol", "trade_date"], "left"
    )


@register("named_screens", " UNION ALL ".join(
    f"SELECT '{n}' AS screen, count(*) AS hits, count(DISTINCT symbol) AS symbols, "
    f"max(trade_date) AS last_hit FROM wide WHERE {_screen_sql(x)}" for n, x in NAMED.items()))
def _(s: Stages):
    """hits of every named screen over the whole history, in one pass."""
    wide = _wide(s)
    hits = F.filter(
        F.array(*[
            F.when(screen.screen_condition(x.conditions, wide.columns), F.lit(n))
            for n, x in NAMED.items()
        ]),
        lambda v: v.isNotNull(),
    )
    found = wide.select("symbol", "trade_date", F.explode(hits).alias("screen"))
    counted = found.groupBy("screen").agg(
        F.count("*").alias("hits"), F.countDistinct("symbol").alias("symbols"),
        F.max("trade_date").alias("last_hit"),
    )
    names = s.spark.createDataFrame([(n,) for n in NAMED], "screen string")
    return names.join(counted, "screen", "left").select(
        "screen", F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("symbols", F.lit(0)).alias("symbols"), "last_hit",
    )


_FOLD = (screen.Test("VCP", "=", 1), screen.Test("Breakout", "=", "tick", "OR"),
         screen.Test("Fund Score", ">=", 3), screen.Test("Dist Pivot%", ">", 0))


@register("screen_left_fold", """
SELECT symbol, trade_date, distance_from_pivot_pct FROM signals
WHERE (vcp_signal = 1 OR breakout_signal = 1) AND coalesce(distance_from_pivot_pct > 0, FALSE)""")
def _(s: Stages):
    """A OR B AND C reads (A OR B) AND C; a known field whose column is absent holds."""
    return screen.screen(s.signals(), _FOLD).select(
        "symbol", "trade_date", "distance_from_pivot_pct"
    )


def _numbered(df: DataFrame, *keys) -> DataFrame:
    """Position in a report of bounded length."""
    return df.withColumn(
        "position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys))
    )


CTE["top100"] = """
SELECT * FROM scan ORDER BY ev_score DESC NULLS LAST, composite_score DESC, symbol LIMIT 100"""


@register("two_tier_sort", """
SELECT symbol, tier, CASE WHEN tier = 1 THEN ev_score END AS ev_score, composite_score,
       CAST(row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN ev_score END DESC NULLS LAST,
         composite_score DESC NULLS LAST, ev_score DESC NULLS LAST, symbol) AS INTEGER) AS position
FROM (SELECT *, CASE WHEN composite_score >= 50 THEN 1 ELSE 2 END AS tier FROM top100
      WHERE liquidity_signal = 1)""")
def _(s: Stages):
    """T3 after T1, with the order made visible (at most 100 rows by then)."""
    top = screen.ranked(s.scanner())
    sorted_ = screen.two_tier_sort(
        screen.screen(top, (screen.Test("Liquid", "=", "yes"),)), "Score"
    )
    raw = top.select("symbol", C("ev_score").alias("__ev"))
    return _numbered(
        sorted_.join(raw, "symbol"), "tier", C("ev_score").desc_nulls_last(),
        C("composite_score").desc_nulls_last(), C("__ev").desc_nulls_last(), "symbol",
    ).select("symbol", "tier", "ev_score", "composite_score", "position")


_HEALTH = """CASE WHEN trend_signal = 1 AND mtf_score = 2 AND rs_new_high = 1 AND rs_signal = 1 THEN 'ROCKET'
 WHEN trend_signal = 1 AND mtf_score = 2 AND rs_signal = 1 THEN 'STRONG'
 WHEN trend_signal = 1 AND mtf_score >= 1 THEN 'TREND' WHEN trend_signal = 1 THEN 'COOL' ELSE 'EXIT' END"""
_EXIT = """CASE WHEN pivot_price IS NOT NULL AND trailing_stop_price IS NOT NULL
 THEN round_even(greatest(pivot_price, trailing_stop_price), 2) END"""


@register("trend_health", f"""
SELECT symbol, trade_date, {_HEALTH} AS trend_health, {_EXIT} AS safe_exit_price FROM wide""")
def _(s: Stages):
    """G24 and G25."""
    return _wide(s).transform(screen.trend_health).transform(screen.safe_exit).select(
        "symbol", "trade_date", "trend_health", "safe_exit_price"
    )


@register("run_screen", f"""
SELECT symbol, {_HEALTH} AS trend_health, {_EXIT} AS safe_exit_price
FROM (SELECT * FROM scan ORDER BY ev_score DESC NULLS LAST, composite_score DESC, symbol LIMIT 100)
WHERE trend_signal = 1 AND stage2_signal = 1 AND rs_signal = 1 AND liquidity_signal = 1""")
def _(s: Stages):
    """The whole screen: rank, cut, label, filter, sort."""
    return run_screen(s.scanner(), screen.QUICK_SCREENS["RS Leaders"]).select(
        "symbol", "trend_health", "safe_exit_price"
    )


@register("screen_totals", """
SELECT count(*) AS rows_shown, sum(institutional_candidate)::BIGINT AS institutional_candidate,
       sum(vcp_signal)::BIGINT AS vcp_signal, sum(breakout_signal)::BIGINT AS breakout_signal,
       sum(breakout_ready_signal)::BIGINT AS breakout_ready_signal FROM scan""")
def _(s: Stages):
    """A14."""
    return screen.screen_totals(s.scanner())


@register("all_signals_off", """
SELECT trade_date, sum(trend_signal + stage2_signal + vcp_signal + breakout_signal)::BIGINT AS active_signals,
       sum(trend_signal + stage2_signal + vcp_signal + breakout_signal) = 0 AS all_off
FROM signals GROUP BY 1""")
def _(s: Stages):
    """A15."""
    return screen.all_signals_off(s.signals())


# ------------------------------------------------------------------ pickers
@register("date_range", "SELECT min(trade_date) AS min_date, max(trade_date) AS max_date FROM signals")
def _(s: Stages):
    """A13."""
    return serving.date_range(s.signals())


@register("trade_dates", "SELECT DISTINCT trade_date FROM signals")
def _(s: Stages):
    """A13."""
    return serving.trade_dates(s.signals())


@register("recent_dates", "SELECT DISTINCT trade_date FROM signals ORDER BY 1 DESC LIMIT 60")
def _(s: Stages):
    """A13."""
    return serving.trade_dates(s.signals(), 60)


@register("nearest_date", """
SELECT max(trade_date) AS trade_date FROM signals WHERE trade_date <= DATE '2021-05-09'""")
def _(s: Stages):
    """A Sunday snaps to the Friday before."""
    import datetime

    return serving.nearest_date(s.signals(), datetime.date(2021, 5, 9))


@register("latest_price_date", "SELECT max(trade_date) AS trade_date FROM bars WHERE symbol = 'S7.NS'")
def _(s: Stages):
    """A13."""
    return serving.latest_price_date(s.bars(), "S7.NS")


@register("symbols", "SELECT DISTINCT symbol FROM signals")
def _(s: Stages):
    """A13."""
    return serving.symbols(s.signals())


@register("symbol_options", """
SELECT DISTINCT s.symbol, coalesce(u.company_name, s.symbol) AS company_name,
       coalesce(u.company_name, s.symbol) || '  (' || s.symbol || ')' AS label, s.symbol AS back
FROM signals s LEFT JOIN universe u ON u.symbol || '.NS' = s.symbol""")
def _(s: Stages):
    """T10 and the way back from a label."""
    return serving.symbol_options(s.signals(), s.universe()).withColumn(
        "back", symbol_of_label(C("label"))
    )


@register("symbol_options_on_date", """
SELECT s.symbol, coalesce(u.company_name, s.symbol) AS company_name,
       coalesce(u.company_name, s.symbol) || '  (' || s.symbol || ')' AS label
FROM signals s LEFT JOIN universe u ON u.symbol || '.NS' = s.symbol
WHERE s.trade_date = (SELECT d FROM screen_day)""")
def _(s: Stages):
    """T10 for one date."""
    return serving.symbol_options(s.signals(), s.universe(), s.screen_day())


@register("symbol_forms", """
SELECT symbol, regexp_replace(symbol, '\\.NS$', '') AS bare, symbol AS suffixed,
       regexp_replace(symbol, '\\.NS$', '') || '.NS' AS readded, count(*) AS bars FROM bars GROUP BY 1""")
def _(s: Stages):
    """F9."""
    return s.bars().groupBy("symbol").agg(F.count("*").alias("bars")).select(
        "symbol", bare_symbol(C("symbol")).alias("bare"),
        with_suffix(C("symbol")).alias("suffixed"),
        with_suffix(bare_symbol(C("symbol"))).alias("readded"), "bars",
    )


# ------------------------------------------------------------------ environment
_ENV = "trade_date, market_state, regime_score, exposure_level, allow_breakouts, cash_mode"


@register("latest_environment", f"SELECT {_ENV} FROM environment ORDER BY trade_date DESC LIMIT 1")
def _(s: Stages):
    """T5."""
    return serving.latest_environment(s.environment())


@register("environment_on_date", """
SELECT market_state, regime_score, allow_breakouts, cash_mode FROM environment
WHERE trade_date = (SELECT d FROM screen_day)""")
def _(s: Stages):
    """T5 for one date."""
    from barquet.operators.regime import environment_on

    return environment_on(s.environment(), s.screen_day())


CTE["active_before"] = """
SELECT max(trade_date) AS trade_date FROM environment
WHERE NOT cash_mode AND trade_date < (SELECT d FROM screen_day)"""


@register("last_active_date", """
SELECT max(trade_date) AS trade_date FROM environment WHERE NOT cash_mode""")
def _(s: Stages):
    """T7."""
    return serving.last_active_date(s.environment())


@register("last_active_before", "SELECT * FROM active_before")
def _(s: Stages):
    """T7 before a date."""
    return serving.last_active_date(s.environment(), s.screen_day())


@register("recent_regimes", """
SELECT trade_date, market_state, regime_score, exposure_level FROM environment
ORDER BY trade_date DESC LIMIT 60""")
def _(s: Stages):
    """T8."""
    return serving.regime_history(s.environment())


# ------------------------------------------------------------------ stocks
_DETAIL = ", ".join(
    f"round(f.{c}, 4) AS {c}" if c.startswith(("ema", "atr", "vol")) else f"f.{c}"
    for c in serving.DETAIL_FEATURES
)


@register("stock_detail", f"""
SELECT {_DETAIL}, {', '.join('s.' + c for c in serving.DETAIL_SIGNALS)},
       coalesce(t.mtf_weekly_trend, 0) AS mtf_weekly_trend,
       coalesce(t.mtf_monthly_trend, 0) AS mtf_monthly_trend, coalesce(t.mtf_score, 0) AS mtf_score
FROM features f LEFT JOIN signals s ON s.symbol = f.symbol AND s.trade_date = f.trade_date
LEFT JOIN timeframes t ON t.symbol = f.symbol AND t.trade_date = f.trade_date
WHERE f.symbol = 'S3.NS' ORDER BY f.trade_date DESC LIMIT 252""")
def _(s: Stages):
    """J21."""
    df = serving.stock_detail(s.features(), s.signals(), s.timeframes(), "S3.NS")
    return df.withColumns({
        c: F.round(c, 4) for c in serving.DETAIL_FEATURES if c.startswith(("ema", "atr", "vol"))
    })


@register("sector_stocks", """
SELECT s.symbol, coalesce(u.company_name, s.symbol) AS company_name, coalesce(u.sector, 'Unknown') AS sector,
       s.composite_score, s.institutional_candidate, s.trend_signal, s.stage2_signal, s.vcp_signal,
       s.breakout_signal, s.breakout_ready_signal, s.liquidity_signal, s.quality_signal, s.rs_signal,
       s.distance_from_pivot_pct, s.distance_from_52w_high_pct
FROM signals s LEFT JOIN universe u ON u.symbol || '.NS' = s.symbol
WHERE s.trade_date = (SELECT d FROM screen_day) AND coalesce(u.sector, 'Unknown') = 'EUROPE'
ORDER BY s.composite_score DESC, s.symbol LIMIT 10""")
def _(s: Stages):
    """T9."""
    return serving.sector_stocks(s.signals(), s.universe(), s.screen_day(), "EUROPE", top_n=10)


@register("stock_fundamentals", """
SELECT * FROM fundamentals WHERE symbol = 'S5' ORDER BY trade_date DESC LIMIT 1""")
def _(s: Stages):
    """T4 for one symbol."""
    return serving.stock_fundamentals(s.fundamentals(), "S5")


@register("symbol_history", "SELECT * FROM bars WHERE symbol = 'S11.NS'")
def _(s: Stages):
    """S4."""
    from barquet.sources.scans import symbol_history

    return symbol_history(s.bars(), "S11.NS")


# ------------------------------------------------------------------ watchlist
CTE["watch"] = f"""
SELECT s.symbol, coalesce(u.company_name, s.symbol) AS company_name, coalesce(u.sector, 'Unknown') AS sector,
       s.composite_score, s.stage2_days, s.pivot_price, s.distance_from_pivot_pct AS dist_pivot_signal_day,
       s.target_1_price, s.target_2_price, s.ev_score, f.close_price AS current_close,
       round(f.ema_50, 4) AS current_ema50,
       {yes('f.close_price >= s.pivot_price * (1.0::DOUBLE - 0.07::DOUBLE) AND f.close_price >= f.ema_50')} AS is_holding,
       round((f.close_price - s.pivot_price) / nullif(s.pivot_price, 0) * 100, 1) AS current_dist_pivot_pct
FROM signals s JOIN features f ON f.symbol = s.symbol AND f.trade_date = (SELECT d FROM screen_day)
LEFT JOIN universe u ON u.symbol || '.NS' = s.symbol
WHERE s.trade_date = (SELECT trade_date FROM active_before) AND s.stage2_signal = 1 AND s.trend_signal = 1
  AND s.rs_signal = 1 AND s.liquidity_signal = 1 AND s.quality_signal = 1 AND s.composite_score >= 70"""


def _watch(s: Stages) -> DataFrame:
    day = serving.last_active_date(s.environment(), s.screen_day()).first().trade_date
    return serving.watchlist(s.signals(), s.features(), s.universe(), day, s.screen_day())


@register("watchlist", "SELECT * FROM watch")
def _(s: Stages):
    """J20."""
    return _watch(s).withColumn("current_ema50", F.round("current_ema50", 4))


@register("watchlist_counts", "SELECT is_holding, count(*) AS stocks FROM watch GROUP BY 1")
def _(s: Stages):
    """A19."""
    return serving.watchlist_counts(_watch(s))


# ------------------------------------------------------------------ bands
@register("stage_age_bands", """
SELECT CASE WHEN stage2_days <= 0 THEN NULL WHEN stage2_days <= 20 THEN 'Early'
            WHEN stage2_days <= 60 THEN 'Mid' ELSE 'Advanced' END AS band,
       CASE WHEN composite_score >= 70 THEN 70 WHEN composite_score >= 50 THEN 50
            WHEN composite_score >= 30 THEN 30 ELSE 0 END AS bucket, count(*) AS rows
FROM signals GROUP BY 1, 2""")
def _(s: Stages):
    """X8 and X9."""
    return s.signals().groupBy(
        age_band(C("stage2_days")).alias("band"),
        score_bucket(C("composite_score")).alias("bucket"),
    ).agg(F.count("*").alias("rows"))
