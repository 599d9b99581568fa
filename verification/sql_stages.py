"""DuckDB text of the daily tables."""

from __future__ import annotations

import re

from barquet.config import PRESETS
from verification.sql_fixtures import CTE, values

W = "PARTITION BY symbol ORDER BY trade_date"


def roll(fn: str, col: str, n: int, need: int | None = None, shift: int = 0, w: str = W) -> str:
    """Rolling aggregate of n rows ending `shift` rows back, null until `need` values."""
    frame = f"({w} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)"
    need = n if need is None else need
    return f"CASE WHEN count({col}) OVER {frame} >= {need} THEN {fn}({col}) OVER {frame} END"


def lag(col: str, n: int = 1, w: str = W) -> str:
    return f"lag({col}, {n}) OVER ({w})"


def ema(col: str, span: int, pos: str = "pos", w: str = W) -> str:
    """Exponential average seeded with the first value; one that is within
    rounding error of the value is the value (a constant is its own average)."""
    beta = f"({span - 1}::DOUBLE / {span + 1})"
    gain = f"CASE WHEN {pos} = 0 THEN 1.0::DOUBLE ELSE 1 - {beta} END"
    e = (
        f"pow({beta}, {pos}) * sum({col} * {gain} * pow({beta}, -{pos})) "
        f"OVER ({w} ROWS UNBOUNDED PRECEDING)"
    )
    return f"CASE WHEN abs({e} - {col}) <= abs({col}) * 1e-12 THEN {col} ELSE {e} END"


def yes(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif({b}, 0))"


def chg(a: str, b: str) -> str:
    return div(f"{a} - {b}", b)


# ------------------------------------------------------------------ features
CTE["f0"] = f"""
SELECT b.*, row_number() OVER ({W}) - 1 AS pos,
       CASE WHEN e.e_symbol IS NOT NULL THEN 1 ELSE 0 END AS is_earnings_day
FROM bars b LEFT JOIN (SELECT DISTINCT symbol AS e_symbol, earnings_date FROM earnings) e
  ON e.e_symbol = b.symbol AND e.earnings_date = b.trade_date"""
CTE["f1"] = "SELECT *, " + ", ".join(
    f"{ema('close_price', s)} AS ema_{s}" for s in (10, 21, 50, 150, 200)
) + f""",
       {roll('avg', 'volume', 10)} AS avg_volume_10,
       {roll('avg', 'volume', 20)} AS avg_volume_20,
       {div('high_price - low_price', 'close_price')} * 100 AS daily_range_pct,
       greatest(high_price - low_price, abs(high_price - {lag('close_price')}),
                abs(low_price - {lag('close_price')})) AS tr,
       {roll('max', 'close_price', 252, 63)} AS high_52w,
       {roll('min', 'close_price', 252, 63)} AS low_52w
FROM f0"""
CTE["f2"] = f"""
SELECT *,
       {yes('ema_21 > ema_50')} + {yes('ema_50 > ema_150')} + {yes('ema_150 > ema_200')}
         + {yes('close_price > ema_21')} AS trend_score,
       coalesce({chg('ema_200', lag('ema_200', 20))} * 100, 0) AS slope,
       {div('volume', 'avg_volume_20')} AS relative_volume,
       {roll('avg', 'tr', 14, 1)} AS atr_14,
       {roll('stddev_samp', 'daily_range_pct', 10, 1)} AS volatility_10
FROM f1"""
CTE["features"] = f"""
SELECT *,
       CASE WHEN close_price > ema_200 AND close_price > ema_150 AND ema_50 > ema_150
                 AND ema_150 > ema_200 AND slope > 0 THEN 2
            WHEN close_price < ema_200 AND ema_50 < ema_150 AND ema_150 < ema_200
                 AND slope < -0.5 THEN 4
            WHEN close_price < ema_200 AND slope BETWEEN -0.5 AND 0.5 THEN 1
            ELSE 3 END AS weinstein_stage,
       {div('volatility_10', roll('avg', 'volatility_10', 10, 1))} AS volatility_contraction
FROM f2"""

# ------------------------------------------------------------------ price action
CTE["weeks0"] = """
SELECT symbol, CAST(trade_date + CAST((12 - dayofweek(trade_date)) % 7 AS INTEGER) AS DATE) AS week_end,
       arg_max(close_price, trade_date) AS close_price
FROM bars GROUP BY 1, 2"""
WK = "PARTITION BY symbol ORDER BY week_end"
CTE["pa_weeks1"] = f"""
SELECT *, {roll('max', 'close_price', 4, shift=1, w=WK)} AS top,
       {roll('min', 'close_price', 4, shift=1, w=WK)} AS low,
       count(*) OVER (PARTITION BY symbol) AS weeks
FROM weeks0"""
CTE["pa_weeks"] = f"""
SELECT symbol, week_end, {yes(f"weeks >= 9 AND top > {lag('top', 4, WK)}")} AS hh,
       {yes(f"weeks >= 9 AND low > {lag('low', 4, WK)}")} AS hl
FROM pa_weeks1"""
CTE["pa0"] = f"""
SELECT symbol, trade_date, close_price, high_price, low_price, ema_50, relative_volume,
       {roll('max', 'close_price', 20, shift=1)} AS top,
       {roll('min', 'close_price', 20, shift=1)} AS low,
       {chg('close_price', lag('close_price', 10))} * 100 AS pa_roc_10,
       {chg('close_price', lag('close_price', 20))} * 100 AS pa_roc_20
FROM features"""
CTE["pa1"] = f"""
SELECT *, {yes(f"top > {lag('top', 20)}")} AS pa_hh_daily,
       {yes(f"low > {lag('low', 20)}")} AS pa_hl_daily,
       CASE WHEN high_price <> low_price THEN
            least(greatest({div('close_price - low_price', 'high_price - low_price')}, 0), 1) END
         AS pa_close_position,
       {yes('relative_volume BETWEEN 1.1 AND 3.0')} AS pa_vol_quality,
       {yes('pa_roc_10 > pa_roc_20 AND pa_roc_20 > 0')} AS pa_momentum_accel,
       {yes(f"{chg('close_price', 'ema_50')} BETWEEN -0.05 AND 0.20")} AS pa_extension_ok
FROM pa0"""
CTE["pa2"] = """
SELECT d.*, coalesce(w.hh, 0) AS pa_hh_weekly, coalesce(w.hl, 0) AS pa_hl_weekly
FROM pa1 d ASOF LEFT JOIN pa_weeks w ON w.symbol = d.symbol AND w.week_end <= d.trade_date"""
CTE["pa3"] = f"""
SELECT *, {yes('pa_hh_daily = 1 AND pa_hl_daily = 1')} * 25.0::DOUBLE
        + {yes('pa_hh_weekly = 1 AND pa_hl_weekly = 1')} * 25
        + {yes('pa_close_position >= 0.6')} * 15 + pa_vol_quality * 15
        + pa_momentum_accel * 10 + pa_extension_ok * 10 AS pa_score
FROM pa2"""
CTE["price_action"] = f"""
SELECT *, {yes('pa_score >= 70 AND pa_hh_weekly = 1 AND pa_hl_weekly = 1')} AS pa_signal
FROM pa3"""

# ------------------------------------------------------------------ timeframes
CTE["months0"] = """
SELECT symbol, last_day(trade_date) AS month_end, arg_max(close_price, trade_date) AS close_price
FROM bars GROUP BY 1, 2"""
MO = "PARTITION BY symbol ORDER BY month_end"
for _src, _end, _w, _fast, _slow, _min, _name in (
    ("weeks0", "week_end", WK, 10, 30, 52, "mtf_weeks"),
    ("months0", "month_end", MO, 10, 21, 24, "mtf_months"),
):
    CTE[_name + "0"] = f"""
SELECT *, row_number() OVER ({_w}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS bars_n
FROM {_src}"""
    CTE[_name + "1"] = f"""
SELECT *, {ema('close_price', _fast, w=_w)} AS fast, {ema('close_price', _slow, w=_w)} AS slow
FROM {_name}0"""
    CTE[_name] = f"""
SELECT symbol, {_end}, CASE WHEN bars_n >= {_min} THEN {lag('fast', 1, _w)} END AS fast,
       CASE WHEN bars_n >= {_min} THEN {lag('slow', 1, _w)} END AS slow
FROM {_name}1"""
CTE["mtf0"] = """
SELECT d.symbol, d.trade_date, d.close_price, w.fast AS mtf_w_ema_fast, w.slow AS mtf_w_ema_slow
FROM bars d ASOF LEFT JOIN mtf_weeks w ON w.symbol = d.symbol AND w.week_end <= d.trade_date"""
CTE["mtf1"] = """
SELECT d.*, m.fast AS mtf_m_ema_fast, m.slow AS mtf_m_ema_slow
FROM mtf0 d ASOF LEFT JOIN mtf_months m ON m.symbol = d.symbol AND m.month_end <= d.trade_date"""
CTE["timeframes"] = f"""
SELECT *, {yes('close_price > mtf_w_ema_fast AND mtf_w_ema_fast > mtf_w_ema_slow')} AS mtf_weekly_trend,
       {yes('close_price > mtf_m_ema_fast AND mtf_m_ema_fast > mtf_m_ema_slow')} AS mtf_monthly_trend,
       {yes('close_price > mtf_w_ema_fast AND mtf_w_ema_fast > mtf_w_ema_slow')}
       + {yes('close_price > mtf_m_ema_fast AND mtf_m_ema_fast > mtf_m_ema_slow')} AS mtf_score
FROM mtf1"""

# ------------------------------------------------------------------ fundamentals
CTE["facts_n"] = r"""
SELECT *, CASE WHEN regexp_full_match(txt, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
               THEN TRY_CAST(txt AS DOUBLE) END AS value
FROM (SELECT *, trim(regexp_replace(raw_value, '[,₹% ]|Cr', '', 'g')) AS txt FROM facts)"""


def _fact(s: str, l: str) -> str:
    return f"max(value) FILTER (section = '{s}' AND label = '{l}')"


def _line(s: str, l: str, n: int) -> str:
    return (f"(list(value ORDER BY period) FILTER (section = '{s}' AND label = '{l}' "
            f"AND value IS NOT NULL))[-{n}:]")


CTE["fund0"] = f"""
SELECT symbol, {_fact('top-ratios', 'roe')} AS roe, {_fact('top-ratios', 'roce')} AS roce,
       {_fact('top-ratios', 'stock p/e')} AS pe_ratio,
       {_fact('top-ratios', 'market cap')} AS market_cap_cr,
       {_fact('profit-loss', 'opm %')} AS opm, {_fact('profit-loss', 'eps in rs')} AS eps_ttm,
       {_fact('balance-sheet', 'borrowings+')} AS borrowings,
       {_fact('balance-sheet', 'equity capital')} + {_fact('balance-sheet', 'reserves')} AS worth,
       {_fact('shareholding', 'promoter_holding')} AS promoter_holding,
       {_fact('shareholding', 'promoter_pledge_pct')} AS promoter_pledge_pct,
       coalesce({_line('profit-loss', 'sales+', 4)}, []) AS sales,
       coalesce({_line('profit-loss', 'net profit+', 4)}, []) AS profit,
       coalesce({_line('quarters', 'eps in rs', 8)}, []) AS eps_q
FROM facts_n GROUP BY symbol"""


def _cagr(v: str) -> str:
    return (f"CASE WHEN len({v}) >= 4 AND {v}[-4] > 0 AND {v}[-1] > 0 "
            f"THEN round_even((pow({v}[-1] / {v}[-4], 1.0::DOUBLE / 3) - 1) * 100, 2) END")


def _yoy(k: int) -> str:
    return f"(eps_q[-{k}] / eps_q[-{k + 4}])"


CTE["fund1"] = f"""
SELECT *, CASE WHEN worth > 0 THEN round_even(borrowings / worth, 2) END AS debt_to_equity,
       {_cagr('sales')} AS sales_growth_3yr, {_cagr('profit')} AS profit_growth_3yr,
       CASE WHEN len(eps_q) >= 8 AND eps_q[-5] > 0 AND eps_q[-6] > 0 AND eps_q[-7] > 0
            THEN {_yoy(3)} < {_yoy(2)} AND {_yoy(2)} < {_yoy(1)} END AS eps_acceleration
FROM fund0"""
CTE["fund2"] = f"""
SELECT symbol, roe, roce, debt_to_equity, sales_growth_3yr, profit_growth_3yr, opm, eps_ttm,
       promoter_holding, promoter_pledge_pct, market_cap_cr, pe_ratio,
       {yes('roe >= 12')} + {yes('roce >= 12')} + {yes('debt_to_equity <= 1')}
       + {yes('sales_growth_3yr >= 10')} + {yes('profit_growth_3yr >= 10')}
       + {yes('promoter_holding >= 40')} + {yes('promoter_pledge_pct <= 20')}
       + {yes('opm >= 10')} + {yes('market_cap_cr >= 500')} + {yes('eps_acceleration')}
         AS quality_score, eps_acceleration
FROM fund1"""
CTE["fundamentals"] = """
SELECT f.*, CAST((SELECT d FROM last_day) - CAST(substr(symbol, 2) AS INTEGER) % 60 AS DATE) AS trade_date
FROM fund2 f
UNION ALL
SELECT f.* REPLACE (greatest(quality_score - 2, 0) AS quality_score),
       CAST((SELECT d FROM last_day) - CAST(substr(symbol, 2) AS INTEGER) % 60 - 91 AS DATE)
FROM fund2 f"""
CTE["latest_fund"] = """
SELECT * FROM fundamentals
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1"""

# ------------------------------------------------------------------ signals
CTE["index_return"] = """
SELECT trade_date, close / lag(close, 63) OVER (ORDER BY trade_date) - 1 AS index_return
FROM index_bars"""
CTE["s_in"] = """
SELECT f.*, q.quality_score AS quality, r.index_return
FROM features f LEFT JOIN latest_fund q ON q.symbol || '.NS' = f.symbol
LEFT JOIN index_return r ON r.trade_date = f.trade_date"""
CTE["s0"] = f"""
SELECT *,
       {roll('max', 'close_price', 252)} AS full_high, {roll('min', 'close_price', 252)} AS full_low,
       {roll('max', 'atr_14', 90, 20)} AS atr_peak,
       coalesce(lead(is_earnings_day) OVER ({W}), 0) AS eve,
       nullif({roll('max', 'close_price', 20, 10, 1)}, 0) AS pvt,
       nullif({roll('min', 'close_price', 20, 10, 1)}, 0) AS base,
       {chg('close_price', lag('close_price', 63))} AS own,
       {chg('open_price', lag('close_price'))} AS gap,
       {div(lag('avg_volume_10'), 'avg_volume_20')} AS dry,
       {lag('ema_200', 20)} AS ema_200_l, {lag('ema_50', 10)} AS ema_50_l
FROM s_in"""
CTE["s1"] = f"""
SELECT *,
       {yes('close_price > ema_50 AND ema_50 > ema_150 AND ema_150 > ema_200 AND ema_200 > ema_200_l AND ema_50 > ema_50_l')} AS trend_signal,
       {yes(f"close_price > ema_150 AND close_price > ema_200 AND ema_200 > ema_200_l AND {div('close_price - full_low', 'full_high - full_low')} >= 0.75")} AS stage2_signal,
       {yes('close_price > ema_10 AND ema_10 > ema_21 AND ema_21 > ema_50')} AS ema_alignment_signal,
       {yes('relative_volume < 0.70')} AS volume_contraction_signal,
       {yes('volatility_contraction < 0.80')} AS volatility_contraction_signal,
       {yes('avg_volume_20 >= 500000 AND close_price * avg_volume_20 >= 50000000')} AS liquidity_signal,
       round_even(pvt, 2) AS pivot_price, round_even(base, 2) AS base_low_price,
       round_even({chg('close_price', 'pvt')} * 100, 2) AS distance_from_pivot_pct,
       round_even({chg('close_price', 'high_52w')} * 100, 2) AS distance_from_52w_high_pct,
       {yes('own > index_return')} AS rs_signal,
       round_even((own - index_return) * 100, 2) AS rs_value
FROM s0"""
CTE["s2"] = f"""
SELECT *,
       sum(CASE WHEN stage2_signal = 1 AND coalesce(prev_stage2, 0) = 0 THEN 1 ELSE 0 END)
         OVER ({W} ROWS UNBOUNDED PRECEDING) AS run_id,
       {yes(f"rs_value > {roll('max', 'rs_value', 252, 126, 1)}")} AS rs_new_high
FROM (SELECT *, {lag('stage2_signal')} AS prev_stage2 FROM s1)"""
CTE["s3"] = f"""
SELECT *,
       CASE WHEN stage2_signal = 1 THEN CAST(row_number() OVER (PARTITION BY symbol, run_id ORDER BY trade_date) AS INTEGER) ELSE 0 END AS stage2_days,
       CASE WHEN stage2_signal = 1 THEN min(trade_date) OVER (PARTITION BY symbol, run_id) END AS stage2_started_date,
       {yes(f"stage2_signal = 1 AND ema_alignment_signal = 1 AND volume_contraction_signal = 1 AND volatility_contraction_signal = 1 AND coalesce({div('atr_14', 'atr_peak')}, 1) < 0.65 AND eve <> 1")} AS vcp_signal,
       CASE WHEN quality IS NOT NULL THEN {yes('quality >= 6')} ELSE {yes('stage2_signal = 1 AND trend_score >= 3 AND avg_volume_20 >= 500000')} END AS quality_signal,
       {yes(f"close_price > ema_150 AND close_price > ema_200 AND ema_150 > ema_200 AND ema_200 > ema_200_l AND ema_50 > ema_150 AND ema_50 > ema_200 AND close_price > ema_50 AND {chg('close_price', 'low_52w')} >= 0.30 AND {div('high_52w - close_price', 'high_52w')} <= 0.25 AND rs_signal = 1")} AS minervini_signal,
       {yes(f"{div('high_52w - close_price', 'high_52w')} <= 0.10 AND {div('pvt - base', 'pvt')} < 0.12 AND close_price > pvt AND relative_volume >= 1.5 AND close_price > ema_150 AND is_earnings_day <> 1")} AS darvas_signal,
       ema_50 > ema_150 AND ema_150 > ema_200 AND close_price > ema_200 AS stacked
FROM s2"""
CTE["s4"] = f"""
SELECT *,
       {yes(f"stacked AND close_price > pvt AND relative_volume >= 1.5 AND {chg('close_price', 'ema_50')} <= 0.10 AND {div('close_price - low_price', 'high_price - low_price')} >= 0.5 AND NOT coalesce(gap > 0.03 AND close_price < open_price, FALSE) AND is_earnings_day <> 1 AND {div('pvt - base', 'pvt')} < 0.15 AND {chg('close_price', 'low_52w')} >= 0.30 AND close_price > ema_50 AND distance_from_52w_high_pct >= -25 AND stage2_days <= 60 AND dry < 0.75")} AS breakout_signal,
       {yes(f"stacked AND {div('close_price', 'pvt')} >= 1.0::DOUBLE - 0.03::DOUBLE AND NOT coalesce(close_price > pvt, FALSE)")} AS breakout_ready_signal
FROM s3"""
CTE["s5"] = """
SELECT *, round_even((trend_signal * 20 + stage2_signal * 20 + liquidity_signal * 10 + quality_signal * 20
                 + vcp_signal * 15 + breakout_signal * 15) / 100.0::DOUBLE * 100, 2) AS composite_score
FROM s4"""
CTE["s6"] = f"""
SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY composite_score DESC) AS drank,
       {yes('composite_score >= 70')} AS institutional_candidate,
       nullif(pivot_price, 0) AS p, greatest(nullif(pivot_price, 0) - base_low_price, 0) AS rng
FROM s5"""
CTE["s7"] = f"""
SELECT *, drank::DOUBLE / max(drank) OVER (PARTITION BY symbol) * 100 AS composite_rank,
       CASE WHEN p IS NOT NULL THEN round_even(rng / p * 100, 2) END AS base_range_pct,
       p + rng * 0.5::DOUBLE AS t1, p + rng * 1.0::DOUBLE AS t2, p + rng * 0.25::DOUBLE AS t3,
       greatest(close_price - coalesce(atr_14, 0) * 1.5::DOUBLE, 0) AS support,
       round_even(least(greatest(40.0::DOUBLE + breakout_signal * 5 + minervini_signal * 8
             + rs_new_high * 5 + darvas_signal * 7 + {yes('composite_score >= 80')} * 5
             + {yes('stage2_days > 0 AND stage2_days <= 20')} * 3
             - {yes('stage2_days > 60')} * 5, 20), 75), 1) AS prob
FROM s6"""
CTE["s8"] = """
SELECT *, round_even(t1, 2) AS target_1_price, round_even(t2, 2) AS target_2_price, round_even(t3, 2) AS target_3_price,
       round_even((t1 / close_price - 1) * 100, 2) AS target_1_pct,
       round_even((t2 / close_price - 1) * 100, 2) AS target_2_pct,
       round_even((t3 / close_price - 1) * 100, 2) AS target_3_pct,
       CASE WHEN p IS NULL THEN NULL WHEN close_price > t2 THEN 'PAST_T2'
            WHEN close_price > t1 THEN 'PAST_T1'
            WHEN close_price >= t1 * 0.97::DOUBLE AND close_price <= t1 THEN 'NEAR_T1'
            WHEN close_price >= p AND close_price < t1 * 0.97::DOUBLE THEN 'ACTIVE'
            ELSE 'IN_BASE' END AS position_stage,
       CASE WHEN close_price > t2 THEN round_even(t2 * 0.98::DOUBLE, 2)
            WHEN close_price > t1 THEN round_even(t1 * 0.98::DOUBLE, 2)
            WHEN p IS NOT NULL THEN round_even(p * (1 - 0.07::DOUBLE), 2) END AS stop_level
FROM s7"""
CTE["signals"] = """
SELECT *, CASE WHEN p IS NOT NULL THEN round_even(greatest(stop_level, support), 2) END AS trailing_stop_price,
       round_even(target_2_pct / (0.07::DOUBLE * 100), 2) AS risk_reward_t2,
       CASE WHEN p IS NOT NULL THEN prob END AS upside_prob_pct,
       round_even(prob / 100 * target_2_pct - (1.0::DOUBLE - prob / 100) * (0.07::DOUBLE * 100), 2) AS ev_score
FROM s8"""

# ------------------------------------------------------------------ regime
IX = "ORDER BY trade_date"
CTE["r0"] = f"SELECT *, row_number() OVER ({IX}) - 1 AS pos FROM index_bars"
CTE["r1"] = f"""
SELECT *, {ema('close', 50, w=IX)} AS ema_50, {ema('close', 200, w=IX)} AS ema_200,
       {roll('max', 'close', 20, w=IX)} AS peak_20
FROM r0"""
CTE["index_enriched"] = f"""
SELECT *, coalesce({chg('ema_200', lag('ema_200', 20, IX))} * 100, 0) AS ema_200_slope_pct,
       coalesce(peak_20 > {lag('peak_20', 20, IX)}, FALSE) AS higher_highs
FROM r1"""
CTE["r3"] = f"""
SELECT *, ({yes('close > ema_50')} + {yes('close > ema_200')} + {yes('ema_50 > ema_200')}
           + {yes('ema_200_slope_pct > 0')} + {yes('higher_highs')}) * 20 AS score
FROM index_enriched"""
CTE["regime"] = """
SELECT r.index_code, r.trade_date,
       coalesce((SELECT arg_max(m.state_code, m.score_min) FROM market_states m
                 WHERE m.is_active AND r.score BETWEEN m.score_min AND m.score_max), 'BEAR') AS market_status,
       r.score::DOUBLE AS regime_score, r.close AS index_close, r.ema_50, r.ema_200,
       r.close > r.ema_50 AS above_ema_50, r.close > r.ema_200 AS above_ema_200,
       r.ema_50 > r.ema_200 AS ema_50_above_200, r.ema_200_slope_pct, r.higher_highs
FROM r3 r WHERE pos >= 220"""
CTE["environment"] = """
SELECT r.trade_date, r.market_status AS market_state, r.regime_score,
       coalesce(m.exposure_level, 0) AS exposure_level,
       coalesce(m.max_position_size, 0) AS max_position_size,
       coalesce(m.allow_breakouts, FALSE) AS allow_breakouts,
       coalesce(m.allow_pyramiding, FALSE) AS allow_pyramiding,
       coalesce(m.cash_mode, TRUE) AS cash_mode
FROM regime r LEFT JOIN market_states m ON m.state_code = r.market_status"""
CTE["distribution"] = f"""
SELECT index_code, trade_date,
       CAST(sum({yes('c <= -0.002 AND up')}) OVER ({IX} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS INTEGER) AS distribution_count
FROM (SELECT *, {chg('close', lag('close', 1, IX))} AS c, volume > {lag('volume', 1, IX)} AS up FROM index_bars)"""

# ------------------------------------------------------------------ back-test
_PLAIN = """
SELECT '{name}' AS strategy, s.trade_date AS entry_date, s.symbol, s.composite_score, s.stage2_days,
       b.close_price AS entry_price, coalesce(r.market_status, 'UNKNOWN') AS regime
FROM signals s JOIN bars b ON b.symbol = s.symbol AND b.trade_date = s.trade_date
LEFT JOIN regime r ON r.trade_date = s.trade_date
LEFT JOIN timeframes t ON t.symbol = s.symbol AND t.trade_date = s.trade_date
{joins}
WHERE s.composite_score >= {score} AND {cond}"""
_PA = """JOIN price_action p ON p.symbol = s.symbol AND p.trade_date = s.trade_date
JOIN environment e ON e.trade_date = s.trade_date AND NOT e.cash_mode AND e.market_state <> 'DEFENSIVE'"""


def entries(name: str, signal: str, mtf: int | None = None, score: float = 50, more: str = "TRUE") -> str:
    if signal == "pa_signal":
        cond, joins = "p.pa_signal = 1", _PA
    elif signal == "combined_pa_ema":
        cond, joins = "p.pa_signal = 1 AND s.breakout_signal = 1", _PA
    else:
        cond, joins = f"s.{signal} = 1", ""
    if mtf is not None:
        cond += f" AND coalesce(t.mtf_score, 0) >= {mtf}"
    return _PLAIN.format(name=name, joins=joins, score=score, cond=f"{cond} AND {more}")


def exits(src: str, stop: float = 0.07, target: float = 0.20, hold: int = 60) -> str:
    """Nested select closing the entries of a table expression."""
    met = f"""
SELECT e.strategy, e.symbol, e.entry_date, any_value(e.entry_price) AS ep,
       any_value(e.composite_score) AS cs, any_value(e.regime) AS regime,
       min(CASE WHEN b.low_price <= e.entry_price * (1.0::DOUBLE - {stop}::DOUBLE) THEN b.trade_date END) AS stopped,
       min(CASE WHEN b.high_price >= e.entry_price * (1.0::DOUBLE + {target}::DOUBLE) THEN b.trade_date END) AS reached,
       max(b.trade_date) AS last_bar, arg_max(b.close_price, b.trade_date) AS last_close
FROM ({src}) e JOIN bars b ON b.symbol = e.symbol AND b.trade_date > e.entry_date
  AND b.trade_date <= e.entry_date + {hold}
WHERE e.entry_price > 0 GROUP BY 1, 2, 3"""
    picked = f"""
SELECT *, CASE WHEN stopped IS NOT NULL AND (reached IS NULL OR stopped <= reached) THEN 'STOP'
               WHEN reached IS NOT NULL THEN 'TARGET' ELSE 'TIMEOUT' END AS exit_reason FROM ({met})"""
    priced = f"""
SELECT *, CASE exit_reason WHEN 'STOP' THEN stopped WHEN 'TARGET' THEN reached ELSE last_bar END AS exit_date,
       CASE exit_reason WHEN 'STOP' THEN ep * (1.0::DOUBLE - {stop}::DOUBLE)
            WHEN 'TARGET' THEN ep * (1.0::DOUBLE + {target}::DOUBLE) ELSE last_close END AS xp FROM ({picked})"""
    return f"""
SELECT strategy, symbol, entry_date, round_even(ep, 2) AS entry_price, exit_date,
       round_even(xp, 2) AS exit_price, round_even((xp / ep - 1.0) * 100.0, 3) AS return_pct,
       CAST(exit_date - entry_date AS INTEGER) AS holding_days, exit_reason,
       round_even(cs, 1) AS composite_score, regime FROM ({priced})"""


from barquet.config import STRATEGIES  # noqa: E402

CTE["all_entries"] = " UNION ALL ".join(entries(n, s, m) for n, s, m in STRATEGIES)
CTE["trades"] = exits("SELECT * FROM all_entries")

# ------------------------------------------------------------------ calibration
CTE["cal_entries"] = """
SELECT symbol, trade_date, target_1_price, target_2_price,
       coalesce(target_3_price, pivot_price + pivot_price * base_range_pct / 100 * 0.25) AS target_3_price,
       CASE WHEN composite_score >= 70 THEN 70 WHEN composite_score >= 50 THEN 50
            WHEN composite_score >= 30 THEN 30 ELSE 0 END AS score_bucket
FROM signals WHERE (breakout_signal = 1 OR breakout_ready_signal = 1)
  AND target_1_price IS NOT NULL AND target_2_price IS NOT NULL AND pivot_price IS NOT NULL
  AND trade_date <= (SELECT d FROM last_day) - 60"""
CTE["cal_hits"] = """
SELECT c.symbol, c.trade_date, c.score_bucket,
       CASE WHEN max(CASE WHEN b.trade_date <= c.trade_date + 30 THEN b.high_price END) >= any_value(c.target_1_price) THEN 1 ELSE 0 END AS hit_t1,
       CASE WHEN max(b.high_price) >= any_value(c.target_2_price) THEN 1 ELSE 0 END AS hit_t2,
       CASE WHEN max(CASE WHEN b.trade_date <= c.trade_date + 20 THEN b.high_price END) >= any_value(c.target_3_price) THEN 1 ELSE 0 END AS hit_t3
FROM cal_entries c LEFT JOIN bars b ON b.symbol = c.symbol AND b.trade_date > c.trade_date
  AND b.trade_date <= c.trade_date + 60
GROUP BY 1, 2, 3"""
CTE["confidence"] = """
SELECT h.score_bucket, coalesce(e.market_state, 'UNKNOWN') AS market_regime, count(*) AS sample_count,
       round_even(avg(hit_t1) * 100, 1) AS hit_rate_t1, round_even(avg(hit_t2) * 100, 1) AS hit_rate_t2,
       round_even(avg(hit_t3) * 100, 1) AS hit_rate_t3
FROM cal_hits h LEFT JOIN environment e ON e.trade_date = h.trade_date
GROUP BY 1, 2 HAVING count(*) >= 30"""

CTE["presets"] = values(
    [(n, s, w, i + 1) for i, (n, ws) in enumerate(PRESETS.items()) for s, w in ws.items()],
    ("preset_name", "signal_name", "weight", "sort_order"),
)


# ------------------------------------------------------------------ composing
def query(body: str) -> str:
    """A statement with exactly the table expressions it needs, in order."""
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in CTE:
            if name in needed or name in open_names:
                continue
            if re.search(rf"(?:FROM|JOIN|,)\s+{name}(?![\w'])", text):
                open_names.add(name)
                visit(CTE[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in needed)
    return f"WITH {parts} {body.strip()}"
