"""DuckDB text of the fixture views, as named common table expressions."""

from __future__ import annotations

from barquet import config

CTE: dict[str, str] = {}

CTE["daily"] = """
SELECT l_suppkey, CAST(l_shipdate AS DATE) AS src_date,
       sum(CAST(round(l_discount * 100) AS BIGINT) - 5)::BIGINT AS di,
       sum(CAST(round(l_tax * 100) AS BIGINT))::BIGINT AS ti,
       CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n
FROM lineitem GROUP BY 1, 2"""

CTE["walk0"] = """
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY src_date) - 1 AS i,
       (sum(di) OVER (PARTITION BY l_suppkey ORDER BY src_date
                      ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
FROM daily"""

CTE["walk1"] = """
SELECT *, CAST(round(10000 * exp(0.006::DOUBLE * cum + 0.0015::DOUBLE * (i + 1))) AS BIGINT) AS cp
FROM walk0"""

CTE["walk2"] = """
SELECT *, coalesce(lag(cp) OVER (PARTITION BY l_suppkey ORDER BY src_date), 10000) AS pp
FROM walk1"""

CTE["walk3"] = "SELECT *, pp + (pp * (ti - 4 * n)) // 1000 AS op FROM walk2"

CTE["raw_bars"] = """
SELECT 'S' || l_suppkey || '.NS' AS symbol,
       CAST(DATE '2020-01-06' + CAST(7 * (i // 5) + i % 5 AS INTEGER) AS DATE) AS trade_date,
       src_date, CAST(i AS INTEGER) AS i, di, l_suppkey AS k,
       op / 100.0::DOUBLE AS open_price,
       (greatest(op, cp) + (greatest(op, cp) * (1 + ti)) // 2000) / 100.0::DOUBLE AS high_price,
       (least(op, cp) - (least(op, cp) * (1 + ti)) // 2000) / 100.0::DOUBLE AS low_price,
       cp / 100.0::DOUBLE AS close_price,
       q * 40000 AS volume
FROM walk3"""

CTE["bars"] = """
SELECT symbol, trade_date, open_price, high_price, low_price, close_price, volume
FROM raw_bars"""

CTE["last_day"] = "SELECT max(trade_date) AS d FROM raw_bars"
CTE["screen_day"] = """
SELECT min(d) AS d FROM (SELECT max(trade_date) AS d FROM raw_bars GROUP BY symbol)"""

CTE["index_daily"] = """
SELECT trade_date, i, sum(di)::DOUBLE / count(*) AS mean_di, sum(volume)::BIGINT AS volume
FROM raw_bars GROUP BY 1, 2"""

CTE["index_bars"] = """
SELECT 'NIFTY50' AS index_code, trade_date,
       round(1000000 * exp(0.02::DOUBLE * sum(mean_di) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)
                           + 0.0004::DOUBLE * (i + 1))) / 100.0::DOUBLE AS close, volume
FROM index_daily"""

CTE["vol_index"] = """
SELECT trade_date, 10 + 30 * avg(CASE WHEN close_price < open_price THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS close
FROM raw_bars GROUP BY 1"""

CTE["universe"] = """
SELECT 'S' || s_suppkey AS symbol,
       CASE WHEN s_suppkey % 29 <> 28 THEN s_name END AS company_name,
       CASE WHEN s_suppkey % 23 <> 22 THEN r_name END AS sector,
       'INE' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS isin,
       s_suppkey % 20 <> 19 AS is_active,
       CAST(DATE '2020-01-06' + CAST(s_suppkey % 30 AS INTEGER) AS DATE) AS first_seen,
       CAST(DATE '2022-01-03' + CAST(s_suppkey % 30 AS INTEGER) AS DATE) AS last_seen
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTE["membership"] = """
SELECT 'S' || s_suppkey AS symbol,
       CASE s_suppkey % 3 WHEN 0 THEN 'NIFTY50' WHEN 1 THEN 'NIFTY500' ELSE 'MIDCAP150' END AS index_code,
       s_suppkey % 7 <> 0 AS is_current_member,
       DATE '2020-01-06' AS first_added_date,
       CASE WHEN s_suppkey % 7 = 0 THEN DATE '2021-06-30' END AS last_removed_date
FROM supplier"""

CTE["earnings"] = """
SELECT symbol, trade_date AS earnings_date,
       CAST(trade_date + CAST(k % 12 AS INTEGER) AS DATE) AS fetched_at
FROM raw_bars WHERE i % 63 = 62 AND k % 11 <> 10"""


def _facts() -> str:
    k = "s_suppkey"
    one = [
        ("top-ratios", "roe", f"CASE WHEN {k} % 7 = 3 THEN '--' ELSE (5 + ({k} * 7) % 30) || '.' || ({k} % 10) || '%' END"),
        ("top-ratios", "roce", f"CASE WHEN {k} % 9 = 4 THEN 'N/A' ELSE (4 + ({k} * 11) % 28) || '%' END"),
        ("top-ratios", "stock p/e", f"(8 + ({k} * 3) % 50) || '.5'"),
        ("top-ratios", "market cap", f"CASE WHEN {k} % 3 = 0 THEN '₹' || (1 + {k} % 9) || ',' || lpad(CAST(({k} * 37) % 1000 AS VARCHAR), 3, '0') || ' Cr' ELSE (100 + ({k} * 53) % 900) || ' Cr' END"),
        ("profit-loss", "opm %", f"(3 + ({k} * 5) % 25) || '%'"),
        ("profit-loss", "eps in rs", f"(2 + {k} % 40) || '.75'"),
        ("balance-sheet", "borrowings+", f"CAST(({k} * 31) % 500 AS VARCHAR)"),
        ("balance-sheet", "equity capital", f"CAST(50 + {k} % 40 AS VARCHAR)"),
        ("balance-sheet", "reserves", f"CASE WHEN {k} % 19 = 2 THEN '-900' ELSE CAST(({k} * 17) % 800 AS VARCHAR) END"),
        ("shareholding", "promoter_holding", f"(30 + ({k} * 3) % 45) || '.' || lpad(CAST({k} % 100 AS VARCHAR), 2, '0') || '%'"),
        ("shareholding", "promoter_pledge_pct", f"(({k} % 6) * 7) || '%'"),
    ]
    parts = [
        f"SELECT 'S' || {k} AS symbol, '{s}' AS section, '{l}' AS label, 1 AS period, {v} AS raw_value FROM supplier WHERE {k} % 4 <> 0"
        for s, l, v in one
    ]
    many = [
        ("profit-loss", "sales+", 5, f"CASE WHEN {k} % 17 = 5 AND p = 2 THEN '-50' ELSE CAST(1000 + ({k} % 50) * 10 + p * ({k} % 13) * 20 AS VARCHAR) END"),
        ("profit-loss", "net profit+", 5, f"CASE WHEN {k} % 31 = 6 AND p = 4 THEN '-' ELSE CAST(100 + p * ({k} % 11) * 3 AS VARCHAR) END"),
        ("quarters", "eps in rs", 9, f"CASE WHEN {k} % 37 = 9 AND p >= 3 THEN 'n.m.' ELSE (p * p * (1 + {k} % 5) + ({k} * p) % 7) || '.25' END"),
    ]
    parts += [
        f"SELECT 'S' || {k}, '{s}', '{l}', CAST(p AS INTEGER), {v} FROM supplier, range(1, {n + 1}) r(p) WHERE {k} % 4 <> 0"
        for s, l, n, v in many
    ]
    return " UNION ALL ".join(parts)


CTE["facts"] = _facts()


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"{v}::DOUBLE"
    return str(v)


def values(rows, names) -> str:
    body = ", ".join("(" + ", ".join(_sql(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(names)})"


CTE["market_states"] = values(
    config.MARKET_STATES,
    ("state_code", "score_min", "score_max", "exposure_level", "max_position_size",
     "allow_breakouts", "allow_pyramiding", "cash_mode", "is_active"),
)
CTE["index_ref"] = values([(c, n, True) for c, n in config.INDEX_LIST],
                          ("index_code", "index_name", "is_active"))

_STALE = "i % 120 BETWEEN 30 AND 33"
CTE["dirty_once"] = f"""
SELECT symbol, trade_date, i,
       CASE WHEN {_STALE} THEN 100.0::DOUBLE ELSE open_price END AS open_price,
       CASE WHEN {_STALE} THEN 100.0::DOUBLE WHEN i % 83 = 11 THEN low_price - 1
            WHEN i % 107 = 17 THEN open_price * 6 ELSE high_price END AS high_price,
       CASE WHEN {_STALE} THEN 100.0::DOUBLE ELSE low_price END AS low_price,
       CASE WHEN {_STALE} THEN 100.0::DOUBLE WHEN i % 89 = 7 THEN NULL
            WHEN i % 107 = 17 THEN open_price * 6 ELSE close_price END AS close_price,
       CASE WHEN {_STALE} THEN 0 WHEN i % 101 = 13 THEN volume * 200 ELSE volume END AS volume
FROM raw_bars"""
CTE["dirty_bars"] = """
SELECT * EXCLUDE (i) FROM dirty_once
UNION ALL SELECT * EXCLUDE (i) FROM dirty_once WHERE i % 97 = 5"""
