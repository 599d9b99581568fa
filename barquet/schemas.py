"""Table schemas and schema checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, IntegerType, LongType, StringType,
    StructField, StructType,
)

_D, _I, _L, _S, _DT, _B = (
    DoubleType(), IntegerType(), LongType(), StringType(), DateType(), BooleanType()
)


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields.items()])


PRICES = _schema(
    symbol=_S, trade_date=_DT, open_price=_D, high_price=_D, low_price=_D,
    close_price=_D, volume=_L,
)
INDEX_BARS = _schema(index_code=_S, trade_date=_DT, close=_D, volume=_L)
UNIVERSE = _schema(
    symbol=_S, company_name=_S, sector=_S, isin=_S, is_active=_B,
    first_seen=_DT, last_seen=_DT,
)
MEMBERSHIP = _schema(
    symbol=_S, index_code=_S, is_current_member=_B, first_added_date=_DT,
    last_removed_date=_DT,
)
EARNINGS = _schema(symbol=_S, earnings_date=_DT, fetched_at=_DT)
FUNDAMENTALS = _schema(
    symbol=_S, trade_date=_DT, roe=_D, roce=_D, debt_to_equity=_D,
    sales_growth_3yr=_D, profit_growth_3yr=_D, opm=_D, eps_ttm=_D,
    promoter_holding=_D, promoter_pledge_pct=_D, market_cap_cr=_D, pe_ratio=_D,
    quality_score=_I, eps_acceleration=_B,
)
TRADES = _schema(
    strategy=_S, symbol=_S, entry_date=_DT, entry_price=_D, exit_date=_DT,
    exit_price=_D, return_pct=_D, holding_days=_I, exit_reason=_S,
    composite_score=_D, regime=_S,
)
QUALITY_LOG = _schema(
    run_date=_DT, check_type=_S, symbol=_S, description=_S, rows_affected=_L,
)
MARKET_STATES = _schema(
    state_code=_S, score_min=_I, score_max=_I, exposure_level=_D,
    max_position_size=_D, allow_breakouts=_B, allow_pyramiding=_B,
    cash_mode=_B, is_active=_B,
)


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail while the plan is built when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to a schema; unreadable values and absent columns become null."""
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns
             else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
