"""Normalisers for constituent lists, exchange listings and price files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet import config
from barquet.schemas import PRICES, require

LISTING_COLUMNS = ("symbol", "company_name", "sector", "isin")
# Price-file headers in the order of the panel columns.
PRICE_HEADERS = ("Open", "High", "Low", "Close", "Volume")
DATE_HEADERS = ("Date", "Datetime", "index")


def _trimmed(name: str | None) -> Column:
    if name is None:
        return F.lit(None).cast("string")
    return F.trim(F.col(f"`{name}`"))


def _header(columns: Sequence[str], *parts: str) -> str | None:
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def _one_per_symbol(rows: DataFrame) -> DataFrame:
    """One row per symbol, chosen the same way on every run."""
    rest = [c for c in rows.columns if c != "symbol"]
    return rows.groupBy("symbol").agg(F.min(F.struct(*rest)).alias("r")).select("symbol", "r.*")


def normalize_constituents(raw: DataFrame) -> DataFrame:
    """Constituent list with loosely named headers -> listing columns."""
    key = next((c for c in raw.columns if c.strip().lower() == "symbol"), None)
    if key is None:
        raise ValueError(f"no symbol column in {raw.columns}")
    rows = raw.select(
        F.upper(_trimmed(key)).alias("symbol"),
        _trimmed(_header(raw.columns, "company")).alias("company_name"),
        _trimmed(_header(raw.columns, "industr", "sector")).alias("sector"),
        _trimmed(_header(raw.columns, "isin")).alias("isin"),
    ).filter(F.col("symbol").isNotNull() & (F.col("symbol") != "SYMBOL"))
    return _one_per_symbol(rows)


def normalize_equity_list(raw: DataFrame) -> DataFrame:
    """Exchange listing -> listing columns, tradable series only."""
    by_name = {c.strip(): c for c in raw.columns}
    if "SYMBOL" not in by_name:
        raise ValueError(f"no SYMBOL column in {raw.columns}")
    rows = raw
    if "SERIES" in by_name:
        rows = rows.filter(_trimmed(by_name["SERIES"]).isin(*config.LISTED_SERIES))
    rows = rows.select(
        F.upper(_trimmed(by_name["SYMBOL"])).alias("symbol"),
        _trimmed(by_name.get("NAME OF COMPANY")).alias("company_name"),
        F.lit(None).cast("string").alias("sector"),
        _trimmed(by_name.get("ISIN NUMBER")).alias("isin"),
    ).filter(F.col("symbol").isNotNull())
    return _one_per_symbol(rows)


def normalize_prices(raw: DataFrame) -> DataFrame:
    """Any open/high/low/close/volume file -> panel columns and types."""
    require(raw, PRICE_HEADERS)
    day = next((c for c in DATE_HEADERS if c in raw.columns), None)
    if day is None:
        raise ValueError(f"no date column in {raw.columns}")
    names = ("open_price", "high_price", "low_price", "close_price")
    prices = [
        F.col(h).try_cast("double").alias(n) for h, n in zip(PRICE_HEADERS[:4], names)
    ]
    volume = F.col("Volume").try_cast("double").cast(PRICES["volume"].dataType)
    symbol = [F.col("symbol")] if "symbol" in raw.columns else []
    return raw.select(
        *symbol, F.col(day).try_cast("date").alias("trade_date"), *prices,
        volume.alias("volume"),
    )
