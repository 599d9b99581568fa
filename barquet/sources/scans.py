"""Panel scans. Row order is never imposed here: windows order what they need."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barquet import config
from barquet.functions.predicates import b
from barquet.functions.scalars import with_suffix
from barquet.schemas import PRICES, conform, require

PRICE_ACTION_INPUT = (
    "symbol", "trade_date", "close_price", "high_price", "low_price",
    "ema_50", "relative_volume",
)
TIMEFRAME_INPUT = ("symbol", "trade_date", "close_price")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price panel with its declared schema (no inference pass)."""
    return spark.read.schema(PRICES).parquet(path).select(*config.PRICE_COLUMNS)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table in its declared schema; columns it lacks are null."""
    return conform(spark.read.parquet(path), schema)


def price_panel(df: DataFrame) -> DataFrame:
    return require(df, config.PRICE_COLUMNS).select(*config.PRICE_COLUMNS)


def feature_panel(df: DataFrame) -> DataFrame:
    """Feature columns with the earnings mark defaulting to 0."""
    mark = (
        F.coalesce(F.col("is_earnings_day").cast("int"), F.lit(0))
        if "is_earnings_day" in df.columns else F.lit(0)
    )
    names = [c for c in config.FEATURE_COLUMNS if c != "is_earnings_day"]
    return require(df, names).select(*names, mark.alias("is_earnings_day"))


def price_action_panel(features: DataFrame) -> DataFrame:
    return require(features, PRICE_ACTION_INPUT).select(*PRICE_ACTION_INPUT)


def timeframe_panel(features: DataFrame) -> DataFrame:
    return require(features, TIMEFRAME_INPUT).select(*TIMEFRAME_INPUT)


def symbol_history(prices: DataFrame, symbol: str) -> DataFrame:
    """One symbol's bars; the equality reaches the file scan."""
    return price_panel(prices).filter(F.col("symbol") == symbol)


def bulk_range(
    prices: DataFrame, symbols: DataFrame, start: date, end: date
) -> DataFrame:
    """High/low/close bars of many symbols in a date range.

    The symbols stay a DataFrame and restrict by semi join, so there is no
    IN-list to batch.
    """
    return (
        prices.filter(F.col("trade_date").between(start, end))
        .select("symbol", "trade_date", "high_price", "low_price", "close_price")
        .join(symbols.select("symbol"), "symbol", "left_semi")
    )


def universe_symbols(universe: DataFrame, prices: DataFrame) -> DataFrame:
    """Active symbols, suffixed; all priced symbols when none is active."""
    suffixed = with_suffix(F.col("symbol")).alias("symbol")
    active = universe.filter(b(F.col("is_active")) & F.col("symbol").isNotNull())
    source = prices if active.isEmpty() else active
    return source.select(suffixed).distinct()
