"""Stored stage tables of one data directory.

The daily job stores bars, features, signals and regime rows and serves every
screen and report from those tables. The queries do the same: the first one
that needs a stage writes it to the shared folder, later ones read it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.operators import (
    calibration, fundamentals, price_action, regime, serving, timeframes,
)
from barquet.plans.backtesting import Panels, compare
from barquet.plans.daily import feature_table, signal_table
from barquet.session import assume, at_once, materialize
from verification import fixtures

_TABLES: dict[tuple[str, str, str], DataFrame] = {}
_DATES: dict[tuple[str, str, str], date] = {}


class Stages:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = assume(spark), str(sf_dir)

    def _key(self, name: str) -> tuple[str, str, str]:
        return (self.spark.sparkContext.applicationId, self.sf_dir, name)

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = self._key(name)
        if key not in _TABLES:
            _TABLES[key] = materialize(build(), name)
        return _TABLES[key]

    def _date(self, name: str, build: Callable[[], DataFrame]) -> date:
        key = self._key(name)
        if key not in _DATES:
            _DATES[key] = build().first()[0]
        return _DATES[key]

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    # ------------------------------------------------------------ inputs
    def raw_bars(self) -> DataFrame:
        return self._stored("raw_bars", lambda: fixtures.raw_bars(self.spark, self.sf_dir))

    def bars(self) -> DataFrame:
        return self.raw_bars().drop("src_date", "i", "di")

    def dirty_bars(self) -> DataFrame:
        return fixtures.dirty_bars(self.raw_bars())

    def last_day(self) -> date:
        return self._date("last_day", lambda: self.raw_bars().agg(F.max("trade_date")))

    def screen_day(self) -> date:
        """Latest session every symbol has reached."""
        return self._date(
            "screen_day",
            lambda: self.raw_bars().groupBy("symbol").agg(F.max("trade_date").alias("d"))
            .agg(F.min("d")),
        )

    def index_bars(self) -> DataFrame:
        return self._stored("index_bars", lambda: fixtures.index_bars(self.raw_bars()))

    def vol_index(self) -> DataFrame:
        return fixtures.volatility_index(self.raw_bars())

    def universe(self) -> DataFrame:
        return fixtures.universe(self.spark, self.sf_dir)

    def membership(self) -> DataFrame:
        return fixtures.membership(self.spark, self.sf_dir)

    def earnings(self) -> DataFrame:
        return fixtures.earnings(self.raw_bars())

    def facts(self) -> DataFrame:
        return fixtures.fundamental_facts(self.spark, self.sf_dir)

    def market_states(self) -> DataFrame:
        return fixtures.market_states(self.spark)

    def index_reference(self) -> DataFrame:
        return fixtures.index_reference(self.spark)

    # ------------------------------------------------------------ daily tables
    def fundamentals(self) -> DataFrame:
        """Two collection days per symbol, the older one with a lower score."""

        def build() -> DataFrame:
            rows = fundamentals.fundamentals(self.facts())
            k = fixtures.supplier_number(F.col("symbol"))
            newer = rows.withColumn(
                "trade_date", F.date_sub(F.lit(self.last_day()), (k % 60).cast("int"))
            )
            older = newer.withColumns(
                {
                    "trade_date": F.date_sub("trade_date", 91),
                    "quality_score": F.greatest(F.col("quality_score") - 2, F.lit(0)),
                }
            )
            return newer.unionByName(older)

        return self._stored("fundamentals", build)

    def features(self) -> DataFrame:
        return self._stored("features", lambda: feature_table(self.bars(), self.earnings()))

    def signals(self) -> DataFrame:
        return self._stored(
            "signals",
            lambda: signal_table(self.features(), self.index_bars(), self.fundamentals()),
        )

    def price_action(self) -> DataFrame:
        return self._stored("price_action", lambda: price_action.price_action(self.features()))

    def timeframes(self) -> DataFrame:
        return self._stored("timeframes", lambda: timeframes.timeframes(self.features()))

    def regime(self) -> DataFrame:
        return self._stored(
            "regime", lambda: regime.regime_history(self.index_bars(), self.market_states())
        )

    def environment(self) -> DataFrame:
        return self._stored(
            "environment", lambda: regime.environment(self.regime(), self.market_states())
        )

    def daily(self) -> list[DataFrame]:
        """Signals, price action and timeframes: none needs another, so they are stored side by side."""
        self.features(), self.index_bars(), self.fundamentals()
        return at_once(self.spark, self.signals, self.price_action, self.timeframes)

    def panels(self) -> Panels:
        signals, actions, frames = self.daily()
        return Panels(signals, self.bars(), self.regime(), self.environment(), actions, frames)

    def first_day(self) -> date:
        return self._date("first_day", lambda: self.raw_bars().agg(F.min("trade_date")))

    def trades(self) -> DataFrame:
        """Closed trades of all compared strategies over the whole history."""
        return self._stored(
            "trades", lambda: compare(self.panels(), self.first_day(), self.last_day())
        )

    def confidence(self) -> DataFrame:
        return self._stored(
            "confidence",
            lambda: calibration.confidence_model(
                self.signals(), self.bars(), self.environment(), self.last_day()
            ),
        )

    def scanner(self) -> DataFrame:
        signals, actions, frames = self.daily()
        return serving.scanner(signals, self.screen_day(), self.universe(), self.fundamentals(), actions, frames)
