"""Back-tests over the stored daily tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, STRATEGIES
from barquet.operators import backtest

R = DEFAULTS.backtest


@dataclass(frozen=True)
class Panels:
    """Stored tables a back-test reads."""

    signals: DataFrame
    prices: DataFrame
    regime: DataFrame
    environment: DataFrame
    price_action: DataFrame
    timeframes: DataFrame


def entries_for(
    panels: Panels, entry_signal: str, start: date, end: date, name: str | None = None, **bounds
) -> DataFrame:
    rows = backtest.signal_entries(
        entry_signal, start, end, panels.signals, panels.prices, panels.regime,
        panels.timeframes, panels.price_action, panels.environment, **bounds,
    )
    return rows.withColumn("strategy", F.lit(name or entry_signal))


def _reachable(panels: Panels, start: date, end: date, max_holding_days: int) -> DataFrame:
    """Prices from the first entry day to the last day a trade can be held."""
    last = end + timedelta(days=max_holding_days)
    return panels.prices.filter(F.col("trade_date").between(start, last))


def run(
    panels: Panels, entry_signal: str, start: date, end: date,
    stop_loss: float = R.stop_loss, target: float = R.target,
    max_holding_days: int = R.max_holding_days, name: str | None = None, **bounds,
) -> DataFrame:
    """Closed trades of one signal."""
    entries = entries_for(panels, entry_signal, start, end, name, **bounds)
    return backtest.trade_exits(
        entries, _reachable(panels, start, end, max_holding_days), stop_loss, target,
        max_holding_days,
    )


def compare(
    panels: Panels, start: date, end: date,
    strategies: Sequence[tuple[str, str, int | None]] = STRATEGIES,
    stop_loss: float = R.stop_loss, target: float = R.target,
    max_holding_days: int = R.max_holding_days,
) -> DataFrame:
    """Closed trades of several strategies in one pass over the panels."""
    entries = backtest.strategy_entries(
        strategies, start, end, panels.signals, panels.prices, panels.regime,
        panels.timeframes, panels.price_action, panels.environment,
    )
    return backtest.trade_exits(
        entries, _reachable(panels, start, end, max_holding_days), stop_loss, target,
        max_holding_days,
    )
