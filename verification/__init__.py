"""Queries over the driver's tables and the SQL they are checked against."""

from verification import (  # noqa: F401
    queries_backtest, queries_market, queries_panel, queries_screen, queries_tables,
)
from verification import queries_daily  # noqa: E402,F401  (uses statements of the others)
from verification.registry import ORACLES, QUERIES  # noqa: F401
