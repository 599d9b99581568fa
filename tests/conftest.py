import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from barquet.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def weekdays(n, start=date(2024, 1, 1)):
    """n weekdays from a Monday on."""
    return [start + timedelta(days=7 * (i // 5) + i % 5) for i in range(n)]


@pytest.fixture
def panel(spark):
    """Build a price panel from closes: panel({"A": [..]}, **column overrides)."""

    def build(closes, start=date(2024, 1, 1), spread=1.0, volume=1_000_000):
        rows = [
            (sym, d, float(c), c + spread, max(c - spread, 0.01), float(c), int(volume))
            for sym, series in closes.items()
            for d, c in zip(weekdays(len(series), start), series)
        ]
        return spark.createDataFrame(
            rows,
            "symbol string, trade_date date, open_price double, high_price double, "
            "low_price double, close_price double, volume long",
        )

    return build
