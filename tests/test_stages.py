"""Stages that do not depend on each other are stored side by side."""

import threading
from pathlib import Path

import pytest

from barquet.session import shared_folder
from verification import QUERIES
from verification.stages import Stages

TOGETHER = ("signals", "price_action", "timeframes")


@pytest.mark.parametrize("part", ["panels", "scanner"])
def test_daily_panels_are_stored_at_once(spark, monkeypatch, part):
    met = threading.Barrier(len(TOGETHER))
    before, row = [], spark.range(1)

    def stored(self, name, build):
        if name in TOGETHER:
            met.wait(20)
        before.append(name)
        return row

    monkeypatch.setattr(Stages, "_stored", stored)
    monkeypatch.setattr(Stages, "bars", lambda self: row)
    monkeypatch.setattr(Stages, "screen_day", lambda self: None)
    monkeypatch.setattr(Stages, "universe", lambda self: row)
    monkeypatch.setattr("verification.stages.serving.scanner", lambda signals, *rest: signals)
    getattr(Stages(spark, "/nowhere"), part)()
    assert set(TOGETHER) <= set(before) and "features" in before[:3]


def test_the_days_tables_leave_no_others(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"), "tables")
    folder.mkdir(parents=True, exist_ok=True)
    before = set(folder.iterdir())
    rows = {r["name"]: r["rows"] for r in QUERIES["daily_tables"](spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == 6 and rows["features"] == rows["signals"] == rows["price_action"] == rows["timeframes"] > 0
    assert not [p for p in set(folder.iterdir()) - before if p.name.startswith(("bars-", "rated-"))]
