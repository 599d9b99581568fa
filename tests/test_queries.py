"""Every registered query against its DuckDB statement on the smallest data."""

import pytest

from verification import ORACLES, QUERIES
from verification.check import compare, connect
from verification.stages import Stages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        problem, _ = compare(df, con, ORACLES[name])
        assert problem is None
    else:
        rows = df.collect()
        assert rows and len({tuple(r)[:2] for r in rows}) == len(rows)


def test_combined_entries_are_breakouts(spark):
    trades = Stages(spark, SF).trades()
    key = ["symbol", "entry_date"]
    both = trades.filter("strategy = 'Combined PA+EMA'")
    assert both.join(trades.filter("strategy = 'Composite'"), key, "left_anti").count() == 0
