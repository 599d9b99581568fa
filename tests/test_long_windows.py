"""Extremes of many rows in two steps, ranks by bit maps; and how little they visit."""

import random
import re

import pytest
from conftest import weekdays
from pyspark.sql import Window
from pyspark.sql import functions as F

from barquet.config import COMPOSITE_WEIGHTS
from barquet.functions.windows import Extreme, roll, with_extremes
from barquet.operators import features, signals
from barquet.session import ASSUMED
from verification.stages import Stages


@pytest.fixture
def values(spark):
    rng = random.Random(5)
    rows = [
        (s, d, None if rng.random() < 0.3 else float("nan") if rng.random() < 0.01 else rng.choice([-1.0, 0.0, 2.5, rng.random()]))
        for s, n in (("A", 1), ("B", 40), ("C", 300), ("D", 700)) for d in weekdays(n)
    ]
    return spark.createDataFrame(rows, "symbol string, trade_date date, x double")


@pytest.mark.parametrize("n, need, shift", [(2, 1, 0), (3, 3, 1), (10, 2, 0), (90, 20, 0), (252, 126, 1), (252, 1, 3)])
def test_extremes_equal_sliding_frames(values, n, need, shift):
    wanted = {"hi": Extreme(F.max, "x", n, need, shift), "lo": Extreme(F.min, "x", n, need, shift)}
    want = {"hi_": roll(F.max, F.col("x"), n, max(need, 2), shift), "lo_": roll(F.min, F.col("x"), n, max(need, 2), shift)}
    if need == 1:
        frame = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-(n - 1) - shift, -shift)
        want = {"hi_": F.max("x").over(frame), "lo_": F.min("x").over(frame)}
    got = with_extremes(values, wanted).withColumns(want)
    assert got.columns == ["symbol", "trade_date", "x", "hi", "lo", "hi_", "lo_"]
    assert got.filter(~F.col("hi").eqNullSafe(F.col("hi_")) | ~F.col("lo").eqNullSafe(F.col("lo_"))).count() == 0


def test_no_frame_visits_a_year(panel):
    """Each row of a sliding frame is visited for each row: none may hold hundreds."""
    bars = panel({"A": [100 + k % 7 for k in range(30)]})
    table = features.build_features(bars)
    plans = [df._jdf.queryExecution().analyzed().toString().replace("currentrow$()", "0") for df in (table, signals.raw_signals(table))]
    for plan in plans:
        frames = [(int(a), int(z)) for a, z in re.findall(r"RowFrame, (-?\d+), (-?\d+)", plan)]
        assert frames and max(z - a for a, z in frames) < 30
        assert "collect_set" not in plan


def test_ranks_by_bit_map_equal_ranks_by_set(spark):
    rng = random.Random(9)
    names = list(COMPOSITE_WEIGHTS)
    rows = [
        (f"S{k % 4}", d, *[rng.choice([0, 1, 1, None, 2, -1]) if k % 4 else int(c == names[0]) for c in names])
        for k in range(4) for d in weekdays(120)
    ]
    whole = spark.createDataFrame(rows, "symbol string, trade_date date, " + ", ".join(f"{c} int" for c in names))
    parts = whole.withColumns({c: F.col(c).cast("double") for c in names})
    cols = ("symbol", "trade_date", "composite_score", "composite_rank", "institutional_candidate")
    got, want = (sorted(map(tuple, signals.composite(df).select(*cols).collect())) for df in (whole, parts))
    assert got == want
    assert len({r[3] for r in got}) > 10
    assert signals.composite(whole).columns == signals.composite(parts).columns


def test_queries_bring_their_settings(spark):
    """A session built elsewhere would run wide projections uncompiled."""
    other = spark.newSession()
    for key in ASSUMED:
        other.conf.unset(key)
    other.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    Stages(other, "/root/testdata/sf0.001")
    assert {key: other.conf.get(key) for key in ASSUMED} == ASSUMED
