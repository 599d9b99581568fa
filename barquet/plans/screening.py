"""A screen from stored tables to the ordered, labelled result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barquet.config import DEFAULTS
from barquet.operators import screen as s


def run_screen(
    scanner: DataFrame, named: s.NamedScreen | None = None, preset: str | None = None,
    min_score: float = 0.0, top_n: int = DEFAULTS.screen.top_n,
) -> DataFrame:
    """Rank by preset, keep the top rows, label them, then filter and sort.

    Conditions see only the top rows: the ranking comes first.
    """
    top = s.ranked(scanner, preset, min_score, top_n)
    labelled = top.transform(s.safe_exit).transform(s.trend_health)
    if named is None:
        return labelled
    return s.two_tier_sort(
        s.screen(labelled, named.conditions), named.order_by, named.ascending
    )
