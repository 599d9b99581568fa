"""A user's own per-symbol function."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def per_symbol(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    key: str = "symbol",
    on_error: str = "drop",
) -> DataFrame:
    """Apply fn to each symbol's rows (unordered) as one pandas frame.

    For functions the built-in operators cannot express. Select the columns fn
    needs first: they all travel through Arrow. A symbol whose function fails is
    left out and logged, or fails the job with on_error="raise".
    """
    if on_error not in ("drop", "raise"):
        raise ValueError(f"on_error must be 'drop' or 'raise', not {on_error!r}")

    def guarded(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return fn(pdf)
        except Exception:
            if on_error == "raise":
                raise
            logging.getLogger(__name__).exception("symbol %s left out", pdf[key].iloc[0])
            return pd.DataFrame()

    return df.groupBy(key).applyInPandas(guarded, schema)
