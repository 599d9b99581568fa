"""Fundamentals from tidy scraped facts."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.config import FUNDAMENTAL_FILTERS
from barquet.functions.predicates import b, flag, half_even
from barquet.functions.scalars import cagr, clean_number, eps_accelerating

C = F.col
# Where each figure is found (section, label).
LATEST = {
    "roe": ("top-ratios", "roe"),
    "roce": ("top-ratios", "roce"),
    "pe_ratio": ("top-ratios", "stock p/e"),
    "market_cap_cr": ("top-ratios", "market cap"),
    "opm": ("profit-loss", "opm %"),
    "eps_ttm": ("profit-loss", "eps in rs"),
    "borrowings": ("balance-sheet", "borrowings+"),
    "equity_capital": ("balance-sheet", "equity capital"),
    "reserves": ("balance-sheet", "reserves"),
    "promoter_holding": ("shareholding", "promoter_holding"),
    "promoter_pledge_pct": ("shareholding", "promoter_pledge_pct"),
}
SERIES = {
    "sales": ("profit-loss", "sales+", 4),
    "profit": ("profit-loss", "net profit+", 4),
    "quarterly_eps": ("quarters", "eps in rs", 8),
}
FUNDAMENTAL_COLUMNS = (
    "roe", "roce", "debt_to_equity", "sales_growth_3yr", "profit_growth_3yr", "opm",
    "eps_ttm", "promoter_holding", "promoter_pledge_pct", "market_cap_cr",
    "pe_ratio", "quality_score", "eps_acceleration",
)


def _at(section: str, label: str) -> Column:
    return (C("section") == section) & (C("label") == label)


def parse_facts(facts: DataFrame) -> DataFrame:
    """Facts with their text read as a number, null where there is none."""
    return facts.withColumn("value", clean_number(C("raw_value")))


def last_values(section: str, label: str, n: int) -> Column:
    """Aggregate: the last n readable values of one line, oldest first.

    A line has one value per reporting period of one company.
    """
    rows = F.collect_list(
        F.when(_at(section, label) & C("value").isNotNull(), F.struct("period", "value"))
    )
    values = F.transform(F.sort_array(rows), lambda r: r["value"])
    start = F.greatest(F.size(values) - n, F.lit(0)) + 1
    return F.slice(values, start, n)


def pivot_facts(facts: DataFrame) -> DataFrame:
    """One row per symbol: newest single figures and short histories.

    Repeated facts are reduced first, so a symbol's lists hold one value per
    reporting period however often it was scraped.
    """
    single = [
        F.max_by(
            F.when(_at(s, l), C("value")), F.when(_at(s, l), C("period"))
        ).alias(name)
        for name, (s, l) in LATEST.items()
    ]
    lines = [last_values(s, l, n).alias(name) for name, (s, l, n) in SERIES.items()]
    once = parse_facts(facts).groupBy("symbol", "section", "label", "period").agg(
        F.max("value").alias("value")
    )
    return once.groupBy("symbol").agg(*single, *lines)


def debt_to_equity(borrowings: Column, equity: Column, reserves: Column) -> Column:
    worth = equity + reserves
    return F.when(worth > 0, half_even(F.try_divide(borrowings, worth), 2))


def quality_score(filters: Mapping[str, float] | None = None) -> Column:
    """0-10: one point per passed test; unknown figures fail."""
    t = {**dict(FUNDAMENTAL_FILTERS), **(filters or {})}
    tests = (
        C("roe") >= t["roe_min"],
        C("roce") >= t["roce_min"],
        C("debt_to_equity") <= t["debt_to_equity_max"],
        C("sales_growth_3yr") >= t["sales_growth_min"],
        C("profit_growth_3yr") >= t["profit_growth_min"],
        C("promoter_holding") >= t["promoter_holding_min"],
        C("promoter_pledge_pct") <= t["promoter_pledge_max"],
        C("opm") >= t["opm_min"],
        C("market_cap_cr") >= t["market_cap_min_cr"],
        b(C("eps_acceleration")),
    )
    return sum((flag(x) for x in tests), F.lit(0))


def fundamentals(
    facts: DataFrame, filters: Mapping[str, float] | None = None
) -> DataFrame:
    """Fundamental figures and quality score per symbol."""
    return (
        pivot_facts(facts)
        .withColumns(
            {
                "debt_to_equity": debt_to_equity(
                    C("borrowings"), C("equity_capital"), C("reserves")
                ),
                "sales_growth_3yr": cagr(C("sales"), 3),
                "profit_growth_3yr": cagr(C("profit"), 3),
                "eps_acceleration": eps_accelerating(C("quarterly_eps")),
            }
        )
        .withColumn("quality_score", quality_score(filters))
        .select("symbol", *FUNDAMENTAL_COLUMNS)
    )


def dated(rows: DataFrame, day: date) -> DataFrame:
    """Stamp rows with the day they were collected."""
    return rows.withColumn("trade_date", F.lit(day))


def latest_fundamentals(table: DataFrame) -> DataFrame:
    """Newest row per symbol."""
    rest = [c for c in table.columns if c != "symbol"]
    return table.groupBy("symbol").agg(
        F.max_by(F.struct(*rest), "trade_date").alias("__row")
    ).select("symbol", "__row.*")
