"""Scalar and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, SYMBOL_SUFFIX
from barquet.functions.predicates import half_even, ratio

# Marks removed from, and markers meaning "no value" in, scraped numbers.
NUMBER_NOISE = "[,₹%\u00a0]|Cr"
NUMBER_FORM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NO_VALUE = ("", "--", "-", "N/A", "NA")


def with_suffix(symbol: Column) -> Column:
    """Exchange-suffixed form of a symbol."""
    return F.when(
        F.upper(symbol).endswith(SYMBOL_SUFFIX), symbol
    ).otherwise(F.concat(symbol, F.lit(SYMBOL_SUFFIX)))


def bare_symbol(symbol: Column) -> Column:
    """Symbol without the exchange suffix."""
    return F.regexp_replace(symbol, SYMBOL_SUFFIX.replace(".", "\\.") + "$", "")


def clean_number(text: Column) -> Column:
    """Number in scraped text, null when there is none."""
    bare = F.trim(F.regexp_replace(text, NUMBER_NOISE, ""))
    return F.when(
        ~bare.isin(*NO_VALUE) & bare.rlike(NUMBER_FORM), bare
    ).try_cast("double")


def score_bucket(score: Column) -> Column:
    """Composite score band: 70, 50, 30 or 0."""
    return (
        F.when(score >= 70, F.lit(70)).when(score >= 50, F.lit(50))
        .when(score >= 30, F.lit(30)).otherwise(F.lit(0))
    )


def age_band(days: Column) -> Column:
    """Name of a Stage 2 streak's age; null outside a streak."""
    r = DEFAULTS.signals
    return (
        F.when(days <= 0, F.lit(None).cast("string"))
        .when(days <= r.stage2_early_days, F.lit("Early"))
        .when(days <= r.stage2_mid_days, F.lit("Mid"))
        .when(days.isNotNull(), F.lit("Advanced"))
    )


def from_end(values: Column, n: int) -> Column:
    """n-th value from the end (1 = last), null when too short."""
    return F.when(F.size(values) >= n, F.try_element_at(values, F.lit(-n)))


def cagr(values: Column, years: int) -> Column:
    """Compound yearly growth in percent over the last `years` steps."""
    end, start = from_end(values, 1), from_end(values, years + 1)
    growth = (F.pow(ratio(end, start), F.lit(1.0 / years)) - 1) * 100
    return F.when((start > 0) & (end > 0), half_even(growth, 2))


def eps_accelerating(values: Column) -> Column:
    """Whether the last three year-on-year growth rates rise strictly.

    Needs eight quarters; null when short or when a compared prior-year
    quarter is not positive.
    """
    def growth(back: int) -> Column:
        now, prior = from_end(values, back), from_end(values, back + 4)
        return F.when(prior > 0, (ratio(now, prior) - 1) * 100)

    first, second, third = growth(3), growth(2), growth(1)
    known = first.isNotNull() & second.isNotNull() & third.isNotNull()
    return F.when(
        (F.size(values) >= 8) & known, (first < second) & (second < third)
    )


def option_label(name: Column, symbol: Column) -> Column:
    """Search-list label 'Name  (SYMBOL)'."""
    return F.concat(name, F.lit("  ("), symbol, F.lit(")"))


def symbol_of_label(label: Column) -> Column:
    """Inverse of option_label; names may contain parentheses."""
    return F.regexp_extract(label, r"\(?([^(]*?)\)*$", 1)
