"""Window forms over one series: rolling, exponential, as-of, streaks.

Every per-symbol window uses the same partitioning and ordering, so a chain of
operators shares one exchange and one sort. A panel holds at most one row per
symbol and calendar day (the cleaning step enforces the key with a map-side
partial aggregate), so a window partition is bounded by the calendar - about
36,500 rows for a century of daily bars - no matter how large the panel grows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barquet.functions.predicates import b


# Relative distance below which an average has settled on its input.
SETTLED = 1e-12


def series(key: str = "symbol", order: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def roll(
    agg: Callable[[Column], Column],
    col: Column,
    n: int,
    min_periods: int | None = None,
    shift: int = 0,
    over: WindowSpec | None = None,
) -> Column:
    """Rolling aggregate of n rows ending `shift` rows back.

    Null until the frame holds `min_periods` non-null values (default n).
    """
    frame = (over or series()).rowsBetween(-(n - 1) - shift, -shift)
    need = n if min_periods is None else min_periods
    value = agg(col).over(frame)
    if need <= 1:
        return value
    return F.when(F.count(col).over(frame) >= need, value)


@dataclass(frozen=True)
class Extreme:
    """A rolling maximum or minimum of a column: `n` rows ending `shift` rows back."""

    agg: Callable[[str], Column]
    col: str
    n: int
    min_periods: int
    shift: int = 0


def with_extremes(df: DataFrame, wanted: Mapping[str, Extreme], over: WindowSpec | None = None) -> DataFrame:
    """Add rolling extremes of many rows, equal to `roll`, in two steps.

    A sliding frame visits all its rows for each row. Here frames of about sqrt(n) rows come first,
    and about sqrt(n) of those, which may overlap, make the long one; non-null values are counted by the
    difference of two running counts.
    """
    w = over or series()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first, second = {}, {}

    def back(name: str, rows: int) -> Column:
        return F.lag(name, rows).over(w) if rows else F.col(name)

    for name, e in wanted.items():
        step = math.isqrt(e.n - 1) + 1
        short, seen = f"__short_{name}", f"__seen_{e.col}"
        first[short] = e.agg(e.col).over(w.rowsBetween(-(step - 1), 0))
        first[seen] = F.count(e.col).over(upto)
        starts = sorted({*range(0, e.n - step, step), e.n - step})
        pieces = [back(short, e.shift + k) for k in starts]
        widest = F.greatest if e.agg is F.max else F.least
        value = widest(*pieces) if len(pieces) > 1 else pieces[0]
        inside = F.coalesce(back(seen, e.shift), F.lit(0)) - F.coalesce(back(seen, e.shift + e.n), F.lit(0))
        second[name] = F.when(inside >= e.min_periods, value)
    return df.withColumns(first).withColumns(second).drop(*first)


def lag(col: str | Column, n: int = 1, over: WindowSpec | None = None) -> Column:
    return F.lag(col, n).over(over or series())


def _era_years(spans: Sequence[int]) -> int:
    """Years per block so that decay ** -rows stays inside a double."""
    decay = min((s - 1) / (s + 1) for s in spans)
    rows = 600 / -math.log(decay)
    return max(1, int(rows // 366))


def ema(
    df: DataFrame,
    spans: Sequence[int],
    value: str = "close_price",
    key: str = "symbol",
    order: str = "trade_date",
    prefix: str = "ema_",
    names: Mapping[int, str] | None = None,
    era_years: int | None = None,
) -> DataFrame:
    """Exponential averages seeded with the first value, without Python.

    The recursion e = a*x + (1-a)*e_prev unrolls to a running sum of
    x * decay**-k, scaled back by decay**k. Inside a block of a few calendar
    years the powers fit a double; earlier blocks enter through their end
    values, of which a series has only a handful. Rows with a null value must
    be dropped before. An average within rounding error of the value is the
    value, so a constant series is exactly its own average.
    """
    names = names or {s: f"{prefix}{s}" for s in spans}
    years = era_years or _era_years(spans)
    era = F.floor(F.year(order) / F.lit(years)).cast("int")
    whole = Window.partitionBy(key).orderBy("__era", order)
    block = Window.partitionBy(key, "__era").orderBy(order)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    decay = {s: (s - 1) / (s + 1) for s in spans}

    def local(s: int) -> Column:
        term = F.col(value).cast("double") * F.pow(F.lit(decay[s]), -F.col("__k"))
        return F.pow(F.lit(decay[s]), F.col("__k")) * F.lit(1 - decay[s]) * F.sum(term).over(
            block.rowsBetween(Window.unboundedPreceding, 0)
        )

    def carried(s: int) -> Column:
        total = F.when(F.size("__ends") == 0, F.col("__first")).otherwise(
            F.aggregate(
                "__ends",
                F.col("__first"),
                lambda acc, e: acc * F.pow(F.lit(decay[s]), e["n"]) + e[f"l{s}"],
            )
        )
        return F.col(f"__l{s}") + F.pow(F.lit(decay[s]), F.col("__k") + 1) * total

    def settled(s: int) -> Column:
        x = F.col(value).cast("double")
        near = F.abs(F.col(names[s]) - x) <= F.abs(x) * SETTLED
        return F.when(near, x).otherwise(F.col(names[s]))

    # The window over whole series comes first: rows are then hashed by key alone, which
    # serves the windows of blocks as well.
    staged = (
        df.withColumn("__era", era)
        .withColumn(
            "__first",
            F.first(F.col(value).cast("double")).over(whole.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumns(
            {
                "__k": (F.row_number().over(block) - 1).cast("double"),
                "__last": F.lead(F.lit(1)).over(block).isNull(),
            }
        )
        .withColumns({f"__l{s}": local(s) for s in spans})
    )
    end = F.struct(
        (F.col("__k") + 1).alias("n"), *[F.col(f"__l{s}").alias(f"l{s}") for s in spans]
    )
    staged = staged.withColumns(
        {
            "__ends": F.collect_list(F.when(F.col("__last"), end)).over(before),
        }
    )
    out = staged.withColumns({names[s]: carried(s) for s in spans}).withColumns(
        {names[s]: settled(s) for s in spans}
    )
    return out.drop("__era", "__k", "__first", "__last", "__ends", *[f"__l{s}" for s in spans])


def ema_onward(
    df: DataFrame,
    spans: Sequence[int],
    seeds: Mapping[int, Column],
    value: str = "close_price",
    key: str = "symbol",
    order: str = "trade_date",
    prefix: str = "ema_",
    names: Mapping[int, str] | None = None,
) -> DataFrame:
    """Exponential averages that go on from known ones.

    `seeds` gives the average before a series' first row, on all its rows; where it is null
    the first value starts the average, as in `ema`. Only for short series: a few hundred
    rows keep the powers inside a double.
    """
    names = names or {s: f"{prefix}{s}" for s in spans}
    w = series(key, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    decay = {s: (s - 1) / (s + 1) for s in spans}
    staged = df.withColumns({"__k": (F.row_number().over(w) - 1).cast("double"), "__first": F.first(x).over(upto)})
    staged = staged.withColumns(
        {f"__l{s}": F.sum(x * F.pow(F.lit(decay[s]), -F.col("__k"))).over(upto) for s in spans}
    )

    def average(s: int) -> Column:
        d = F.lit(decay[s])
        e = F.pow(d, F.col("__k")) * F.lit(1 - decay[s]) * F.col(f"__l{s}") + F.pow(d, F.col("__k") + 1) * F.coalesce(
            seeds[s], F.col("__first")
        )
        return F.when(F.abs(e - x) <= F.abs(x) * SETTLED, x).otherwise(e)

    return staged.withColumns({names[s]: average(s) for s in spans}).drop("__k", "__first", *[f"__l{s}" for s in spans])


def asof_backward(
    days: DataFrame,
    bars: Mapping[str, tuple[DataFrame, str]],
    key: str = "symbol",
    order: str = "trade_date",
) -> DataFrame:
    """Give each day the latest bar ending on or before it, per bar table.

    `bars` maps a result column to (bars, end-date column); the remaining bar
    columns come back as one struct, so a null inside the newest bar is not
    replaced by an older bar's value. All tables ride one union, one exchange
    and one sort; no range join is planned.
    """
    payload = {
        name: F.struct(*[c for c in frame.columns if c not in (key, end)])
        for name, (frame, end) in bars.items()
    }
    day_row = F.struct(*[c for c in days.columns if c not in (key, order)])
    tagged = days.select(
        key, F.col(order), F.lit(1).alias("__kind"), day_row.alias("__day"),
    )
    for name, (frame, end) in bars.items():
        tagged = tagged.unionByName(
            frame.select(
                key, F.col(end).alias(order), F.lit(0).alias("__kind"),
                payload[name].alias(name),
            ),
            allowMissingColumns=True,
        )
    upto = (
        Window.partitionBy(key).orderBy(order, "__kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = tagged.withColumns(
        {name: F.last(name, ignorenulls=True).over(upto) for name in bars}
    ).filter(F.col("__kind") == 1)
    return seen.select(key, order, "__day.*", *bars)


def resample_last(
    df: DataFrame,
    label: Column,
    name: str,
    value: str = "close_price",
    key: str = "symbol",
    order: str = "trade_date",
) -> DataFrame:
    """Last value per key and period label; empty periods give no row.

    The last row of a period is the one whose successor has another label: a window by
    key, like all windows around it, instead of a grouping with a shuffle of its own.
    """
    following = F.lead(name).over(series(key, order))
    return (
        df.withColumn(name, label).withColumn("__next", following)
        .filter(F.col("__next").isNull() | (F.col("__next") != F.col(name)))
        .select(key, name, value)
    )


def week_label(day: str = "trade_date") -> Column:
    """The Friday closing the week of a day (a Friday labels itself)."""
    return F.next_day(F.date_sub(F.col(day), 1), "FRI")


def month_label(day: str = "trade_date") -> Column:
    return F.last_day(F.col(day))


def streak_inputs(key: str = "symbol", order: str = "trade_date") -> dict[str, Column]:
    """Columns a streak needs that do not depend on what is tested."""
    w = series(key, order)
    return {
        "__pos": F.row_number().over(w),
        "__next": F.lead(order).over(w),
        "__start": F.first(order).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }


def last_off(active: Column, key: str = "symbol", order: str = "trade_date") -> Column:
    """Position of the latest row that failed the test, and the date after it."""
    upto = series(key, order).rowsBetween(Window.unboundedPreceding, 0)
    off = F.when(~b(active), F.struct(F.col("__pos").alias("p"), F.col("__next").alias("d")))
    return F.last(off, ignorenulls=True).over(upto)


def streak(
    df: DataFrame, active: Column, days: str, started: str,
    key: str = "symbol", order: str = "trade_date",
) -> DataFrame:
    """Length and first date of the current run of true rows.

    The run starts after the latest false row, whose position is carried
    forward: no second sort by run id is needed. Inputs already present
    (streak_inputs, and last_off as `__off`) are used as they are.
    """
    have = set(df.columns)
    df = df.withColumns({n: c for n, c in streak_inputs(key, order).items() if n not in have})
    if "__off" not in have:
        df = df.withColumn("__off", last_off(active, key, order))
    on = b(active)
    return df.withColumns(
        {
            days: F.when(on, F.col("__pos") - F.coalesce("__off.p", F.lit(0)))
            .otherwise(F.lit(0)).cast("int"),
            started: F.when(on, F.coalesce("__off.d", "__start")),
        }
    ).drop("__pos", "__next", "__start", "__off")
