"""Screens: condition lists, presets, ranking and derived labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, PRESETS, SCREEN_FIELDS, VALUE_WORDS
from barquet.functions.predicates import all_of, b, flag, half_even, larger
from barquet.operators.signals import weighted_score

C = F.col
R = DEFAULTS.screen


# ------------------------------------------------------------------ conditions
@dataclass(frozen=True)
class Test:
    """field op value; the field is a display name or a column."""

    field: str
    op: str
    value: float | str
    logic: str = "AND"


@dataclass(frozen=True)
class AnyOf:
    """Tests of which one must hold."""

    tests: tuple[Test, ...]
    logic: str = "AND"


def between(field: str, low: float, high: float, logic: str = "AND") -> tuple[Test, Test]:
    return Test(field, ">=", low, logic), Test(field, "<=", high, "AND")


_COMPARE = {
    "=": lambda c, v: c == v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
}


def _value(raw: float | str) -> float:
    if isinstance(raw, str):
        word = raw.strip().lower()
        return VALUE_WORDS[word] if word in VALUE_WORDS else float(raw)
    return float(raw)


# Another name of a field.
_ALIASES = {"stage 2": "Stage2"}


def resolve_field(field: str, columns: Sequence[str]) -> str | None:
    """Column of a display or column name in any case; None for a known display
    name whose column is absent. Other names raise ValueError."""
    word = field.strip().lower()
    shown = {k.lower(): v for k, v in SCREEN_FIELDS.items()}
    for alias, target in _ALIASES.items():
        if target in SCREEN_FIELDS:
            shown.setdefault(alias, SCREEN_FIELDS[target])
    own = {c.lower(): c for c in columns}
    if word in shown:
        return own.get(shown[word].lower())
    if word in own:
        return own[word]
    raise ValueError(f"unknown screen field {field!r}")


def _predicate(test: Test, columns: Sequence[str]) -> Column:
    if test.op not in _COMPARE:
        raise ValueError(f"unknown operator {test.op!r}")
    name = resolve_field(test.field, columns)
    if name is None:
        return F.lit(True)
    return b(_COMPARE[test.op](C(f"`{name}`").cast("double"), F.lit(_value(test.value))))


def screen_condition(conditions: Sequence[Test | AnyOf], columns: Sequence[str]) -> Column:
    """One predicate, folded left to right without precedence.

    A OR B AND C means (A OR B) AND C. Names match in any case; an unknown field or
    operator raises ValueError, a known field whose column is absent holds, nulls fail.
    """
    def step(mask: Column, cond: Test | AnyOf) -> Column:
        tests = cond.tests if isinstance(cond, AnyOf) else (cond,)
        row = reduce(lambda x, y: x | y, [_predicate(t, columns) for t in tests])
        return mask | row if cond.logic == "OR" else mask & row

    return reduce(step, conditions, F.lit(True))


def screen(df: DataFrame, conditions: Sequence[Test | AnyOf]) -> DataFrame:
    return df.filter(screen_condition(conditions, df.columns)) if conditions else df


@dataclass(frozen=True)
class NamedScreen:
    """A stored screen: conditions and the field it is ordered by."""

    conditions: tuple[Test | AnyOf, ...]
    order_by: str = "Score"
    ascending: bool = False


def _on(*fields: str) -> tuple[Test, ...]:
    return tuple(Test(f, "=", 1) for f in fields)


_ANY_TRIGGER = AnyOf(_on("VCP", "Breakout", "BO Ready"))

# Quick screens.
QUICK_SCREENS = {
    "Weinstein": NamedScreen(
        (*_on("IC", "Trend", "Stage2"), Test("S2 Age(d)", "<=", 5), *_on("Liquid", "Quality")),
        "S2 Age(d)", True,
    ),
    "VCP Watch": NamedScreen(_on("Trend", "Stage2", "VCP", "Liquid")),
    "Breakout": NamedScreen(_on("Breakout", "Liquid")),
    "RS Leaders": NamedScreen(_on("Trend", "Stage2", "RS", "Liquid")),
    "Minervini A+": NamedScreen(
        (*_on("IC", "Trend", "Stage2", "RS", "Liquid", "Quality"), _ANY_TRIGGER)
    ),
}

# Sample screens: conditions and order are fixed values, the names are short ones of this library.
SAMPLE_SCREENS = {
    "Fresh Stage 2 + RS leaders": NamedScreen(
        (*_on("Stage2"), *between("S2 Age(d)", 1, 15), *_on("RS", "Liquid")), "S2 Age(d)", True
    ),
    "IC candidates near pivot": NamedScreen(
        (*_on("IC"), Test("Dist Pivot%", "<=", 2), *_on("Liquid")), "Dist Pivot%", True
    ),
    "Quality compounders": NamedScreen(
        (*_on("Quality"), Test("ROE%", ">=", 20), Test("ROCE%", ">=", 15),
         Test("Promoter%", ">=", 40), *_on("Trend")), "ROE%",
    ),
    "Fresh breakouts near 52-week high": NamedScreen(
        (*_on("Breakout"), Test("Dist 52w%", ">=", -3), *_on("Liquid")), "Dist Pivot%", True
    ),
    "VCP coiling": NamedScreen((*_on("VCP", "Stage2", "Trend"), Test("Score", ">=", 70))),
    "BO Ready + promoter conviction": NamedScreen(
        (*_on("BO Ready"), Test("Promoter%", ">=", 50), *_on("Quality"))
    ),
    "Strong fundamentals in Stage 2": NamedScreen(
        (*_on("Stage2"), Test("Fund Score", ">=", 7), Test("ROE%", ">=", 15), *_on("Liquid")),
        "Fund Score",
    ),
    "Multi-signal entry": NamedScreen((*_on("IC", "Trend", "Stage2", "RS"), _ANY_TRIGGER)),
    "Mid Stage 2 sweet spot": NamedScreen(
        (*_on("Stage2"), *between("S2 Age(d)", 10, 30), *_on("Liquid", "RS"))
    ),
    "Deep pullback base builders": NamedScreen(
        (*_on("IC"), *between("Dist 52w%", -25, -15), *_on("Liquid", "Quality")), "Dist 52w%"
    ),
    "Promoter-backed RS leaders": NamedScreen(
        (*_on("RS"), Test("Promoter%", ">=", 60), *_on("Liquid", "Trend")), "Promoter%"
    ),
    "Top score": NamedScreen(
        (Test("Score", ">=", 80), Test("Liquid", "=", "tick"), Test("Quality", "=", "tick"),
         Test("RS", "=", "tick"))
    ),
}


# ------------------------------------------------------------------ ranking
def best_first() -> list[Column]:
    """Report order: expected value (missing last), score, symbol."""
    return [
        F.col("ev_score").desc_nulls_last(), F.desc("composite_score"), F.asc("symbol")
    ]


def reweight(df: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """Score, dense rank and candidate flag under other weights.

    Absent columns and zero weights are skipped. Scores have one decimal between
    0 and 100, so the rank comes from the at most 1,001 distinct scores, which
    are ranked alone and broadcast back; the rows are never sorted as a whole.
    """
    used = {s: w for s, w in weights.items() if w > 0 and s in df.columns}
    if not used:
        return df
    scored = df.withColumn("composite_score", weighted_score(used, 1))
    levels = scored.select("composite_score").distinct().withColumn(
        "__rank",
        F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("composite_score"))),
    )
    rest = [c for c in df.columns if c not in ("composite_rank", "institutional_candidate")]
    return scored.join(F.broadcast(levels), "composite_score").select(
        *rest, C("__rank").alias("composite_rank"),
        flag(C("composite_score") >= 70).alias("institutional_candidate"),
    )


def ranked(
    df: DataFrame, preset: str | None = None, min_score: float = 0.0, top_n: int = R.top_n,
    presets: Mapping[str, Mapping[str, int]] = PRESETS,
) -> DataFrame:
    """The top rows of a preset's ranking; the default keeps the stored scores."""
    default = next(iter(presets))
    if preset is not None and preset != default:
        df = reweight(df, presets.get(preset, {}))
    return df.filter(C("composite_score") >= min_score).orderBy(*best_first()).limit(top_n)


def ranked_by_each(
    df: DataFrame, min_score: float = 0.0, top_n: int = R.top_n,
    presets: Mapping[str, Mapping[str, int]] = PRESETS,
) -> DataFrame:
    """The top rows of every preset's ranking in one job.

    Each row is scored under all presets at once; ranks come from the distinct
    scores of each preset, and the per-preset cut is taken before the shuffle.
    """
    default = next(iter(presets))

    def scored(name: str) -> Column:
        used = {s: w for s, w in presets[name].items() if w > 0 and s in df.columns}
        keep = name == default or not used
        return F.struct(
            F.lit(name).alias("preset"),
            (C("composite_score") if keep else weighted_score(used, 1)).alias("score"),
            (C("composite_rank") if keep else F.lit(None).cast("double")).alias("stored_rank"),
        )

    tall = df.select(
        "symbol", "ev_score", F.explode(F.array(*[scored(n) for n in presets])).alias("e")
    ).select("symbol", "ev_score", "e.*")
    by_score = Window.partitionBy("preset").orderBy(F.desc("score"))
    levels = tall.select("preset", "score").distinct().withColumn(
        "level", F.dense_rank().over(by_score).cast("double")
    )
    best = Window.partitionBy("preset").orderBy(
        C("ev_score").desc_nulls_last(), F.desc("score"), "symbol"
    )
    top = (
        tall.filter(C("score") >= min_score)
        .withColumn("position", F.row_number().over(best))
        .filter(C("position") <= top_n)
    )
    return top.join(levels, ["preset", "score"]).select(
        "preset", "position", "symbol", "score",
        F.coalesce("stored_rank", "level").alias("rank"),
        flag(C("score") >= 70).alias("candidate"), "ev_score",
    )


def two_tier_sort(df: DataFrame, order_by: str = "Score", ascending: bool = False) -> DataFrame:
    """Rows whose sort value reaches 50 by expected value, the others by sort value.

    An unknown sort field falls back to Score. The threshold applies to the chosen sort column, whatever it is. Expected
    values of the second tier are blanked.
    """
    try:
        name = resolve_field(order_by, df.columns)
    except ValueError:
        name = None
    if name is None:
        name = SCREEN_FIELDS["Score"]
    if name not in df.columns:
        return df
    value, ev = C(f"`{name}`").cast("double"), C("ev_score")
    by_value = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    if name == "ev_score" or "ev_score" not in df.columns:
        return df.orderBy(by_value, "symbol")
    first = F.coalesce(value, F.lit(0.0)) >= R.tier_threshold
    return (
        df.withColumn("tier", F.when(first, 1).otherwise(2))
        .orderBy(
            "tier", F.when(first, ev).desc_nulls_last(), by_value,
            ev.desc_nulls_last(), "symbol",
        )
        .withColumn("ev_score", F.when(C("tier") == 1, ev))
    )


# ------------------------------------------------------------------ labels
def trend_health(df: DataFrame) -> DataFrame:
    """ROCKET, STRONG, TREND, COOL or EXIT."""
    on = lambda c: F.coalesce(C(c).cast("int"), F.lit(0))
    trend, rs = on("trend_signal") == 1, on("rs_signal") == 1
    high, frames = on("rs_new_high") == 1, on("mtf_score")
    return df.withColumn(
        "trend_health",
        F.when(all_of(trend, frames == 2, high, rs), "ROCKET")
        .when(all_of(trend, frames == 2, rs), "STRONG")
        .when(all_of(trend, frames >= 1), "TREND")
        .when(trend, "COOL").otherwise("EXIT"),
    )


def safe_exit(df: DataFrame) -> DataFrame:
    """Price at which leaving loses nothing: the higher of pivot and stop."""
    return df.withColumn(
        "safe_exit_price",
        half_even(larger(C("pivot_price"), C("trailing_stop_price")), 2),
    )


def screen_totals(df: DataFrame) -> DataFrame:
    """Rows shown and how many carry each headline signal."""
    cols = ("institutional_candidate", "vcp_signal", "breakout_signal", "breakout_ready_signal")
    return df.agg(
        F.count("*").alias("rows_shown"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols],
    )


def all_signals_off(signals: DataFrame) -> DataFrame:
    """Per date: has every directional signal been switched off?"""
    cols = ("trend_signal", "stage2_signal", "vcp_signal", "breakout_signal")
    return signals.groupBy("trade_date").agg(
        F.sum(sum((C(c) for c in cols), F.lit(0))).alias("active_signals")
    ).withColumn("all_off", C("active_signals") == 0)
