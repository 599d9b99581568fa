"""Price targets, position stage, stops and expected value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.config import DEFAULTS
from barquet.functions.predicates import b, clip, flag, half_even, larger, ratio

C = F.col
R = DEFAULTS.targets


def price_targets(df: DataFrame) -> DataFrame:
    """Pivot plus a share of the base's height, in price and percent."""
    staged = df.withColumn("__p", F.nullif("pivot_price", F.lit(0.0))).withColumn(
        "__range", clip(C("__p") - C("base_low_price"), 0.0)
    )
    multiples = {1: R.t1, 2: R.t2, 3: R.t3}
    staged = staged.withColumns(
        {f"__t{n}": C("__p") + C("__range") * F.lit(m) for n, m in multiples.items()}
    )
    out = {"base_range_pct": half_even(ratio(C("__range"), C("__p")) * 100, 2)}
    for n in multiples:
        price = C(f"__t{n}")
        out[f"target_{n}_price"] = half_even(price, 2)
        out[f"target_{n}_pct"] = half_even((ratio(price, C("close_price")) - 1) * 100, 2)
    return staged.withColumns(out)


def position_stage(df: DataFrame) -> DataFrame:
    """Where the close stands between pivot and targets."""
    close, t1, t2 = C("close_price"), C("__t1"), C("__t2")
    stage = (
        F.when(b(close > t2), "PAST_T2")
        .when(b(close > t1), "PAST_T1")
        .when(b((close >= t1 * R.near_t1) & (close <= t1)), "NEAR_T1")
        .when(b((close >= C("__p")) & (close < t1 * R.near_t1)), "ACTIVE")
        .otherwise("IN_BASE")
    )
    return df.withColumn("position_stage", F.when(C("__p").isNotNull(), stage))


def trailing_stop(df: DataFrame) -> DataFrame:
    """Higher of the stage's stop and the range support.

    A stage whose price tests all fail (no test can hold with a missing target)
    has no stop; in the base and up to the first target the stop sits under the
    pivot, beyond a target just under that target.
    """
    close, t1, t2 = C("close_price"), C("__t1"), C("__t2")
    support = clip(close - F.coalesce(C("atr_14"), F.lit(0.0)) * R.atr_multiple, 0.0)
    under_pivot = half_even(C("__p") * (1 - R.stop_loss), 2)
    level = (
        F.when(b(close > t2), half_even(t2 * R.stop_below_target, 2))
        .when(b(close > t1), half_even(t1 * R.stop_below_target, 2))
        .when(
            b((close >= t1 * R.near_t1) & (close <= t1))
            | b((close >= C("__p")) & (close < t1 * R.near_t1)) | b(close < C("__p")),
            under_pivot,
        )
    )
    return df.withColumn(
        "trailing_stop_price",
        F.when(C("__p").isNotNull(), half_even(larger(level, support), 2)),
    )


def upside(df: DataFrame) -> DataFrame:
    """Reward to risk, probability of the second target and expected value."""
    stop = R.stop_loss * 100
    age = F.coalesce(C("stage2_days"), F.lit(0))
    points = (
        (C("breakout_signal") >= 1, R.prob_breakout),
        (C("minervini_signal") >= 1, R.prob_minervini),
        (C("rs_new_high") >= 1, R.prob_rs_new_high),
        (C("darvas_signal") >= 1, R.prob_darvas),
        (C("composite_score") >= R.high_score, R.prob_high_score),
        ((age > 0) & (age <= R.fresh_days), R.prob_fresh_stage2),
        (age > R.late_days, R.prob_late_stage2),
    )
    raw = sum((flag(t) * F.lit(p) for t, p in points), F.lit(R.base_prob))
    prob = half_even(clip(raw, R.min_prob, R.max_prob), 1)
    staged = df.withColumn("__prob", prob)
    share = C("__prob") / 100
    value = share * C("target_2_pct") - (F.lit(1.0) - share) * F.lit(stop)
    return staged.withColumns(
        {
            "risk_reward_t2": half_even(C("target_2_pct") / F.lit(stop), 2),
            "upside_prob_pct": F.when(C("__p").isNotNull(), C("__prob")),
            "ev_score": half_even(value, 2),
        }
    ).drop("__prob")


def targets(df: DataFrame) -> DataFrame:
    return (
        df.transform(price_targets).transform(position_stage)
        .transform(trailing_stop).transform(upside).drop("__p", "__range", "__t1", "__t2", "__t3")
    )
