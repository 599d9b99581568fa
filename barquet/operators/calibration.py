"""Empirical hit rates of price targets and their use as confidences."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.config import DEFAULTS, UNKNOWN_REGIME
from barquet.functions.predicates import half_even
from barquet.functions.scalars import score_bucket
from barquet.session import materialize
from barquet.sources.snapshots import Transaction

C = F.col
R = DEFAULTS.targets
HORIZONS = (("t1", R.hold_days_t1), ("t2", R.hold_days_t2), ("t3", R.hold_days_t3))


def forward_highs(bars: DataFrame) -> DataFrame:
    """Highest high within the next N calendar days of every bar, per horizon.

    A range frame over the day number answers all horizons in one sorted pass
    per symbol; no bar is paired with its followers.
    """
    w = Window.partitionBy("symbol").orderBy("__day")
    days = bars.select(
        "symbol", "trade_date", "high_price", F.unix_date("trade_date").alias("__day")
    )
    return days.withColumns(
        {f"high_{t}": F.max("high_price").over(w.rangeBetween(1, n)) for t, n in HORIZONS}
    ).drop("__day", "high_price")


def calibration_entries(signals: DataFrame, as_of: date, after: date | None = None) -> DataFrame:
    """Set-ups old enough for the longest horizon to have passed; with `after`, those alone
    whose horizon was still open on that day."""
    fallback = C("pivot_price") + C("pivot_price") * C("base_range_pct") / 100.0 * R.t3
    rows = signals.filter(C("trade_date") <= F.date_sub(F.lit(as_of), R.hold_days_t2))
    if after is not None:
        rows = rows.filter(C("trade_date") > F.date_sub(F.lit(after), R.hold_days_t2))
    return rows.filter(
        ((C("breakout_signal") == 1) | (C("breakout_ready_signal") == 1))
        & C("target_1_price").isNotNull() & C("target_2_price").isNotNull()
        & C("pivot_price").isNotNull()
    ).select(
        "symbol", "trade_date", "target_1_price", "target_2_price",
        F.coalesce("target_3_price", fallback).alias("target_3_price"),
        score_bucket(C("composite_score")).alias("score_bucket"),
    )


def target_hits(entries: DataFrame, highs: DataFrame) -> DataFrame:
    """0/1 per horizon: was the target reached in time?"""
    hit = lambda n: F.coalesce(
        (C(f"high_t{n}") >= C(f"target_{n}_price")).cast("int"), F.lit(0)
    )
    return entries.join(highs, ["symbol", "trade_date"], "left").withColumns(
        {f"hit_t{n}": hit(n) for n in (1, 2, 3)}
    )


def confidence_counts(
    signals: DataFrame, bars: DataFrame, environment: DataFrame, as_of: date, after: date | None = None
) -> DataFrame:
    """Set-ups and their hits by score bucket, market regime and the day their horizon closes
    (`trade_date`).

    The rows of different closing days add up, so a table of them grows by the days since `after`
    alone; then only set-ups that closed since and the bars in their reach are read.
    """
    if after is not None:
        bars = bars.filter(
            (C("trade_date") > F.date_sub(F.lit(after), R.hold_days_t2)) & (C("trade_date") <= F.lit(as_of))
        )
    hits = target_hits(calibration_entries(signals, as_of, after), forward_highs(bars))
    regimes = environment.select("trade_date", C("market_state").alias("market_regime"))
    closes = F.date_add("trade_date", R.hold_days_t2)
    return (
        hits.join(regimes, "trade_date", "left")
        .withColumn("market_regime", F.coalesce("market_regime", F.lit(UNKNOWN_REGIME)))
        .groupBy("score_bucket", "market_regime", closes.alias("closes"))
        .agg(F.count("*").alias("n"), *[F.sum(f"hit_{t}").alias(f"hits_{t}") for t, _ in HORIZONS])
        .withColumnRenamed("closes", "trade_date")
    )


def confidence_rates(counts: DataFrame) -> DataFrame:
    """Hit rates by score bucket and market regime, thin cells left out."""
    total = F.sum("n")
    rates = {t: half_even(F.sum(f"hits_{t}") / total * 100, 1).alias(f"hit_rate_{t}") for t, _ in HORIZONS}
    return (
        counts.groupBy("score_bucket", "market_regime")
        .agg(total.alias("sample_count"), *rates.values())
        .filter(C("sample_count") >= R.min_samples)
    )


def confidence_model(
    signals: DataFrame, bars: DataFrame, environment: DataFrame, as_of: date
) -> DataFrame:
    """Hit rates from all history at once."""
    return confidence_rates(confidence_counts(signals, bars, environment, as_of))


def extend_counts(
    t: Transaction, name: str, signals: DataFrame, bars: DataFrame, environment: DataFrame, as_of: date
) -> int:
    """Bring a stored table of counts up to `as_of`; returns the number of its days added.

    What the table holds is kept; set-ups close in order of their days, so nothing is counted twice.
    A day that was already reached adds nothing.
    """
    reached = t.read(f"{name}_reached").first()[0] if f"{name}_reached" in t else None
    if reached is not None and reached >= as_of:
        return 0
    new = materialize(confidence_counts(signals, bars, environment, as_of, reached), "counts")
    t.append(new, name)
    t.rebuild(new.sparkSession.createDataFrame([(as_of,)], "as_of date"), f"{name}_reached")
    return new.select("trade_date").distinct().count()


def apply_confidence(signals_on_day: DataFrame, model: DataFrame, regime: str | None) -> DataFrame:
    """Confidences of one day's signals.

    Looked up by bucket and regime, then by bucket and UNKNOWN, else derived
    from the probability column. The model has at most four buckets times the
    number of market states, so both sides are broadcast.
    """
    names = [f"hit_rate_{t}" for t, _ in HORIZONS]

    def cells(name: str, alias: str) -> DataFrame:
        return F.broadcast(
            model.filter(C("market_regime") == name).select(
                "score_bucket", F.struct(*names).alias(alias)
            )
        )

    rows = signals_on_day.filter(C("target_1_price").isNotNull()).withColumn(
        "score_bucket", score_bucket(C("composite_score"))
    )
    rows = rows.join(cells(regime or UNKNOWN_REGIME, "__exact"), "score_bucket", "left").join(
        cells(UNKNOWN_REGIME, "__any"), "score_bucket", "left"
    )
    prob = F.coalesce("upside_prob_pct", F.lit(R.base_prob))
    derived = (
        F.least(prob * 1.5, F.lit(95.0)), prob, F.least(prob * 2.0, F.lit(99.0))
    )

    def confidence(i: int) -> Column:
        name = names[i]
        return half_even(
            F.coalesce(C(f"__exact.{name}"), C(f"__any.{name}"), derived[i]), 1
        )

    return rows.withColumns({f"confidence_t{i + 1}": confidence(i) for i in range(3)}).drop(
        "__exact", "__any"
    )
