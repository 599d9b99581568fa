"""Symbol universe and index membership upkeep."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.functions.predicates import b
from barquet.functions.scalars import with_suffix

C = F.col
METADATA = ("company_name", "sector", "isin")


def merge_listings(listings: Sequence[DataFrame]) -> DataFrame:
    """First known metadata per symbol over listings in order of preference."""
    tagged = [
        rows.select("symbol", *METADATA, F.lit(rank).alias("rank"))
        for rank, rows in enumerate(listings)
    ]
    merged = tagged[0]
    for rows in tagged[1:]:
        merged = merged.unionByName(rows)
    return merged.groupBy("symbol").agg(
        *[
            F.min_by(C(c), F.when(C(c).isNotNull(), C("rank"))).alias(c)
            for c in METADATA
        ]
    )


def sync_universe(stored: DataFrame, merged: DataFrame, today: date) -> DataFrame:
    """Universe after a download: new symbols added, seen ones refreshed."""
    fresh = merged.select("symbol", *[C(c).alias(f"__{c}") for c in METADATA],
                          F.lit(True).alias("__seen"))
    out = stored.withColumn("__had", F.lit(True)).join(fresh, "symbol", "full_outer")
    seen = b(C("__seen"))
    return out.select(
        "symbol",
        *[F.when(seen, F.nullif(C(f"__{c}"), F.lit(""))).otherwise(C(c)).alias(c)
          for c in METADATA],
        F.when(seen, True).otherwise(C("is_active")).alias("is_active"),
        F.when(b(C("__had")), C("first_seen")).otherwise(F.lit(today)).alias("first_seen"),
        F.when(seen, F.lit(today)).otherwise(C("last_seen")).alias("last_seen"),
    )


def sync_membership(
    stored: DataFrame, downloaded: DataFrame, today: date
) -> DataFrame:
    """Membership after a download of some indices.

    `downloaded`: symbol, index_code. Present pairs become current; absent pairs
    of a downloaded index are closed today; other indices are left alone.
    """
    pairs = downloaded.select("symbol", "index_code").distinct().withColumn(
        "__present", F.lit(True)
    )
    indices = downloaded.select("index_code").distinct().withColumn("__covered", F.lit(True))
    out = (
        stored.withColumn("__had", F.lit(True))
        .join(pairs, ["symbol", "index_code"], "full_outer")
        .join(indices, "index_code", "left")
    )
    present = b(C("__present"))
    gone = ~present & b(C("__covered"))
    return out.select(
        "symbol", "index_code",
        F.when(present, True).when(gone, False).otherwise(C("is_current_member"))
        .alias("is_current_member"),
        F.when(b(C("__had")), C("first_added_date")).otherwise(F.lit(today))
        .alias("first_added_date"),
        F.when(present, F.lit(None).cast("date")).when(gone, F.lit(today))
        .otherwise(C("last_removed_date")).alias("last_removed_date"),
    )


def current_members(rows: DataFrame, membership: DataFrame, index_code: str) -> DataFrame:
    """Rows of symbols currently in an index."""
    members = membership.filter(
        (C("index_code") == index_code) & b(C("is_current_member"))
    ).select(with_suffix(C("symbol")).alias("symbol"))
    return rows.join(members, "symbol", "left_semi")


def populated_indices(index_ref: DataFrame, membership: DataFrame) -> DataFrame:
    """Active indices with at least one current member."""
    current = membership.filter(b(C("is_current_member"))).select("index_code")
    return (
        index_ref.filter(b(C("is_active"))).join(current, "index_code", "left_semi")
        .select("index_code", "index_name")
    )


# ------------------------------------------------------------------ what is missing
def new_symbols(symbols: DataFrame, prices: DataFrame) -> DataFrame:
    """Symbols without a single price row."""
    return symbols.select("symbol").join(prices.select("symbol"), "symbol", "left_anti")


def first_missing_session(
    symbols: DataFrame, prices: DataFrame, calendar: DataFrame
) -> DataFrame:
    """Earliest missing session per symbol within a recent calendar.

    `calendar`: trade_date, session_no (1..n), a bounded number of sessions. The
    missing position is found by arithmetic on the positions present instead of
    forming every symbol-session pair: the first position that the sorted
    positions skip. Symbols with no row at all miss the first session.
    """
    present = (
        prices.select("symbol", "trade_date").join(calendar, "trade_date")
        .groupBy("symbol").agg(F.collect_set("session_no").alias("__seen"))
    )
    last = calendar.agg(F.coalesce(F.max("session_no"), F.lit(0)).alias("__last"))  # one row
    gaps = (
        symbols.select("symbol").join(present, "symbol", "left").crossJoin(F.broadcast(last))
        .withColumn(
            "session_no",
            F.array_min(
                F.array_except(
                    F.when(C("__last") > 0, F.sequence(F.lit(1), C("__last")))
                    .otherwise(F.array().cast("array<int>")),
                    F.coalesce(C("__seen"), F.array().cast("array<int>")),
                )
            ),
        )
        .filter(C("session_no").isNotNull())
    )
    return gaps.join(calendar, "session_no").select(
        "symbol", C("trade_date").alias("first_missing")
    )


def stale_fundamentals(
    universe: DataFrame, fundamentals: DataFrame, as_of: date, max_age_days: int = 30
) -> DataFrame:
    """Active symbols without a recent fundamentals row."""
    recent = fundamentals.filter(
        C("trade_date") >= F.date_sub(F.lit(as_of), max_age_days)
    ).select("symbol")
    return (
        universe.filter(b(C("is_active"))).select("symbol")
        .join(recent, "symbol", "left_anti")
    )


def stale_earnings(
    symbols: DataFrame, earnings: DataFrame, as_of: date, max_age_days: int = 7
) -> DataFrame:
    """Symbols never fetched, or last fetched more than a week ago."""
    last = earnings.groupBy("symbol").agg(F.max("fetched_at").alias("last_fetch"))
    return symbols.select("symbol").join(last, "symbol", "left").filter(
        C("last_fetch").isNull() | (F.datediff(F.lit(as_of), "last_fetch") > max_age_days)
    )
