"""Table sinks.

Full rebuilds, one-date replacement, key-set replacement, insert-if-absent and
CSV export. Inputs that read the table being written go through the shared
folder first, so a job never overwrites what it is still reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.functions.predicates import not_nan
from barquet.schemas import require
from barquet.session import materialize


# Types an aggregation buffer can hold in place, so grouping can hash.
_FIXED_WIDTH = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean",
                "date", "timestamp")


def unique_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key: the one with the smallest hash, the same on every run.

    Repeated keys are reduced map-side, so a key with any number of copies
    reaches the shuffle once per task. Column types only decide how: fixed-width
    columns are picked one by one, which keeps the aggregation hash-based, others as one
    struct, which sorts. The surviving row does not depend on that.
    """
    rest = [c for c in df.columns if c not in key]
    types = dict(df.dtypes)
    # Nulls leave a hash unchanged, so their places are hashed as well.
    pick = F.xxhash64(*rest, *[F.col(c).isNull() for c in rest]) if rest else F.lit(0)
    if rest and all(types[c] in _FIXED_WIDTH for c in rest):
        picked = df.withColumn("__pick", pick).groupBy(*key).agg(
            *[F.min_by(c, "__pick").alias(c) for c in rest]
        )
        return picked.select(*df.columns)
    picked = df.groupBy(*key).agg(F.min(F.struct(pick.alias("__pick"), *rest)).alias("__row"))
    return picked.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    fixed = {n: not_nan(F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fixed) if fixed else df


def _by_partition(df: DataFrame, column: str) -> DataFrame:
    """Bring each partition value together for writing.

    A rebalance, not a repartition: adaptive execution splits a value that
    outgrows a task and merges small ones, so a hot date is written by many tasks.
    """
    return df.hint("rebalance", F.col(column))


def _declared(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], assume_unique: bool
) -> DataFrame:
    rows = clean_nan(require(df, columns).select(*columns))
    return rows if assume_unique else unique_rows(rows, key)


def rebuild(
    df: DataFrame, path: str, columns: Sequence[str],
    key: Sequence[str] = ("symbol", "trade_date"), partition_by: str | None = None,
    assume_unique: bool = False,
) -> None:
    """Replace a whole table: declared columns only, one row per key.

    Frames whose key is unique by construction can say so and save a shuffle.
    """
    out = _declared(df, columns, key, assume_unique)
    if partition_by:
        out = _by_partition(out, partition_by)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def rebuild_bucketed(
    df: DataFrame, table: str, path: str, columns: Sequence[str], buckets: int,
    key: Sequence[str] = ("symbol", "trade_date"), assume_unique: bool = False,
) -> None:
    """Replace a panel bucketed by symbol.

    Readers get the symbol partitioning from the files: per-symbol windows and
    panel-to-panel joins on (symbol, trade_date) need no exchange.
    """
    out = _declared(df, columns, key, assume_unique)
    (
        out.repartition(buckets, "symbol").sortWithinPartitions(*key)
        .write.mode("overwrite").option("path", path).format("parquet")
        .bucketBy(buckets, "symbol").sortBy(*key).saveAsTable(table)
    )


def replace_dates(
    df: DataFrame, path: str, key: Sequence[str], date_column: str = "trade_date"
) -> None:
    """Replace exactly the dates present in df; other dates stay untouched."""
    rows = _by_partition(unique_rows(clean_nan(df), key), date_column)
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_column).parquet(path)
    )


def replace_keys_on_date(
    new: DataFrame, spark: SparkSession, path: str,
    key: str = "symbol", date_column: str = "trade_date",
) -> None:
    """Within each date present in `new`, replace only the keys it brings."""
    days = new.select(date_column).distinct()
    kept = (
        spark.read.parquet(path)
        .join(days, date_column, "left_semi")
        .join(new.select(key, date_column), [key, date_column], "left_anti")
    )
    merged = clean_nan(new).unionByName(kept.select(*new.columns))
    staged = materialize(merged, "replace_keys")
    (
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_column).parquet(path)
    )


def absent_rows(new: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of `new` whose key is not stored yet, one per key."""
    return unique_rows(new, key).join(stored.select(*key), list(key), "left_anti")


def insert_absent(
    new: DataFrame, spark: SparkSession, path: str, key: Sequence[str],
    partition_by: str | None = None,
) -> None:
    """Append only rows with new keys; running it twice changes nothing."""
    rows = materialize(absent_rows(new, spark.read.parquet(path), key), "insert_absent")
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)
