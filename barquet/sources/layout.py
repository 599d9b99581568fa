"""Where a panel's rows lie, so that one symbol and one day are both cheap to read.

A panel is cut into tiles: date ranges by symbol ranges, of about the same number of rows. Tiles are
numbered along the interleaved bits of both positions, consecutive tiles share a file, and rows of a file are sorted by
symbol and date. The statistics of a file's row groups then span a few symbols and a few dates: a symbol's
history or a day's screen reads about the square root of all files; a Bloom filter on the symbol
spares it those of its symbol range that lack it.

Edges come from the dates' quantiles and from the symbols with the smallest hashes, a sample of bounded
size. They decide where rows lie, never which rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL_SAMPLE = 10_000
BLOOM = {"parquet.bloom.filter.enabled#symbol": "true"}


def _edges(values: list, parts: int) -> list:
    """Up to parts - 1 values that cut a sorted list into equal parts."""
    return sorted({values[len(values) * k // parts] for k in range(1, parts)}) if values else []


@dataclass(frozen=True)
class Tiles:
    """A grid of `side` by `side` tiles on `files` files; `side` is a power of two."""

    symbols: tuple[str, ...]
    dates: tuple[date, ...]
    side: int
    files: int

    @staticmethod
    def of(panel: DataFrame, files: int) -> Tiles:
        """The grid for panels with the keys of a stored one."""
        side = 1
        while side * side < files:
            side *= 2
        names = panel.select("symbol").distinct().orderBy(F.xxhash64("symbol"), "symbol").limit(SYMBOL_SAMPLE)
        symbols = sorted(r[0] for r in names.collect() if r[0] is not None)
        days: list = []
        if side > 1:
            shares = [k / side for k in range(1, side)]
            days = panel.agg(F.percentile_approx(F.unix_date("trade_date"), shares, 10_000)).first()[0] or []
        dates = tuple(date.fromordinal(date(1970, 1, 1).toordinal() + d) for d in sorted(set(days)))
        return Tiles(tuple(_edges(symbols, side)), dates, side, files)

    def file_number(self) -> Column:
        """File of a row, by its tile's place along the interleaved bits."""
        def place(column: str, edges: tuple) -> Column:
            steps = [F.coalesce(F.col(column) >= F.lit(e), F.lit(False)).cast("int") for e in edges]
            return sum(steps, F.lit(0))

        bits = self.side.bit_length() - 1
        x, y = place("symbol", self.symbols), place("trade_date", self.dates)
        tile = F.lit(0)
        for k in range(bits):
            tile = tile + F.shiftleft(F.shiftright(x, k).bitwiseAND(1), 2 * k) + F.shiftleft(F.shiftright(y, k).bitwiseAND(1), 2 * k + 1)
        return F.floor(tile * self.files / (self.side * self.side)).cast("int")

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows dealt to their files, one partition each, sorted by symbol and date."""
        rows = df.withColumn("__tile", self.file_number()).repartitionById(self.files, "__tile")
        return rows.sortWithinPartitions("symbol", "trade_date").drop("__tile")
