"""Helpers of several text operators: tables, words, hashed words."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: what separates words in all contracts; bytes.split() takes the same.
BLANKS = " \t\n\x0b\f\r"

# Bytes a side of a join may have and still be broadcast.
BROADCAST_BYTES = 16 << 20


def row_bytes(schema: StructType) -> int:
    """Bytes of a row of fixed-width columns in a broadcast relation, key and pointer included."""
    return 32 + 8 * len(schema.fields)


def checked_broadcast(stored: DataFrame, at_most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table of fixed-width columns, marked for broadcast if a count finds it small
    enough; beyond that the join shuffles."""
    return F.broadcast(stored) if stored.count() * row_bytes(stored.schema) <= at_most else stored


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies; on a
    cluster it is installed or given by --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_crc32(column: Column) -> Column:
    """crc32 of an id's decimal text."""
    return F.crc32(column.cast("string").cast("binary"))


def lower_words(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes:
    """64-bit hashes of words, memoised; the memo is emptied at a bound."""

    def __init__(self, entries: int = 300_000):
        self._entries = entries
        self._memo: dict[bytes, int] = {}

    def __call__(self, found: list[bytes]) -> np.ndarray:
        memo = self._memo
        try:
            return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        except KeyError:
            pass
        if len(memo) > self._entries:
            memo.clear()
        for word in set(found).difference(memo):
            memo[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` words; fewer words make one run of them all."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    with np.errstate(over="ignore"):
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total = mixed(total * _MIX + hashes[k : n - size + 1 + k] + np.uint64(k + 1))
    return total
