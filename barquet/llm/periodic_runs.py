"""Runs of repeated word sequences, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and a length of at least
`max(LEAST, 2 * q)` that no neighbouring word extends with that period.

Texts of a task are joined to batches of about `BATCH_WORDS` words; a word of another text is
another symbol, so nothing matches across texts. Prefix doubling sorts the suffixes of a batch
and gives, for each power of two, the class of every block of that many words.

* A run with period p in [2b - 1, 4b - 2] holds an aligned block of b words together with its
  copy p words later (blocks of 4 stand at every second word and serve p from 1 to 14).
* A block's occurrences are one range of the suffix array. The next occurrence after a position
  is a range successor in a wavelet matrix over that array; blocks that occur once are
  never asked.
* Occurrences at most b / 2 apart are a progression, whose end a longest common extension gives.
  Where the block's own stretch goes on through the progression, only its difference can be a
  smallest period, and that is found at its own level; else all members are candidates.
* A candidate (i, i + p) is extended both ways by descending over the classes. Of stretches
  with the same ends the smallest period stays: by the periodicity lemma the others are multiples.

Time is n log n for a batch of n words, memory about 4 bytes a word and level in use plus a few
bits for the matrix. A text is never cut: one longer than a batch is a batch of its own.

Null or empty texts have no words and no runs. Repeated rows are treated one by one, an empty
table gives no rows, null doc_ids stay null, further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
BATCH_WORDS = 1 << 17

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def dyadic_classes(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Classes of blocks of 1, 2, 4, ... symbols and the suffix array.

    A class is the number of suffixes that sort before its own, hence the start of its range in
    the suffix array. Only suffixes that still share a class are sorted again; the last level
    has no class with two members.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    ordered = symbols[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        slots = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(slots):
            return levels, order
        sub = order[slots]
        after = sub.astype(np.int64) + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[sub].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, sub = key[by], sub[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        order[slots] = sub
        first[slots] = fresh
        rank = rank.copy()
        rank[sub] = np.maximum.accumulate(np.where(fresh, slots, 0))
        levels.append(rank)
        step *= 2


class WaveletMatrix:
    """Successors of values in ranges of an array; one bit a value and level, and a count for
    each 64 of them."""

    def __init__(self, values: np.ndarray):
        self._bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self._levels = []
        values = values.astype(np.int64)
        for bit in range(self._bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            padded = np.zeros((len(values) // 64 + 1) * 64, bool)
            padded[: len(values)] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            self._levels.append((bit, words, before, len(values) - int(ones.sum())))
            values = np.concatenate((values[~ones], values[ones]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask)

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest value of at least `least` among positions [low, high), or -1."""
        left, right, below = low, high, np.zeros(len(low), np.int64)
        for bit, words, before, zeros in self._levels:
            a, z = self._ones(words, before, left), self._ones(words, before, right)
            one = (least >> bit) & 1 == 1
            below += np.where(one, (right - z) - (left - a), 0)
            left, right = np.where(one, zeros + a, left - a), np.where(one, zeros + z, right - z)
        found = (below < high - low) & (least >> self._bits == 0)
        left, right, nth = low, high, below
        value = np.zeros(len(low), np.int64)
        for bit, words, before, zeros in self._levels:
            a, z = self._ones(words, before, left), self._ones(words, before, right)
            small = (right - z) - (left - a)
            one = nth >= small
            value |= one.astype(np.int64) << bit
            nth = np.where(one, nth - small, nth)
            left, right = np.where(one, zeros + a, left - a), np.where(one, zeros + z, right - z)
        return np.where(found, value, -1)


class _Matcher:
    """Occurrences and extensions of a batch's blocks."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels, order = dyadic_classes(symbols)
        self.matrix = None
        if len(self.levels) > 3:
            # Suffixes whose first four words occur once never match a block.
            rank = self.levels[2]
            count = np.bincount(rank, minlength=self.n)
            kept = count[rank[order]] > 1
            self._before = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
            self.matrix = WaveletMatrix(order[kept])

    def blocks(self, level: int, stride: int, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Aligned blocks that occur twice or more, with their ranges in the matrix."""
        rank = self.levels[level]
        count = np.bincount(rank, minlength=self.n)
        at = np.flatnonzero((local % stride == 0) & (count[rank] > 1))
        low = rank[at].astype(np.int64)
        return at, self._before[low], self._before[low + count[low]]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols from i and from j (i < j) on."""
        i, j = i.copy(), j.copy()
        start = j.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            rank, size = self.levels[level], 1 << level
            same = (j < self.n) & (rank[np.minimum(i, self.n - 1)] == rank[np.minimum(j, self.n - 1)])
            i += same * size
            j += same * size
        return j - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols before i and before j (i < j)."""
        i, j = i.copy(), j.copy()
        start = j.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            rank, size = self.levels[level], 1 << level
            same = (i >= size) & (rank[np.maximum(i - size, 0)] == rank[np.maximum(j - size, 0)])
            i -= same * size
            j -= same * size
        return start - j


def _candidates(m: _Matcher, local: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions at a distance that may be the period of a run around them."""
    for level in range(2, len(m.levels)):
        b = 1 << level
        least, most, stride = (1, 14, 2) if b == 4 else (2 * b - 1, 4 * b - 2, b)
        i, low, high = m.blocks(level, stride, local)
        if not len(i):
            return  # longer blocks do not recur either
        near = m.matrix.successor(low, high, i + 1)
        go = near >= 0
        i, low, high, near = i[go], low[go], high[go], near[go]
        gap = near - i
        own = gap <= b // 2
        if b == 4:
            yield i[own], near[own]
        end = near + m.forward(i, near)
        at = np.maximum(i + least - 1, np.where(own, i + (end - b - i) // gap * gap, 0))
        j = m.matrix.successor(low, high, at + 1)
        while True:
            go = (j >= 0) & (j <= i + most)
            i, low, high, j = i[go], low[go], high[go], j[go]
            if not len(i):
                break
            yield i, j
            nxt = m.matrix.successor(low, high, j + 1)
            gap = nxt - j
            row = np.flatnonzero((nxt >= 0) & (gap <= b // 2))
            if len(row):
                ri, rj, gap = i[row], j[row], gap[row]
                members = (nxt[row] + m.forward(rj, nxt[row]) - b - rj) // gap
                shown = np.minimum(members, (ri + most - rj) // gap)
                k = np.arange(int(shown.sum())) - np.repeat(np.cumsum(shown) - shown, shown) + 1
                yield np.repeat(ri, shown), np.repeat(rj, shown) + k * np.repeat(gap, shown)
                nxt[row] = m.matrix.successor(low[row], high[row], rj + members * gap + 1)
            j = nxt


def runs_of(symbols: np.ndarray, local: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs of a batch, in this order; `local` numbers the words of
    each text from 0."""
    none = np.empty((0, 3), np.int64)
    if len(symbols) < least:
        return none
    m = _Matcher(symbols)
    if m.matrix is None:
        return none
    found = []
    for i, j in _candidates(m, local):
        if not len(i):
            continue
        p = j - i
        start, end = i - m.backward(i, j), j + m.forward(i, j)
        run = end - start >= np.maximum(least, 2 * p)
        if run.any():
            found.append(np.unique(np.column_stack((start, end, p))[run], axis=0))
    if not found:
        return none
    rows = np.unique(np.concatenate(found), axis=0)
    new = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
    return rows[np.concatenate(([True], new))]


def _batch(texts: list[list[bytes]], least: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each list of words."""
    known: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    symbols = np.empty(int(sizes.sum()), np.int64)
    for k, words in enumerate(texts):
        for word in set(words):
            known.setdefault(word, len(known))
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        symbols[first[k] : first[k] + len(words)] = ids + (k << 32)
    local = np.arange(len(symbols)) - np.repeat(first, sizes)
    found = runs_of(symbols, local, least)
    owner = np.searchsorted(first + sizes, found[:, 0], side="right")
    runs: list[list[dict]] = [[] for _ in texts]
    edge = np.zeros(len(symbols) + 1, np.int64)
    for k, (start, end, period) in zip(owner.tolist(), found.tolist()):
        runs[k].append({"start": start - int(first[k]), "length": end - start, "period": period})
        edge[start + period] += 1
        edge[end] -= 1
    dropped = np.cumsum(edge[:-1]) > 0
    collapsed = []
    for k, words in enumerate(texts):
        if runs[k]:
            keep = ~dropped[first[k] : first[k] + sizes[k]]
            words = [words[x] for x in np.flatnonzero(keep).tolist()]
        collapsed.append(b" ".join(words))
    return runs, collapsed


def find(docs: DataFrame, least: int = LEAST, batch_words: int = BATCH_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, runs by start and period (word numbers from 0), and the
    text collapsed: words that any run holds after its first period are left out, the kept
    ones joined by one space."""
    id_type = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs, collapsed = _batch(texts, least)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(list(map(len, texts)), pa.int64()), pa.array(runs, _ARROW_RUNS),
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

        for batch in batches:
            ids, begin, texts, size = batch.column(0), 0, [], 0
            for k, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if texts and size + len(words) > batch_words:
                    yield done(ids.slice(begin, k - begin), texts)
                    begin, texts, size = k, [], 0
                texts.append(words)
                size += len(words)
            if texts:
                yield done(ids.slice(begin), texts)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, f"doc_id {id_type.simpleString()}, n_words bigint, runs {RUNS}, collapsed string"
    )


def digests(found: DataFrame) -> DataFrame:
    """Per document: number of runs, its longest one, and digests of all runs and of the
    collapsed text."""
    line = lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"),
    )
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.b").alias("start"), (-F.col("best.a")).alias("length"), F.col("best.c").alias("period"),
        F.expr("(1000 * -best.a) div best.c").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
