"""Benchmark decontamination by SimHash of item-sized windows.

For a benchmark item of L words every run of L words of a document is a window. Windows and
items are bags of five-word shingles; a window leaks an item if their weighted Jaccard
similarity (weights are multiplicities: sum of minima over sum of maxima) is at least
`SIMILARITY`.

1. A shingle's hash votes on 64 bits, as often as it occurs; the majority is the fingerprint.
   Sums over all windows of a length come from one running sum.
2. Fingerprints are split into `BLOCKS` blocks. Two that differ in at most `RADIUS` bits
   differ in at most RADIUS // BLOCKS bits of some block (pigeonhole), so tables of each
   block's values and their neighbours find every item within the radius.
3. Candidates within the radius are verified on the bags themselves.
4. A shingle that is repeated on one side votes many times, which moves a fingerprint beyond any
   useful radius. So where the item or the document repeats a shingle, all windows are compared
   by the bags alone, with the items that share enough shingles with the document.
5. A document with fewer shingles than an item is one window, whole, and also compared so.

At similarity 0.8 two fingerprints are expected to differ in ten bits, with a deviation of
three, if no shingle is repeated; the radius of 19 lies three deviations beyond. A window without any shingle of an
item has similarity 0 with it; such windows get no fingerprint, which loses nothing.

Words are runs of letters, digits and underscores, lower-cased. The benchmark is the query set:
it is taken in blocks of about `BLOCK_CHARS` characters, one pass over the documents each, so what
tasks receive is bounded and every item is searched for in all documents.

Defined cases: items with fewer than five words have no shingle and are not searched for; items
without id are searched for and reported without one; null texts and texts with fewer than five
words leak nothing;
repeated rows are each reported; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import WordHashes, shingle_hashes

SIZE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 10
BLOCK_CHARS = 8_000_000

_WORDS = re.compile(r"\w+")
_hashes = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Hashes of all five-word shingles, in order."""
    found = [w.encode("utf-8", "surrogatepass") for w in _WORDS.findall((text or "").lower())]
    return shingle_hashes(_hashes(found), SIZE) if len(found) >= SIZE else np.array([], np.uint64)


def running_votes(hashes: np.ndarray) -> np.ndarray:
    """Running sums of +1 and -1 for the 64 bits of each hash, a row of zeros first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    return np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def fingerprints(votes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the runs of `length` shingles from `starts`."""
    sums = votes[starts + length] - votes[starts]
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both)


def _cuts(blocks: int) -> list[tuple[int, int]]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class HammingIndex:
    """Finds, among fingerprints, all within `radius` bits of others."""

    def __init__(self, found: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.found, self.radius, self.cuts = found, radius, _cuts(blocks)
        self.tables = []
        for shift, width in self.cuts:
            table = np.zeros((1 << width, len(found)), bool)
            values = self._values(found, shift, width)
            for flips in range(radius // blocks + 1):
                for bits in combinations(range(width), flips):
                    table[values ^ sum(1 << b for b in bits), np.arange(len(found))] = True
            self.tables.append(table)

    @staticmethod
    def _values(x: np.ndarray, shift: int, width: int) -> np.ndarray:
        return ((x >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in asked, position in found) of all pairs within the radius."""
        met = np.zeros((len(asked), len(self.found)), bool)
        for table, (shift, width) in zip(self.tables, self.cuts):
            met |= table[self._values(asked, shift, width)]
        a, b = np.nonzero(met)
        near = np.bitwise_count(asked[a] ^ self.found[b]) <= self.radius
        return a[near], b[near]


@dataclass
class Items:
    """A block of the benchmark, indexed by number of shingles."""

    ids: list
    bags: list[Counter]
    by_length: dict[int, tuple[np.ndarray, HammingIndex]]
    known: np.ndarray
    lengths_of: list[tuple[int, ...]]
    # Of each item its shingles; of each known shingle from where its items and counts are listed.
    lengths: np.ndarray
    repeating: np.ndarray
    listed: np.ndarray
    items: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple], radius: int = RADIUS, blocks: int = BLOCKS) -> "Items":
        ids, bags, prints, length = [], [], [], []
        lengths: dict[int, set] = defaultdict(set)
        for item_id, text in rows:
            hashes = shingles(text)
            n = len(hashes)
            if n:
                ids.append(item_id)
                bags.append(Counter(hashes.tolist()))
                prints.append(fingerprints(running_votes(hashes), np.array([0]), n)[0])
                length.append(n)
                for h in hashes.tolist():
                    lengths[h].add(n)
        number, prints = np.array(length, int), np.array(prints, np.uint64)
        by_length = {}
        for n in sorted(set(length)):
            of = np.flatnonzero(number == n)
            by_length[n] = (of, HammingIndex(prints[of], radius, blocks))
        known = np.array(sorted(lengths), np.uint64)
        entries = sorted((h, i, c) for i, bag in enumerate(bags) for h, c in bag.items())
        listed = np.searchsorted(np.array([e[0] for e in entries], np.uint64), known)
        return cls(ids, bags, by_length, known, [tuple(sorted(lengths[h])) for h in known.tolist()],
                   number, np.array([len(b) < b.total() for b in bags], bool),
                   np.append(listed, len(entries)), np.array([e[1] for e in entries], int),
                   np.array([e[2] for e in entries], int))

    def _shared(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of known shingles (by position, repeated as they occur): all items that have one, and
        the shingles each has in common with them."""
        found, times = np.unique(found, return_counts=True)
        first, many = self.listed[found], self.listed[found + 1] - self.listed[found]
        rows = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        items, at = np.unique(self.items[rows], return_inverse=True)
        return items, np.bincount(at, np.minimum(self.counts[rows], np.repeat(times, many))).astype(int)

    def _best_window(self, hashes: np.ndarray, hits: np.ndarray, item: int) -> tuple[float, int, int]:
        """The first of the windows most similar to an item, from the bags of all windows."""
        bag, n = self.bags[item], min(int(self.lengths[item]), len(hashes))
        change = np.zeros(len(hashes) + 1, int)
        seen: dict[int, list] = defaultdict(list)
        for p in hits.tolist():
            h = int(hashes[p])
            if not (most := bag.get(h)):
                continue
            # Counts in the windows that hold it and fewer than `most` of its kind after their start before it.
            before = seen[h]
            first = max(p - n + 1, before[-most] + 1 if len(before) >= most else 0, 0)
            before.append(p)
            change[first] += 1
            change[p + 1] -= 1
        both = np.cumsum(change)[: len(hashes) - n + 1]
        first = int(np.argmax(both))
        return float(both[first] / (self.lengths[item] + n - both[first])), first, n

    def leaks(self, text: str | None, least: float = SIMILARITY) -> dict[int, tuple[float, int, int]]:
        """Of each leaked item (by position) the most similar window: similarity, first
        shingle, shingles."""
        hashes = shingles(text)
        if not len(hashes) or not len(self.known):
            return {}
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == hashes)
        if not len(hits):
            return {}
        starts: dict[int, list] = defaultdict(list)
        for p in hits.tolist():
            for n in self.lengths_of[at[p]]:
                starts[n].append(p)
        votes, best = running_votes(hashes), {}
        repeats = len(np.unique(hashes)) < len(hashes)
        if repeats or self.repeating.any() or any(n > len(hashes) for n in starts):
            items, both = self._shared(at[hits])
            n = self.lengths[items]
            # What a window shares is at most what the document shares.
            likely = both / (n + np.minimum(n, len(hashes)) - both) >= least
            for item in items[likely & (repeats | self.repeating[items] | (n > len(hashes)))].tolist():
                s, first, n = self._best_window(hashes, hits, item)
                if s >= least:
                    best[item] = (s, first, n)
        if repeats:
            return best
        for n, anchors in starts.items():
            if len(hashes) < n:
                continue
            near = (np.array(anchors)[:, None] - np.arange(n)).ravel()
            windows = np.unique(near[(near >= 0) & (near <= len(hashes) - n)])
            of, index = self.by_length[n]
            for part in np.array_split(windows, len(windows) // 4096 + 1):
                for w, i in zip(*index.candidates(fingerprints(votes, part, n))):
                    item, first = int(of[i]), int(part[w])
                    s = similarity(Counter(hashes[first : first + n].tolist()), self.bags[item])
                    if s >= least and s > best.get(item, (0.0,))[0]:
                        best[item] = (s, first, n)
        return best


FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _blocks(benchmark: DataFrame, radius: int) -> Iterator[Items]:
    """The benchmark in blocks of a bounded size, each indexed."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars) // BLOCK_CHARS + 1
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield Items.build(sorted(((r["item_id"], r["text"]) for r in block), key=str), radius)


def find(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row for each document and item that it leaks, with its most similar window."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for known in _blocks(benchmark, radius):

        def run(batches: Iterator[pa.RecordBatch], known: Items = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                    for item, (s, first, n) in sorted(known.leaks(text.as_py(), least).items()):
                        rows.append((doc_id.as_py(), known.ids[item], s, first, n + SIZE - 1))
                columns = zip(*rows) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds)],
                                      names=[f.split()[0] for f in FOUND.split(", ")])

        part = texts.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, unchanged, which leak no item."""
    for known in _blocks(benchmark, radius):

        def run(batches: Iterator[pa.RecordBatch], known: Items = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not known.leaks(t.as_py(), least) for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
