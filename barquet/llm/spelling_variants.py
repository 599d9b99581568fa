"""Spelling variants of a corpus's words, by Bloom-guided neighbourhoods.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, of at least
`LEAST_CHARS` code points and `LEAST_COUNT` occurrences in the whole corpus. Two words are near
if they differ by exactly one inserted, deleted or replaced code point.

1. Words are counted in each task, then by one aggregation; the vocabulary is a stored table.
2. The vocabulary is written into blocked Bloom filters, one for each word length: a word sets
   `PROBES` bits of one 64-bit block, and a filter has a block for every four words (1024 at least).
   Blocks are made by an aggregation on the cluster; no more than `FILTER_BYTES` of them are
   broadcast at a time. A larger vocabulary takes several passes, each with its share of the blocks.
3. Every word generates its deletions and its replacements by smaller letters and asks the filter of
   the edit's length. An insertion is the other word's deletion, a replacement by a greater letter the
   other word's replacement by a smaller one, so each near pair is generated exactly once.
   Edits are hashed by position sums, of which an edit changes one or shifts a part: no string is built
   unless its filter answers yes.
4. Positives are joined with the vocabulary by a shuffle; false ones find no partner. A word has at most
   as many near words as edits, so no group of the aggregation after it grows with the corpus.
5. A form has at least `SHARE` times the occurrences of its word, so a chain of forms has at most
   log(largest count) to that base steps; roots are found by doubling, with one stored table a round.

Null texts have no words. With `planted`, each occurrence of a run whose crc32 of `doc_id:run` is divisible by it
loses one letter; runs of rows without doc_id lose none. Repeated rows count as often as they
are there, an empty table gives no rows, further columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import mixed
from barquet.session import materialize

LEAST_CHARS = 6
LEAST_COUNT = 5
SHARE = 5
LONGEST = 64  # words of this length and more share a filter
PROBES = 5
FILTER_BYTES = 16 << 20
# Words a task counts before it hands the counts on.
COUNTED = 200_000

ALPHABET = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_RUN = re.compile("[a-zÀ-ÿ]+")

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


# ------------------------------------------------------------------ vocabulary
def changed(doc_id: int | str, run: str, planted: int) -> str:
    """The run, without one letter if its checksum with the document's id is divisible."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8"))
    if h % planted:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, planted: int | None = None
) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
            )
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text, key = text.as_py(), doc_id.as_py()
                if not text:
                    continue
                found = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if planted and key is not None:
                    start = zlib.crc32(f"{key}:".encode("utf-8"))
                    for run, n in found.items():
                        if len(run) < least_chars:
                            continue
                        if not zlib.crc32(run.encode("utf-8"), start) % planted:
                            run = changed(key, run, planted)
                        if len(run) >= least_chars:
                            total[run] += n
                else:
                    for run, n in found.items():
                        if len(run) >= least_chars:
                            total[run] += n
                if len(total) >= COUNTED:
                    yield handed()
        yield handed()

    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.filter(F.col("n") >= least_count), "words")


# ------------------------------------------------------------------ hashes of words and edits
def _grouped(words: list[str], cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, matrix of code points) of words of one length, `cells` cells at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == size)
        for at in range(0, len(which), step := max(1, cells // size)):
            part = which[at : at + step]
            joined = "".join([words[k] for k in part.tolist()]).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(joined, "<u4").reshape(len(part), size).astype(np.uint64)


def _powers(size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE))), dtype=np.uint64)


def position_sums(codes: np.ndarray) -> np.ndarray:
    """Sum of code * base**position of each row."""
    with np.errstate(over="ignore"):
        return (codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _mask(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for k in range(PROBES):
        out |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return out


class Shards:
    """Where each length's filter lies in the sequence of all blocks."""

    def __init__(self, words_by_shard: dict[int, int]):
        self.first: dict[int, int] = {}
        self.blocks: dict[int, int] = {}
        self.total = 0
        for shard in sorted(words_by_shard):
            need = max(1024, words_by_shard[shard] // 4)
            self.first[shard], self.blocks[shard] = self.total, 1 << (need - 1).bit_length()
            self.total += self.blocks[shard]

    def place(self, size: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(block, bits) of words of one length by their position sums; None without such a filter."""
        shard = min(size, LONGEST)
        if shard not in self.first:
            return None
        x = mixed(sums ^ np.uint64(size))
        block = (x >> np.uint64(30)) & np.uint64(self.blocks[shard] - 1)
        return block.astype(np.int64) + self.first[shard], _mask(x)


def filter_blocks(words: DataFrame, shards: Shards, low: int, high: int) -> DataFrame:
    """(block, bits) of the blocks in [low, high) that any word sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _grouped(batch.column(0).to_pylist()):
                block, bits = shards.place(codes.shape[1], position_sums(codes))
                here = (block >= low) & (block < high)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[here]), pa.array(bits[here].view(np.int64))], names=["block", "bits"]
                )

    return words.select("word").mapInArrow(work, "block bigint, bits bigint").groupBy("block").agg(
        F.bit_or("bits").alias("bits")
    )


def edits(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(length, row, position, letter or -1, position sums) of all edits of words of one
    length: deletions (one for each stretch of a letter), then replacements by smaller letters."""
    size, power = codes.shape[1], _powers(codes.shape[1])
    with np.errstate(over="ignore"):
        terms = codes * power
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)
        if size > 1:
            gone = upto - terms + (upto[:, -1:] - upto) * _BACK
            new = np.ones(codes.shape, bool)
            new[:, 1:] = codes[:, 1:] != codes[:, :-1]
            row, at = np.nonzero(new)
            yield size - 1, row, at, -1, gone[row, at]
        top = int(codes.max())
        for letter in ALPHABET:
            if letter >= top:
                break
            row, at = np.nonzero(codes > letter)
            yield size, row, at, letter, upto[row, -1] - (codes[row, at] - np.uint64(letter)) * power[at]


def candidates(words: DataFrame, shards: Shards, low: int, blocks: np.ndarray, least_chars: int) -> DataFrame:
    """(edit, word, n): edits whose filter block is among `blocks` (from `low` on) and answers yes."""
    sent = words.sparkSession.sparkContext.broadcast(blocks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part, codes in _grouped(names, 1 << 18):
                out: tuple[list, list, list] = ([], [], [])
                for size, row, at, letter, sums in edits(codes):
                    if size < least_chars or (placed := shards.place(size, sums)) is None:
                        continue
                    block, bits = placed
                    here = (block >= low) & (block < low + len(blocks))
                    block = np.where(here, block - low, 0)
                    hit = np.flatnonzero(here & (blocks[block] & bits == bits))
                    new = "" if letter < 0 else chr(letter)
                    for r, k in zip(part[row[hit]].tolist(), at[hit].tolist()):
                        word = names[r]
                        out[0].append(word[:k] + new + word[k + 1 :])
                        out[1].append(word)
                        out[2].append(counts[r])
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
                        names=["edit", "word", "n"],
                    )

    found = materialize(words.select("word", "n").mapInArrow(work, "edit string, word string, n bigint"), "edits")
    sent.unpersist()
    return found


# ------------------------------------------------------------------ near words, forms, roots
def near_pairs(words: DataFrame, least_chars: int = LEAST_CHARS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, n_other), once for each near pair of a stored vocabulary."""
    shard = F.least(F.length("word"), F.lit(LONGEST))
    by_shard = {r.shard: r.n for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    shards, share = Shards(by_shard), filter_bytes // 8
    # An edit costs far more than reading its word: spread the words.
    spread = words.repartition(max(1, min(1 << 16, sum(by_shard.values()) // 20_000)))
    found = None
    for low in range(0, max(shards.total, 1), share):
        blocks = np.zeros(min(share, shards.total - low), np.uint64)
        rows = filter_blocks(words, shards, low, low + share).toArrow()
        blocks[rows.column("block").to_numpy() - low] = rows.column("bits").to_numpy().view(np.uint64)
        part = candidates(spread, shards, low, blocks, least_chars)
        found = part if found is None else found.unionByName(part)
    other = words.select(F.col("word").alias("other"), F.col("n").alias("n_other"))
    return found.join(other, found["edit"] == other["other"]).select("word", "n", "other", "n_other")


def forms(words: DataFrame, pairs: DataFrame, share: int = SHARE) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word, if it is frequent enough."""
    both = pairs.select("word", "other", "n_other").unionByName(
        pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("n_other"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("near"), F.min(F.struct((-F.col("n_other")).alias("minus"), "other")).alias("best")
    )
    enough = -F.col("best.minus") >= share * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"),
    )


def roots(found: DataFrame, share: int = SHARE) -> DataFrame:
    """`found` (stored, from `forms`) with the last word of each chain of forms."""
    most = found.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(most, share)) + 1 if share > 1 else most
    reached = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        ahead = reached.select(F.col("word").alias("at"), F.col("root").alias("further"))
        reached = materialize(
            reached.join(ahead, reached["root"] == ahead["at"], "left").select("word", F.coalesce("further", "root").alias("root")),
            "roots",
        )
    return found.join(reached, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, share: int = SHARE,
    planted: int | None = None, filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Per word: its count, near words, most frequent much more frequent near word, and the root
    of the chain that these form (the word itself without a form)."""
    words = vocabulary(docs, least_chars, least_count, planted)
    pairs = near_pairs(words, least_chars, filter_bytes)
    found = materialize(forms(words, pairs, share), "forms")
    return roots(found, share).select("word", "n", "n_near", "form", "form_n", "root")
