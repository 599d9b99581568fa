"""Token counts by rank-synchronous merging of symbol arrays.

A byte-level vocabulary merges neighbouring symbols of a pre-token, the pair of lowest rank
first. Only the number of symbols left is wanted, so no ids are made:

* The distinct new pre-tokens of a group of texts are one flat array of symbols with the
  start of each sequence. In a round every sequence finds its lowest rank and merges all
  occurrences of that pair at once, of overlapping ones the first, third, ... Sequences without
  a mergeable pair leave the array with their length.
* All occurrences may be merged at once because no pair that holds a merged symbol ranks before
  the merge that made it. This is checked when a vocabulary is read; where it does not hold only
  the first occurrence is merged in a round.
* A sequence of more than `LONG` symbols (base64, a text without blanks) would take many rounds
  over all its symbols. Its positions are kept by rank instead, and a round takes the positions of the lowest
  rank and looks again at their neighbours alone.

The split into pre-tokens is the library's: by its pattern for Latin texts, by its own
pre-tokenizer for texts with other characters. A special token's string is one token, as the library has it.
Counts of pre-tokens are remembered in two generations of at most `MEMO_ENTRIES`.

Null text counts as empty: no bytes, no tokens. Repeated rows are counted one by one, an empty
table gives no rows, null doc_ids stay null, further columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.tokens import MEMO_ENTRIES, _SPLIT, _UNUSUAL, in_groups

LIMIT = 512
LONG = 512

_NONE = np.iinfo(np.int64).max


def _byte_characters() -> dict[str, int]:
    """Byte of each character that stands for one in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merger:
    """Symbols left of byte sequences after all merges of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"{path} is no plain byte-level vocabulary: {odd or model['type']}")
        ids: dict[str, int] = model["vocab"]
        self._size = max(ids.values()) + 1
        self._of_byte = np.zeros(256, np.int64)
        for char, byte in _byte_characters().items():
            self._of_byte[byte] = ids[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self._made = np.array([ids[a + b] for a, b in pairs], np.int64)
        made_at = np.full(self._size, -1)
        np.maximum.at(made_at, self._made, np.arange(len(pairs)))
        self.ordered = bool(np.all(np.maximum(made_at[left], made_at[right]) < np.arange(len(pairs))))
        keys = left * self._size + right
        self._rank = np.argsort(keys, kind="stable")
        self._keys = keys[self._rank]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, `_NONE` where they do not merge."""
        key = left * self._size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank[at], _NONE)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Number of symbols left of each sequence."""
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = sizes.copy()
        long = sizes > LONG if self.ordered else np.zeros(len(sizes), bool)
        for k in np.flatnonzero(long).tolist():
            out[k] = self._long(self._of_byte[np.frombuffer(sequences[k], np.uint8)])
        which = np.flatnonzero(~long & (sizes > 1))
        sizes = sizes[which]
        symbols = self._of_byte[np.frombuffer(b"".join([sequences[k] for k in which.tolist()]), np.uint8)]
        while len(which):
            start = np.cumsum(sizes) - sizes
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = self._ranks(symbols[:-1], symbols[1:])
            rank[start + sizes - 1] = _NONE  # the last symbol has no right neighbour
            lowest = np.minimum.reduceat(rank, start)
            active = lowest < _NONE
            out[which[~active]] = sizes[~active]
            here = np.repeat(active, sizes)
            symbols, rank = symbols[here], rank[here]
            which, sizes, lowest = which[active], sizes[active], lowest[active]
            if not len(which):
                break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            owner = np.repeat(np.arange(len(which)), sizes)[hit]
            if self.ordered:
                chosen = _alternate(np.concatenate(([False], hit[1:] == hit[:-1] + 1)))
            else:
                chosen = np.concatenate(([True], owner[1:] != owner[:-1]))
            hit, owner = hit[chosen], owner[chosen]
            symbols[hit] = self._made[rank[hit]]
            symbols = np.delete(symbols, hit + 1)
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
        return out

    def _long(self, symbols: np.ndarray) -> int:
        """The same for one long sequence, with positions kept by rank."""
        n = len(symbols)
        symbols = symbols.copy()
        after, before, there = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            rank = self._ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank < _NONE], rank[rank < _NONE]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for part, r in zip(np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist() if len(at) else []):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        look(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[there[at] & (after[at] < n)]
            at = at[self._ranks(symbols[at], symbols[after[at]]) == r]
            if not len(at):
                continue
            at = at[_alternate(np.concatenate(([False], after[at[:-1]] == at[1:])))]
            gone = after[at]
            symbols[at], there[gone] = self._made[r], False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            look(np.unique(np.concatenate((before[at][before[at] >= 0], at[inner]))))
        return int(there.sum())


def _alternate(follows: np.ndarray) -> np.ndarray:
    """First, third, ... element of each chain; `follows` marks those that continue one."""
    place = np.arange(len(follows))
    return (place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0


class Counter:
    """Token counts of texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._merger = Merger(path)
        library = Tokenizer.from_file(path)
        added = library.get_added_tokens_decoder().values()
        if library.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path}: texts are changed before they are split")
        self._split_other = library.pre_tokenizer.pre_tokenize_str
        strings = sorted((t.content for t in added), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self._bytes = _byte_characters()
        self._memo: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def _pieces(self, text: str) -> list[str]:
        if not _UNUSUAL.search(text):
            return _SPLIT.findall(text)
        found = self._split_other(text)
        return [bytes(map(self._bytes.__getitem__, piece)).decode("utf-8") for piece, _ in found]

    def count(self, texts: Iterable[str]) -> list[int]:
        extra, pieces, new = [], [], set()
        for text in texts:
            found: list[str] = []
            parts = self._special.split(text) if self._special else [text]
            for part in parts:
                if part:
                    found += self._pieces(part)
            extra.append(len(parts) - 1)
            pieces.append(found)
            new.update(found)
        if len(self._memo) > MEMO_ENTRIES:
            self._old, self._memo = self._memo, {}
        memo, old, unknown = self._memo, self._old, []
        for piece in new:
            if piece not in memo:
                if (known := old.get(piece)) is not None:
                    memo[piece] = known
                else:
                    unknown.append(piece)
        if unknown:
            left = self._merger.counts([p.encode("utf-8") for p in unknown])
            memo.update(zip(unknown, left.tolist()))
        return [sum(map(memo.__getitem__, p)) + e for p, e in zip(pieces, extra)]


@cache
def counter(path: str) -> Counter:
    """One counter for each worker process."""
    return Counter(path)


def count(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, bytes in UTF-8, tokens, and whether there are more than `limit`."""
    id_type = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counter(tokenizer)
        for batch in batches:
            tokens: list[int] = []
            for _, texts in in_groups(batch.column(1)):
                tokens += found.count([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(work, f"doc_id {id_type.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.coalesce(F.col("n_tokens") > limit, F.lit(False)))
