"""Token ids of whole texts, by the tokenizers library, memoised per pre-token.

A byte-level vocabulary encodes each pre-token (a word with its blank, a number,
a run of signs) on its own, so an id list is the concatenation of the id lists of
a text's pre-tokens. The encoder therefore asks the library once for a distinct
pre-token and joins the remembered bytes. Texts with characters whose class may
differ between Unicode versions, or with a special token's string, go to the
library whole. The memo has two generations of at most `MEMO_ENTRIES` each: when the
young one is full it becomes the old one, and what is asked for again moves up.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable
from functools import cache
from unicodedata import category

END_ID = 0
MEMO_ENTRIES = 500_000

# Everything but printable Latin and plain white space.
_LATIN = [*range(9, 14), *range(32, 127), *range(0xA1, 0x250)]
_UNUSUAL = re.compile("[^\t-\r -~\u00a1-\u024f]")
# Fixed value: the split rule of the byte-level vocabularies, with letters and numbers
# spelt out over the range above.
_LETTERS = "".join(chr(c) for c in _LATIN if category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in _LATIN if category(chr(c))[0] == "N")
_SPLIT = re.compile(
    # The contractions as one alternative: most pre-tokens start otherwise, and one test tells.
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+"
    r"|\s+(?!\S)|\s+"
)


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes, end id included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._library = Tokenizer.from_file(path)
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self.vocabulary = self._library.get_vocab_size(with_added_tokens=True)

    def _whole(self, text: str) -> bytes:
        return _packed(self._library.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """A null text counts as empty: it has the end id alone."""
        end = _packed([END_ID])
        pieces: list[list[str] | bytes] = []
        new: set[str] = set()
        for text in texts:
            text = text or ""
            if _UNUSUAL.search(text) or any(s in text for s in self._special):
                pieces.append(self._whole(text))
            else:
                pieces.append(found := _SPLIT.findall(text))
                new.update(found)
        if len(self._memo) > MEMO_ENTRIES:
            self._old, self._memo = self._memo, {}
        memo, old = self._memo, self._old
        words = []
        for piece in new:  # set operations with a dict would walk the whole dict
            if piece not in memo:
                if (known := old.get(piece)) is not None:
                    memo[piece] = known
                else:
                    words.append(piece)
        for word, coded in zip(
            words, self._library.encode_batch_fast(words, add_special_tokens=False)
        ):
            memo[word] = _packed(coded.ids)
        get = memo.__getitem__
        return [
            (p if isinstance(p, bytes) else b"".join(map(get, p))) + end for p in pieces
        ]


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()  # four bytes, little-endian on all usual machines


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def forget() -> None:
    """Give up the worker's encoders and what they remember. Workers outlive a stage; later stages that
    need the memory for something else call this first."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()


def in_groups(texts, chars: int = 1 << 20):
    """(first, texts) in groups of about so many characters; bounds a worker's memory."""
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text.as_py()
        group.append(text)
        size += len(text or "")
        if size >= chars:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group
