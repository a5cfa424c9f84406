"""Texts to token ids of a byte-level BPE, with the ids of words kept between texts.

The expression that splits a text into matches always starts a match at a space between two other characters, and
every match is encoded separately. So the ids of such a word, with the space before it, are the same in every text.
Words not yet known are encoded together as one string and told apart by the tokens that start with a space.
A text with white space next to a space is encoded as a whole. The cache is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

#: About 230 bytes each, in each Python worker.
MOST_WORDS = 700_000
LONGEST_WORD = 64
BATCH_CHARS = 1 << 21


class WordEncoder:
    """``encode_text`` gives the ids of a string; ``tokens`` the bytes of each id."""

    def __init__(self, encode_text: Callable[[str], np.ndarray], tokens: list[bytes], most: int = MOST_WORDS):
        self.encode_text = encode_text
        self.spaced = np.array([t.startswith(b" ") for t in tokens])
        self.most = most
        self.words: dict[str, bytes] = {}

    def _learn(self, unknown: list[str]) -> None:
        ids = self.encode_text(" " + " ".join(unknown)).astype("<u4")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(unknown):
            raise AssertionError("a word's tokens don't start at its space")
        packed, at = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
        self.words.update(zip(unknown, [packed[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))

    def _trim(self, fresh: list[str]) -> None:
        """Forgets long words, and the older half once there are too many."""
        for x in fresh:
            if len(x) > LONGEST_WORD:
                del self.words[x]
        if len(self.words) > self.most:
            for x in list(self.words)[: len(self.words) // 2]:
                del self.words[x]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian 32-bit integers."""
        cut = [x.split(" ") for x in texts]
        unknown = set(chain.from_iterable(p[1:] for p in cut)).difference(self.words)
        unsafe = {x for x in unknown if not x or x[0].isspace() or x[-1].isspace()}
        fresh = list(unknown - unsafe)
        if fresh:
            self._learn(fresh)
        find, out = self.words.__getitem__, []
        for x, parts in zip(texts, cut, strict=True):
            if unsafe and not unsafe.isdisjoint(parts[1:]):
                out.append(self.encode_text(x).astype("<u4").tobytes())
            else:
                out.append((self.encode_text(parts[0]).astype("<u4").tobytes() if parts[0] else b"") + b"".join(map(find, parts[1:])))
        self._trim(fresh)
        return out


def in_batches(texts: Iterable[str | None], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` code points together; null is the empty text."""
    run, size = [], 0
    for x in texts:
        run.append(x or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
