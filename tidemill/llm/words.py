"""Distinct words of many texts at once, as hashes of words and their stems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Text bytes looked at together; longer texts are cut between words.
SLICE_BYTES = 2 << 20
#: Word stems beside whole words, in characters.
STEMS = (4, 5, 6)
#: ASCII letters and digits, the apostrophe and every byte beyond ASCII belong to words.
_SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))
#: Odd multipliers that tell the places of a word's bytes apart.
PLACE = np.random.default_rng(3).integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of ``h``."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Lists of (text number, lower-case words between blanks) with about ``most`` bytes each."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        raw, at = (text or "").lower().encode().translate(_SEPARATE), 0
        while at < len(raw) or (at == 0 and not raw):
            stop = len(raw)
            if stop - at > most:
                stop = raw.rfind(b" ", at, at + most) + 1 or raw.find(b" ", at + most) + 1 or len(raw)
            numbers.append(i)
            parts.append(raw[at:stop] if at or stop < len(raw) else raw)
            size += stop - at
            at = max(stop, at + 1)
            if size >= most:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


class Words:
    """The words of one slice: ``doc`` and ``word`` (a number) of each, in reading order.

    ``features`` has a row for each distinct word: hashes of the word and of its stems, zero
    where the word is no longer than the stem; ``digits`` counts each distinct word's digits.
    """

    def __init__(self, numbers: list[int], parts: list[bytes]):
        joined = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        inside = joined != 32
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, stops = edge[::2], edge[1::2]
        size = stops - self.starts
        ends = np.cumsum([len(p) + 1 for p in parts])
        self.doc = np.asarray(numbers)[np.searchsorted(ends, self.starts, side="right")]
        held = joined[inside].astype(np.uint64)
        at = np.arange(len(held)) - np.repeat(np.cumsum(size) - size, size)
        held *= PLACE[at & 1023]
        hashes = np.add.reduceat(held, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
        self.hashes, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        # A stem is found in the first bytes of each distinct word; a character has at most four.
        width = 4 * max(STEMS) + 1 if (joined >= 0xC0).any() else max(STEMS) + 1
        at, own = self.starts[first], size[first]
        chars, sums = np.zeros(len(first), np.int8), np.zeros(len(first), np.uint64)
        self.features = np.zeros((len(first), 1 + len(STEMS)), np.uint64)
        self.features[:, 0] = mixed(self.hashes)
        stems = [np.zeros(len(first), np.uint64) for _ in STEMS]
        for i in range(width):
            letter = np.where(i < own, joined[np.minimum(at + i, len(joined) - 1)], 0)
            chars += (letter != 0) & (letter & 0xC0 != 0x80)
            sums = sums + letter * PLACE[i]
            for stem, n in zip(stems, STEMS):
                np.copyto(stem, sums, where=chars <= n)
        for k, (stem, n) in enumerate(zip(stems, STEMS), 1):
            self.features[:, k] = np.where(chars > n, mixed(stem + np.uint64(n)), 0)
        self.texts, self.first, self.size = joined, first, size
        digits = np.add.reduceat((joined[inside] >= 48) & (joined[inside] < 58), np.cumsum(size) - size, dtype=np.int64) if len(size) else size
        self.digits = digits[first]

    def spelled(self, word: int) -> bytes:
        start = self.starts[self.first[word]]
        return self.texts[start : start + self.size[self.first[word]]].tobytes()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(text number, word) of every distinct word of every text."""
        n = max(1, len(self.hashes))
        both = np.sort(self.doc * n + self.word)
        both = both[np.diff(both, prepend=-1) != 0]
        return both // n, both % n


def hash_of(word: str) -> np.ndarray:
    """The feature row of one word."""
    return Words([0], [word.lower().encode()]).features[0]


def known(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of ``found`` (any shape) are among the sorted ``values``; zero never is."""
    if not len(values):
        return np.zeros(found.shape, bool)
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    return (values[at] == found) & (found != 0)
