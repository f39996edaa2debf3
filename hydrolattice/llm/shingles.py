"""Word shingles as 64-bit hashes."""

from __future__ import annotations

from itertools import pairwise

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; shorter texts give their whole sequence as one."""
    n = min(size, len(hashes))
    if not n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(hashes) - n + 1, n, np.uint64)
        for i in range(n):
            total = total * MULTIPLIER + hashes[i : len(hashes) - n + 1 + i]
    return mixed(total)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    out = []
    for base in (MULTIPLIER, _INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


class BulkHashes:
    """64-bit hashes of all words of many texts in array operations, with no work per word.

    A word's hash is its polynomial over the running sum of a whole buffer, shifted back to its first byte and mixed with
    its length, so equal words get equal hashes wherever they stand.
    """

    def __init__(self, block: int = 1 << 20):
        self.block, self.powers = block, powers(block)

    def _words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and hashes of the words of a buffer that starts and ends between words."""
        if len(data) > len(self.powers[0]):
            self.powers = powers(2 * len(data))
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~SPACE[data]
        edges = np.diff(inside)
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * self.powers[0][: len(data)], out=sums[1:])
            hashes = (sums[last] - sums[first]) * self.powers[1][first]
            return first, mixed(hashes ^ ((last - first).astype(np.uint64) * MULTIPLIER))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, and for each text the place of its first word, with the total at the end. The buffer is read in
        blocks that end at white space, so memory beyond the texts is that of one block or one word."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        first, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
        while at < len(data):
            end = min(at + self.block, len(data))
            if end < len(data):
                gaps = np.flatnonzero(SPACE[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # one word is longer than a block
                    while end < len(data) and not SPACE[data[end]]:
                        end += 1
            places, found = self._words(data[at:end])
            first.append(places + at)
            hashes.append(found)
            at = end
        starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(first), starts)


def shingle_sets(texts: list[str], size: int, hashes: BulkHashes) -> list[np.ndarray]:
    """The distinct shingles of each text in ascending order."""
    every, places = hashes(texts)
    return [np.unique(positions(every[a:b], size)) for a, b in pairwise(places.tolist())]
