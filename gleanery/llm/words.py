"""Words and word shingles as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 200_000
#: Words of more bytes than this are hashed one by one.
LONGEST = 1 << 10
#: Masks of the first bytes of eight, by their number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, with a bound on what is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _B
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a text, in order; equal words, by ``words``, have equal hashes.

    All words are hashed together, eight bytes of each at a time.
    """
    data = data.lower()
    c = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(c) + 2, bool)
    np.logical_and(c != 32, c - np.uint8(9) > 4, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    out = size.astype(np.uint64)
    # The eight bytes from each place on, as a number.
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    rest = np.where(size > LONGEST, 0, size)
    left, done = np.flatnonzero(rest), 0
    while len(left):
        part = eight[start[left] + done] & FIRST[np.minimum(rest[left] - done, 8)]
        out[left] = mix(out[left] * _A + part)
        done += 8
        left = left[rest[left] > done]
    for i in np.flatnonzero(size > LONGEST):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return start, out


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values of h in order; h itself is sorted."""
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbours."""
    h = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * _A + hashes[i : len(hashes) - k + 1 + i])
    return h


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its k-word shingles; of all its words as one where they are fewer than k."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    start, hashes = word_hashes(b" ".join(parts))
    bounds = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for p in parts)]))
    rolled = windows(hashes, k) if len(hashes) >= k else hashes[:0]
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            sets.append(distinct(rolled[a : b - k + 1].copy()))
        else:
            sets.append(windows(hashes[a:b], b - a) if b > a else hashes[:0])
    return sets
