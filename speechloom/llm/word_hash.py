"""Hashes of all words of a text at once, and a table from words to runs of small numbers that is looked up by them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words hashed at once, about.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTERS = [mix(np.arange(1, 257, dtype=np.uint64) * m) for m in (_M3, _M2)]
_STEPS = (_M3, _M1)


def word_ends(data: np.ndarray) -> np.ndarray:
    """Where the words of a byte string end; single spaces part them, and one more follows the last."""
    return np.flatnonzero(data == 32)


def word_hashes(data: np.ndarray, ends: np.ndarray, kinds: int = 1) -> list[np.ndarray]:
    """kinds (at most 2) independent 64-bit hashes of each word: sums of a number a letter and place. Letter and place are mixed
    before they are added: sums of letters times powers are alike for whole families of words (of Thue and Morse, say)."""
    out = [np.empty(len(ends), np.uint64) for _ in range(kinds)]
    first = 0
    while first < len(ends):
        begin = ends[first - 1] + 1 if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + CHUNK)))
        stop = ends[first:last] + 1
        starts = np.concatenate([[begin], stop[:-1]])
        size = stop - starts
        place = np.arange(stop[-1] - begin) - np.repeat(starts - begin, size)
        letters = data[begin : stop[-1]]
        for own, table, step in zip(out, _LETTERS, _STEPS, strict=False):
            x = table[letters]
            x ^= mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64) * step)[place]
            x *= _M2
            x ^= x >> np.uint64(32)
            own[first:last] = mix(np.add.reduceat(x, starts - begin))
        first = last
    return out


class WordTable:
    """Words to runs of 16-bit numbers, known by 128 bits of hash. It keeps up to a limit of words; what comes later is worked
    out anew for each batch, so results never depend on it."""

    def __init__(self, limit: int, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        """make: the runs of distinct words, one after the other, and the size of each."""
        self.limit, self.make = limit, make
        self.names = np.empty((2, 0), np.uint64)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.uint16), 0

    def runs(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """The runs of all words, which single spaces part, one after the other, and the size of each."""
        data = np.frombuffer(words.encode("utf-8", "surrogatepass") + b" ", np.uint8)
        ends = word_ends(data)
        names = np.array(word_hashes(data, ends, 2))
        _, first, inverse = np.unique(names[0], return_index=True, return_inverse=True)
        distinct = names[:, first]
        if (distinct[1][inverse] != names[1]).any():
            # Two words share their first hash: told apart by both.
            _, first, inverse = np.unique(names, axis=1, return_index=True, return_inverse=True)
            distinct = names[:, first]
        at = np.searchsorted(self.names[0], distinct[0])
        near = np.minimum(at, max(0, self.names.shape[1] - 1))
        # Only the first word of a first hash is kept in the table; others are worked out anew.
        same = self.names[:, near] == distinct if self.names.shape[1] else np.zeros(distinct.shape, bool)
        held = same.all(0)
        begin, size = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        begin[held], size[held] = self.begin[near[held]], self.size[near[held]]
        new, pool = np.flatnonzero(~held), self.pool
        if len(new):
            raw = data.tobytes()
            stops = ends[first[new]]
            starts = np.where(first[new] > 0, ends[first[new] - 1] + 1, 0)
            more, size[new] = self.make([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
            begin[new] = self.used + np.cumsum(size[new]) - size[new]
            if self.used + len(more) > len(pool):
                pool = np.empty(2 * (self.used + len(more)), np.uint16)
                pool[: self.used] = self.pool[: self.used]
                self.pool = pool
            pool[self.used : self.used + len(more)] = more
            if self.names.shape[1] < self.limit:
                keep = new[~same[0][new] & np.append(True, distinct[0][1:] != distinct[0][:-1])[new]]
                self.names = np.insert(self.names, at[keep], distinct[:, keep], axis=1)
                self.begin, self.size = np.insert(self.begin, at[keep], begin[keep]), np.insert(self.size, at[keep], size[keep])
                self.used += len(more)
        sizes = size[inverse]
        last = np.cumsum(sizes)
        where = np.arange(last[-1] if len(last) else 0) + np.repeat(begin[inverse] - (last - sizes), sizes)
        return pool[where], sizes
