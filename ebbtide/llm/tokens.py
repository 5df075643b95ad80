"""Words and word shingles of many texts at once, as arrays of 64-bit hashes.

A batch of texts is one byte buffer. Word borders come from a table of white space, and the hash
of a word from a prefix sum of `byte * BASE**position` modulo 2**64, so nothing here loops over
words or characters. Only A-Z are lower-cased, only ASCII white space parts words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C55, pow(0x9E3779B97F4A7C55, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: Bytes that are hashed at once; longer single texts are taken alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit (splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def chunks(column: pa.Array, size: int = CHUNK
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of successive runs of texts of about `size` bytes."""
    raw, offs = buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, to, raw[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


class Words:
    """hash, start and end of each word, and `at`: the words of text i are at[i]:at[i + 1]."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        n = len(raw)
        self.low = _LOWER[raw]
        inside = ~_SPACE[raw]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        before &= ~first[:n]
        after &= ~first[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        power, inverse = _power(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((self.low.astype(U) + U(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.at = np.searchsorted(self.start, offs)

    def text(self, i: int) -> bytes:
        return self.low[self.start[i]:self.end[i]].tobytes()


def word_hash(word: str) -> np.uint64:
    """The hash that `Words` gives a single word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)])).hash[0]


_STEP = [U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(16)]


def shingles(words: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words in text order, and their borders by text.

    A text of fewer words has one run, the whole of it; a text without words has none.
    """
    n, many = len(words), np.diff(at)
    full = np.zeros(max(0, n - size + 1), U)
    for k in range(size):
        full += words[k:k + len(full)] * _STEP[k]
    counts = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    to = np.zeros(len(at), np.int64)
    np.cumsum(counts, out=to[1:])
    pick = np.arange(to[-1]) - np.repeat(to[:-1], counts) + np.repeat(at[:-1], counts)
    out = np.zeros(to[-1], U)
    short = np.repeat(many < size, counts)
    out[~short] = full[pick[~short]]
    for doc in np.flatnonzero((many < size) & (many > 0)):
        run = words[at[doc]:at[doc + 1]]
        out[to[doc]] = U((sum(int(w) * int(_STEP[k]) for k, w in enumerate(run))
                          + 7919 * len(run)) & 0xFFFFFFFFFFFFFFFF)
    return mix(out), to


def run_hashes(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` values that begins at `starts`."""
    power, inverse = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[:len(values)], out=total[1:])
    return mix((total[starts + size] - total[starts]) * inverse[starts])


def distinct(values: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and the new borders."""
    sets = [np.unique(values[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]
    at = np.zeros(len(to), np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, U)), at
