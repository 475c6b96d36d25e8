"""Word-shingle sets of whole texts as 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

K = 5
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1342543DE82EF95)
CHUNK = 1 << 21


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased), and the number of the text each belongs to."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[buffer]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = np.diff(np.append(starts, len(buffer)))
    place = np.arange(starts[0], len(buffer)) - np.repeat(starts, runs)
    powers = np.full(int(runs.max()), _P, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_BYTE[buffer[starts[0] :]] * powers[place], starts - starts[0])
    return mix(sums), np.searchsorted(ends, starts, "right")


def _sets(texts: Sequence[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    words, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    if len(words) >= k:
        total = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            total = total * _Q + words[i : len(words) - k + 1 + i]
        same = owner[: len(total)] == owner[k - 1 :]
        hashes, of = mix(total[same], 1), owner[: len(total)][same]
    else:
        hashes, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # fewer words than a shingle: all of them are one
        at = np.searchsorted(owner, short)
        whole = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            on = i < n[short]
            whole[on] = whole[on] * _Q + words[at[on] + i]
        hashes, of = np.append(hashes, mix(whole + n[short].astype(np.uint64), 2)), np.append(of, short)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[fresh], of[fresh]


def shingle_sets(texts: Sequence[str | None], k: int = K) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, hashes, number of the text of each hash from the first) for runs of about two megabytes."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    start = 0
    while start < len(raw):
        stop, size = start, 0
        while stop < len(raw) and (stop == start or size + len(raw[stop]) <= CHUNK):
            size += len(raw[stop])
            stop += 1
        yield start, stop, *_sets(raw[start:stop], k)
        start = stop
