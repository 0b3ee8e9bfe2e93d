"""Words and word shingles of many texts at once, as 64-bit numbers in numpy arrays.

A word is a run of bytes other than the six ASCII white space characters, and only A-Z are
lower-cased; on UTF-8 that is the same as on code points, since every byte of a longer
character is above 127.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE_BYTES = 1 << 20
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x + np.uint64(_GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers fixed by ``seed``."""
    start = (seed * 0xD1342543DE82EF95 + 1) % 2**64
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(start)) | np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` start, and a hash of each."""
    chars = np.frombuffer(data, np.uint8)
    solid = (chars != 32) & ((chars < 9) | (chars > 13))
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    first = np.cumsum(solid)[starts] - 1
    letters = chars[solid].astype(np.uint64) + np.uint64(1)
    lengths = np.diff(first, append=len(letters))
    power = np.full(int(lengths.max()), _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    sums = np.add.reduceat(letters * power[place], first)
    return starts, mix(sums ^ mix(lengths.astype(np.uint64)))


def slices(texts: Iterable[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Lower-cased texts joined to pieces of about a megabyte, with each text's first byte."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        held.append(data)
        size += len(data) + 1
        if size >= SLICE_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[bytes]) -> tuple[bytes, np.ndarray]:
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    return b"\n".join(parts), np.concatenate(([0], np.cumsum(lengths)))


def words_of(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    for data, offsets in slices(texts):
        starts, hashes = word_hashes(data)
        cuts = np.searchsorted(starts, offsets)
        for i in range(len(offsets) - 1):
            yield hashes[cuts[i] : cuts[i + 1]]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` neighbouring words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    factors = constants(k, 7)
    total = hashes[:n] * factors[0]
    for j in range(1, k):
        total += hashes[j : j + n] * factors[j]
    return mix(total)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of shingles of ``k`` words; fewer words make one shingle, none make none."""
    if 0 < len(hashes) < k:
        return mix(rolling(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(rolling(hashes, k))
