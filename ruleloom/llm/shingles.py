"""Word shingles as 64-bit hashes, computed for many texts at once in numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]``; only A-Z are lower-cased.  A word's
hash is the sum of mixed numbers drawn for each byte at its place (tabulation), a
shingle's hash mixes those of its words, so that two different shingles share a hash
with probability about 2**-64, unless they are made for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP_BYTES = 1_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The number of a byte at a place of its word."""
    return mix((place.astype(np.uint64) << np.uint64(8) | byte) * STEP + np.uint64(BASE))


NEAR_PLACES = 64
#: The numbers of the first places, which nearly all bytes have.
_TABLE = _drawn(np.repeat(np.arange(NEAR_PLACES), 256), np.tile(np.arange(256, dtype=np.uint8), NEAR_PLACES))


def _numbers(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    out = _TABLE[(np.minimum(place, NEAR_PLACES - 1) << 8) | byte]
    far = np.flatnonzero(place >= NEAR_PLACES)
    if len(far):
        out[far] = _drawn(place[far], byte[far])
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the offsets at which each text's begin."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    offsets = np.searchsorted(starts, begin)
    if not len(starts):
        return np.empty(0, np.uint64), offsets
    spread = np.diff(starts, append=len(data))
    k = np.arange(starts[0], len(data)) - np.repeat(starts, spread)
    value = _numbers(k, data[starts[0] :])
    value[space[starts[0] :]] = 0
    return mix(np.add.reduceat(value, starts - starts[0])), offsets


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A shorter text is one shingle, one without words has none.
    """
    step = mix(np.array([width], np.uint64))[0]
    group: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        group.append(text.encode("utf-8", "surrogatepass").lower() if text else b"")
        held += len(group[-1])
        if held < GROUP_BYTES and i + 1 < len(texts):
            continue
        words, at = word_hashes(group)
        n = len(words) - width + 1
        if n > 0:
            rolled = np.full(n, step, np.uint64)
            for j in range(width):
                rolled = mix(rolled * STEP + words[j : j + n])
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                one = np.array([b - a], np.uint64)
                for j in range(a, b):
                    one = mix(one * STEP + words[j : j + 1])
                yield one
            else:
                yield np.empty(0, np.uint64)
        group, held = [], 0
