"""Word shingles as 64-bit numbers, computed over whole texts with NumPy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~_SPACE
_STEP = U(0x9E3779B97F4A7C15)
_MULTIPLIERS = (U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = np.array(x, U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=U) * _STEP)  # a random number for each byte value
_BASE = _MULTIPLIERS[0]
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, at least ``n`` of them."""
    if int(base) not in _powers or len(_powers[int(base)]) < n:
        steps = np.full(1 << max(10, (n - 1).bit_length()), base, U)
        steps[0] = 1
        _powers[int(base)] = np.multiply.accumulate(steps)
    return _powers[int(base)]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words (runs without ASCII white space) of UTF-8 bytes."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def sequence_numbers(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each run of ``values``: differences of one running sum, moved to a common place.

    The sum weighs each place by a power of an odd base, which has an inverse modulo 2**64.
    """
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(_BASE, len(values))[:len(values)], out=total[1:])
    return mixed((total[ends] - total[begins]) * powers(_INVERSE, len(values))[begins] + (ends - begins).astype(U))


def run_numbers(values: np.ndarray, k: int) -> np.ndarray:
    """``sequence_numbers`` of each run of ``k`` values."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(_BASE, len(values))[:len(values)], out=total[1:])
    return mixed((total[k:] - total[:-k]) * powers(_INVERSE, len(values))[:len(values) - k + 1] + U(k))


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word of lower-cased UTF-8 bytes, with begins and ends."""
    begins, ends = word_bounds(raw)
    if not len(begins):
        return np.zeros(0, U), begins, ends
    return sequence_numbers(_BYTE[raw], begins, ends), begins, ends


def word_numbers(text: str) -> np.ndarray:
    """A number for each word of a text, A-Z lower-cased."""
    return words_of(np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8))[0]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of ``k`` words."""
    total = np.full(len(words) - k + 1, U(k), U)
    for weight, i in zip(powers(_MULTIPLIERS[1], k), range(k)):
        total += words[i:len(words) - k + 1 + i] * weight
    return mixed(total)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of ``k`` words; fewer words make one shingle of them all."""
    return np.unique(windows(words, min(k, len(words)))) if len(words) else words


def signature(shingles: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """One-permutation minima of a sorted set, densified; a bin for each row of ``probes``.

    Shingles are uniform already, so equal ranges of values are the bins and the first shingle
    of a range is its minimum. An empty bin takes that of the first filled bin on its own
    fixed random sequence (optimal densification: its choices are independent across bins).
    """
    bins = len(probes)
    width = (1 << 64) // bins
    floors = np.array([i * width for i in range(bins)], U)
    at = np.searchsorted(shingles, floors)
    stop = np.append(at[1:], len(shingles))
    filled = at < stop
    out = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    for few in (8, probes.shape[1]):
        if len(empty):
            hit = filled[probes[empty, :few]]
            found = hit.any(axis=1)
            out[empty[found]] = out[probes[empty[found], hit[found].argmax(axis=1)]]
            empty = empty[~found]
    if len(empty):  # no luck in the whole sequence: the next filled bin upwards, around
        full = np.flatnonzero(filled)
        out[empty] = out[full[np.searchsorted(full, empty) % len(full)]]
    return out


def probe_table(bins: int, tries: int = 512) -> np.ndarray:
    """For each bin its sequence of bins to borrow from."""
    seeds = np.arange(bins * tries, dtype=U).reshape(bins, tries)
    return (mixed(seeds * _STEP + _MULTIPLIERS[3]) % U(bins)).astype(np.int64)


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of ``rows`` minima; keys of different bands never meet."""
    bands = minima.reshape(-1, rows)
    total = mixed(np.arange(1, len(bands) + 1, dtype=U) * _STEP)
    for i in range(rows):
        total = mixed(total * _MULTIPLIERS[1] + bands[:, i])
    return total
