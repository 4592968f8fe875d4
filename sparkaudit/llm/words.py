"""Words of UTF-8 byte buffers as numpy arrays: bounds and 64-bit content hashes.

A word's hash is a polynomial of its (ASCII lower-cased) bytes, read from prefix
sums, so a whole buffer is hashed without a Python loop over words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values (a bijection with good avalanche)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[_LOWER]

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse (mod 2**64)."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * _CHUNK)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def not_space() -> np.ndarray:
    """Bytes of words split at 0x20 and 0x09-0x0D."""
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def alphanumeric() -> np.ndarray:
    """Bytes of words made of ASCII letters, digits and everything beyond ASCII."""
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    return keep


class Words(NamedTuple):
    hash: np.ndarray   # uint64, of the bytes
    start: np.ndarray  # byte bounds in the buffer
    end: np.ndarray
    row: np.ndarray    # which text the word belongs to


def find_words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, code: np.ndarray = LOWER_CODE) -> Words:
    """Maximal runs of ``keep`` bytes inside each text; runs never cross texts.

    ``code`` is BYTE_CODE where letter case counts.
    """
    n = len(data)
    cuts = np.unique(offsets)
    parts, lo = [], 0
    while lo < n:
        hi = min(lo + _CHUNK, n)
        while hi < n and keep[data[hi - 1]] and keep[data[hi]]:  # never split a word
            ahead = np.flatnonzero(~keep[data[hi:hi + _CHUNK]])
            hi = hi + int(ahead[0]) if len(ahead) else min(hi + _CHUNK, n)
        piece = data[lo:hi]
        inside = keep[piece]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        inner = cuts[(cuts >= lo) & (cuts < hi)] - lo
        before[inner] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        up, down = powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(code[piece] * up[:-1], out=total[1:])
        parts.append((mix((total[ends] - total[starts]) * down[starts]), starts + lo, ends + lo))
        lo = hi
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    found, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(found, start, end, np.searchsorted(offsets, start, "right") - 1)


def grams(code: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive values, starting at each position that has them."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + code[i:i + n]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x
