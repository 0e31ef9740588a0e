"""Word-shingle sets as sorted 64-bit hashes, computed on whole texts with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 40_093
_rng = np.random.default_rng(SEED)
BASE = 0x9E37_79B9_7F4A_7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# A value for each byte, the same for capital and small ASCII letters, none for white space.
VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
VALUE[ord("A"):ord("Z") + 1] = VALUE[ord("a"):ord("z") + 1]
VALUE[SPACE] = 0
# Sums of powers modulo 2^64 are weak on long words with a regular pattern, so longer words are hashed by their bytes.
LONG_WORD = 16
SHORT = _rng.integers(1, 2**63, 64, dtype=np.uint64)


class _Powers:
    """Powers of ``BASE`` and of its inverse, as many as the longest text so far needs."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            for name, factor in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8_FEB8_6659_FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB2_1C65_1E98_DF25)
    return x ^ (x >> np.uint64(32))


def word_hashes(body: bytes) -> np.ndarray:
    """A hash of every word (runs of anything but ASCII white space), A-Z taken as a-z."""
    codes = np.frombuffer(body, dtype=np.uint8)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[codes]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _Powers.upto(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(VALUE[codes] * up[:len(codes)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        lower = body.lower()  # of bytes: just A-Z
        hashes[long] = [xxhash.xxh3_64_intdigest(lower[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return hashes


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingles of ``words`` words; of a shorter text, all its words as one; none without words."""
    hashes = word_hashes((text or "").encode("utf-8", "replace"))
    n = len(hashes)
    if not n:
        return hashes
    size = min(words, n)
    joined = hashes[:n - size + 1]
    for k in range(1, size):
        joined = mix(joined) + hashes[k:n - size + 1 + k]
    if size < words:
        joined = joined ^ SHORT[size]
    return np.unique(mix(joined))
