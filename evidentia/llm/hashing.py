"""Hashes of all words of a text at once, on numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

GAMMA = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def mix_into(x: np.ndarray, spare: np.ndarray) -> None:
    """mix, in x itself; spare: an array of its shape to work in."""
    for shift, factor in ((30, M1), (27, M2), (31, None)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor is not None:
            np.multiply(x, factor, out=x)


def runs(raw: bytes, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of bytes of raw that aren't gaps (a boolean for each byte).

    Up to 16 bytes a hash depends on every byte and the length; longer runs, which are rare in prose, are hashed one by one.
    """
    wide = np.ones(len(gap) + 2, bool)
    wide[1:-1] = gap
    edges = np.flatnonzero(wide[1:] != wide[:-1])
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    padded = bytes(8) + raw + bytes(8)
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = eights[starts + 8] & _FIRST_BYTES[np.minimum(size, 8)]
    longer = np.flatnonzero(size > 8)
    h[longer] += mix(eights[ends[longer]])
    for i in np.flatnonzero(size > 16):
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return starts, mix(h * GAMMA + size.astype(np.uint64))
