"""Hashes of all windows of a text whose width is a power of two, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd
_ALL = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTES = mixed(np.arange(1, 257, dtype="uint64"))


def window_hashes(data: np.ndarray, widths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the ascending widths the hash of the window at every byte where one fits.

    A window's hash is a polynomial of its bytes; that of twice the width follows from two halves.
    """
    hashes, width, factor = _BYTES[data], 1, _BASE
    for wanted in widths:
        while width < wanted and len(hashes) > width:
            hashes = hashes[:-width] * np.uint64(factor) + hashes[width:]
            width, factor = 2 * width, factor * factor & _ALL
        yield wanted, mixed(hashes) if width == wanted else np.empty(0, "uint64")


def widest(size: int) -> int:
    """The largest power of two up to a size of 1 or more."""
    return 1 << size.bit_length() - 1
