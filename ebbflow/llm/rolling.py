"""Polynomial hashes of windows over arrays of 64-bit values, by prefix sums."""

from __future__ import annotations

import numpy as np

U = np.uint64
STEP = 0x9E3779B97F4A7C15
STEP_BACK = pow(STEP, -1, 1 << 64)


class Powers:
    """Powers of an odd step and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self, step: int = STEP):
        self.step, self.back = U(step), U(pow(step, -1, 1 << 64))
        self.up = self.down = np.zeros(0, U)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(self.step, 2 * n), powers(self.back, 2 * n)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over the others."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def prefixes(values: np.ndarray, table: Powers) -> np.ndarray:
    """Prefix sums of value times step to its place; n + 1 of them."""
    table.grow(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * table.up[: len(values)], out=out[1:])
    return out


def windows(prefix: np.ndarray, width: int, table: Powers) -> np.ndarray:
    """The hash of every window of ``width`` values; none if there are fewer."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, U)
    return mix((prefix[width:] - prefix[:n]) * table.down[:n])
