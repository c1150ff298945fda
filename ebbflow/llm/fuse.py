"""Binary fuse filter: a static three-slot filter over 64-bit keys.

Built by peeling in rounds of array operations: every slot that one key alone uses
gives that key away; keys of a round own slots that no other remaining key touches,
so each round can be solved at once, last round first.
"""

from __future__ import annotations

import math
import struct

import numpy as np

HEADER = struct.Struct("<QQII")
MAX_SEEDS = 200
U = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys offset by the seed."""
    with np.errstate(over="ignore"):
        x = keys + U(seed)
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


def slots(mixed: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots for each key, in three neighbouring segments."""
    first = ((mixed >> U(32)) * U(segment * segments)) >> U(32)
    mask = U(segment - 1)
    second = (first + U(segment)) ^ ((mixed >> U(18)) & mask)
    third = (first + U(2 * segment)) ^ (mixed & mask)
    return np.stack([first, second, third]).astype(np.int64)


def fingerprints(mixed: np.ndarray) -> np.ndarray:
    return (mixed ^ (mixed >> U(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of the distinct ``keys`` (uint64) as bytes; no keys give an empty filter."""
    keys = np.unique(keys.astype(U))
    n = len(keys)
    if not n:
        return HEADER.pack(0, 0, 0, 0)
    base = max(n, 10)
    segment = 1 << min(18, int(math.log(base) / math.log(3.33) + 2.25))
    capacity = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(base))
    segments = max(1, math.ceil(capacity / segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, MAX_SEEDS):
        mixed = mix(keys, seed)
        own = peel(slots(mixed, segment, segments), size)
        if own is not None:
            table, at = np.zeros(size, np.uint8), slots(mixed, segment, segments)
            prints = fingerprints(mixed)
            for picked, slot in reversed(own):
                three = at[:, picked]
                table[slot] = 0
                table[slot] = prints[picked] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
            return HEADER.pack(n, seed, segment, segments) + table.tobytes()
    raise ValueError(f"no seed below {MAX_SEEDS} peels {n} keys")


def peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that each owns); None if some keys cannot be peeled."""
    n = at.shape[1]
    count = np.bincount(at.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    index = np.arange(n)
    for row in at:
        np.bitwise_xor.at(held, row, index)
    rounds, left = [], n
    lone = np.flatnonzero(count == 1)
    while len(lone):
        picked, where = np.unique(held[lone], return_index=True)
        rounds.append((picked, lone[where]))
        left -= len(picked)
        touched = at[:, picked].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(held, touched, np.tile(picked, 3))
        touched = np.unique(touched)
        lone = touched[count[touched] == 1]
    return None if left else rounds


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never False for a key that is."""
    n, seed, segment, segments = HEADER.unpack_from(blob)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=HEADER.size)
    mixed = mix(keys.astype(U), seed)
    a, b, c = slots(mixed, segment, segments)
    return fingerprints(mixed) == table[a] ^ table[b] ^ table[c]
