"""A bit map of fixed size that screens rows before a join.

It has 2**MAP_BITS bits whatever it is made from, so shipping it to every task is
bounded; filled beyond use it lets every row through, and the join that follows
stays right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 4 MB.
MAP_BITS = 25
CHUNK_BITS = 13
U = np.uint64


def bit_map(hashes: DataFrame) -> bytes:
    """The map of a frame's one column of 64-bit hashes, gathered as chunks of fixed size and number."""
    (column,) = hashes.columns

    def run(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << CHUNK_BITS, np.uint8)
        bits[rows.column("bit").to_numpy() & ((1 << CHUNK_BITS) - 1)] = 1
        held = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"chunk": rows.column("chunk")[:1], "bits": pa.array([held], pa.binary())})

    bit = F.shiftrightunsigned(column, 64 - MAP_BITS)
    marked = hashes.select(bit.alias("bit"), F.shiftright(bit, CHUNK_BITS).alias("chunk")).distinct()
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    for chunk, held in marked.groupBy("chunk").applyInArrow(run, "chunk long, bits binary").collect():
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(held, np.uint8)
    return out.tobytes()


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be one of those that the map was made from."""
    bit = (hashes >> U(64 - MAP_BITS)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
