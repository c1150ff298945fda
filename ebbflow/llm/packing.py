"""Token ids packed into rows of fixed length by best-fit decreasing.

Documents are dealt into shards of about ``SHARD_BYTES`` of text by a hash.  Within a
shard, a document's ids (and one end id) are cut into pieces of at most ``length``
tokens; pieces go, longest first, into the open row that they leave fullest.  That row
is found in a segment tree over the capacities 0 to ``length``: its leaves say whether
a row has just that much room left, and one descent finds the least room that is enough.
A packed row holds its ids, padded, the cumulative lengths of its segments and, for
every token, its position within its segment.

Defined results: a null or empty text is its end id alone, so every document is found in
the rows; a document of any length is cut without loss, and ``starts`` says where in its
document each segment begins; repeated rows are packed each; a null ``doc_id`` stays null
in the lists; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Callable, Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import blocks_for, table, whole_text

LENGTH = 2048
SHARD_BYTES = 8 << 20
#: Free in the vocabulary used here: the end of a document, and padding.
END_ID = 50256
PACKED = (
    "shard long, row long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>,"
    " ids binary, positions binary"
)


class Capacities:
    """Segment tree over room left: the open rows by what still fits into them."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.held = [0] * (2 * self.leaves)  # rows below each node
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self.count(room, 1)

    def count(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.held[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least ``need``, taken out of the tree."""
        node = need + self.leaves
        if not self.held[node]:
            while node > 1 and (node & 1 or not self.held[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.held[2 * node])
        room = node - self.leaves
        self.count(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; no row's sizes add up to more than ``length``."""
    tree, rows = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(i)
        tree.add(room - sizes[i], row)
    return rows


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def pack_shard(shard: int, doc_ids: list, tokens: list[np.ndarray], length: int, end_id: int) -> Iterator[tuple]:
    """The packed rows of a shard's documents, whose order decides ties."""
    pieces = [(d, at) for d, ids in enumerate(tokens) for at in range(0, len(ids), length)]
    sizes = [min(length, len(tokens[d]) - at) for d, at in pieces]
    for row, held in enumerate(best_fit_decreasing(sizes, length)):
        ids = np.full(length, end_id, np.int32)
        positions = np.zeros(length, np.int32)
        ends = np.cumsum([0, *(sizes[i] for i in held)]).astype(np.int32)
        for i, start, end in zip(held, ends, ends[1:]):
            d, at = pieces[i]
            ids[start:end] = tokens[d][at : at + end - start]
            positions[start:end] = np.arange(end - start)
        yield (
            shard,
            row,
            int(ends[-1]),
            [doc_ids[pieces[i][0]] for i in held],
            [pieces[i][1] for i in held],
            ends.tolist(),
            ids.astype("<i4").tobytes(),
            positions.astype("<i4").tobytes(),
        )


def schema() -> pa.Schema:
    whole, lists = pa.int64(), pa.list_(pa.int64())
    names = [f.split()[0] for f in PACKED.split(", ")]
    kinds = [whole, whole, pa.int32(), lists, lists, pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.schema(list(zip(names, kinds, strict=True)))


def pack(
    docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The packed rows of all documents (columns: PACKED)."""
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    total = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    n_shards = blocks_for(total or 0, shard_bytes)
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)))

    def run(rows: pa.Table) -> pa.Table:
        encode = encoder(path)
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        tokens = [np.array([*encode(t.as_py()), end_id], np.int32) for t in rows.column("text")]
        shard = rows.column("shard")[0].as_py()
        packed = pack_shard(shard, rows.column("doc_id").to_pylist(), tokens, length, end_id)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*packed, strict=True), schema(), strict=True)], schema())

    return dealt.groupBy("shard").applyInArrow(run, PACKED)


def write_matrices(packed: DataFrame, root: str, length: int = LENGTH) -> DataFrame:
    """Writes, for each shard, its ids, positions and cumulative lengths as .npy files below ``root``.

    Files get temporary names first and their final ones at the end, so a repeated
    attempt replaces whole files by equal ones.  Returns shard, rows, path.
    """

    def save(files: fs.FileSystem, path: str, matrix: np.ndarray) -> None:
        out, temporary = io.BytesIO(), f"{path}.{uuid4().hex}.tmp"
        np.save(out, matrix)
        with files.open_output_stream(temporary) as f:
            f.write(out.getvalue())
        files.move(temporary, path)

    def run(rows: pa.Table) -> pa.Table:
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        rows = rows.sort_by("row")
        shard = rows.column("shard")[0].as_py()
        name = f"{base}/shard-{shard:08d}"
        for kind in ("ids", "positions"):
            flat = b"".join(rows.column(kind).to_pylist())
            save(files, f"{name}.{kind}.npy", np.frombuffer(flat, "<i4").reshape(-1, length))
        lengths = rows.column("cu_seqlens").to_pylist()
        save(files, f"{name}.cu_seqlens.npy", np.concatenate([np.array(x, np.int32) for x in lengths]))
        save(files, f"{name}.segments.npy", np.array([len(x) - 1 for x in lengths], np.int32))
        return pa.table({"shard": pa.array([shard], pa.int64()), "rows": pa.array([rows.num_rows], pa.int64()), "path": [name]})

    return packed.groupBy("shard").applyInArrow(run, "shard long, rows long, path string")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, packed into rows of one length."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
