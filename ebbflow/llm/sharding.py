"""Hierarchical weighted hash tree: rows descend region, rack and shard.

At every node the children draw ``ln(u) / weight`` with ``u`` a hash of the row's
key and the child's path, and the largest draw wins.  A draw depends on nothing
but the key, the path and the child's own weight, so when weights change, rows
move only into subtrees that gained weight (or out of those that lost it).  A
new shard gets a region and rack of its own (``grow``): no other subtree changes
weight, hence rows move into the new shard alone.

Everything is DataFrame code.  Defined results: a null text has no bytes (size 1,
CRC 0); a null ``doc_id`` is keyed by the hash of its text; repeated rows share
shard and key but get slots of their own; other columns are not read, so their
names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import blocks_for, table, whole_text

#: Rows that number their slots in one window partition, on average.
SLOT_BLOCK_ROWS = 50_000
HASH_HEX = 12


@dataclass(frozen=True, order=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, per_rack: int = 2, racks_per_region: int = 2) -> list[Shard]:
    """Equal shards, ``per_rack`` to a rack and ``racks_per_region`` racks to a region."""
    return [
        Shard(s // (per_rack * racks_per_region), s // per_rack % racks_per_region, s)
        for s in range(n_shards)
    ]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own."""
    return [
        *tree,
        Shard(max((s.region for s in tree), default=-1) + 1, 0, max((s.shard for s in tree), default=-1) + 1, weight),
    ]


def draw(key: Column, path: str, weight: float) -> Column:
    digest = F.md5(F.concat_ws("/", F.lit(path), key.cast("string")))
    u = (F.conv(F.substring(digest, 1, HASH_HEX), 16, 10).cast("double") + 0.5) / float(16**HASH_HEX)
    return F.log(u) / weight


def winner(key: Column, children: list[tuple[int, str, float]]) -> Column:
    """The id of the child with the largest draw, the larger id on a tie."""
    drawn = [F.struct(draw(key, path, w).alias("d"), F.lit(i).alias("i")) for i, path, w in children]
    return (F.greatest(*drawn) if len(drawn) > 1 else drawn[0])["i"]


def descend(df: DataFrame, key: str, tree: list[Shard], out: str) -> DataFrame:
    """Adds ``out``, the shard that the row's key reaches in ``tree``."""
    tree = sorted(s for s in tree if s.weight > 0)
    if not tree:
        raise ValueError("the tree holds no shard with a positive weight")
    regions = {r: list(g) for r, g in groupby(tree, lambda s: s.region)}
    racks = {rr: list(g) for rr, g in groupby(tree, lambda s: (s.region, s.rack))}
    weight = lambda shards: sum(s.weight for s in shards)
    k = F.col(key)
    df = df.withColumn("_region", winner(k, [(r, f"{r}", weight(g)) for r, g in regions.items()]))
    rack: Column = F.lit(None).cast("int")
    for r in regions:
        held = [(b, f"{r}/{b}", weight(g)) for (a, b), g in racks.items() if a == r]
        rack = F.when(F.col("_region") == r, winner(k, held)).otherwise(rack)
    df = df.withColumn("_rack", rack)
    shard: Column = F.lit(None).cast("int")
    for (r, b), g in racks.items():
        held = [(s.shard, f"{r}/{b}/{s.shard}", s.weight) for s in g]
        shard = F.when((F.col("_region") == r) & (F.col("_rack") == b), winner(k, held)).otherwise(shard)
    return df.withColumn(out, shard).drop("_region", "_rack")


def shard_documents(docs: DataFrame, tree: list[Shard], grown: list[Shard]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots are numbered within (shard, block) and offset by the row counts of the
    shard's earlier blocks, so no window holds more than a block's rows.
    """
    n_blocks = blocks_for(docs.count(), SLOT_BLOCK_ROWS)
    utf8 = F.encode(whole_text(), "UTF-8")
    rows = docs.select("doc_id", "text").select(
        "doc_id",
        (F.octet_length(whole_text()).cast("long") + 1).alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("_key"),
    )
    rows = descend(descend(rows, "_key", tree, "shard"), "_key", grown, "grown_shard")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key", "text_crc32"), F.lit(n_blocks)))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "_block")
        .agg(F.count("*").alias("_n"))
        .select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("shard", "_block").orderBy("_key", "size", "text_crc32")
    return (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_offset") + F.col("_rank")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, and its shard with one more."""
    tree = topology(8)
    return shard_documents(table(spark, sf_dir, "documents"), tree, grow(tree))
