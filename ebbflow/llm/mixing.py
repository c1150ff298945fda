"""Sources mixed to target weights: blocks of equal tokens, apportioned by Sainte-Laguë.

1. Sources share the mix by weight; none gets more than ``MOST`` times what it has, and
   what a source cannot take is shared by weight among the others, until it fits (``targets``).
2. A source's words make blocks of about ``BLOCK_WORDS``, and the mix is as many blocks as its
   words fill.  Highest quotients give each source a whole number of them (``apportion``).
3. A source's rows, in an order drawn by a seed, are cut into shards, and the source's
   blocks are apportioned among its shards in the same way.
4. Within a shard the words of its rows lie end to end and are cut into equal blocks.  A quota of q of b
   blocks takes each ``q div b`` times, and ``q mod b`` of them, drawn by the seed, once more
   (``taken_in``).  A document's words are taken as often as the blocks over them.

Sources of any size only add shards, and a task holds the sizes of one shard's rows.

Defined results: a null text has no words; a document without words has nothing taken; a null
source is a source of its own and comes last; repeated rows are documents each; rows that share
a null or equal ``doc_id`` and size are alike, so reruns agree; other columns are not read; an
empty table gives an empty result, a source without words the target 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.apportion import sainte_lague
from ebbflow.llm.common import table, whole_text, written
from ebbflow.llm.ranks import ranked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: Times that a word may be taken.
MOST = 2
BLOCK_WORDS = 16
#: Rows in one shard.
SHARD_ROWS = 2048
SEED = 20_111
#: Blocks drawn at a time within a shard: what bounds a task's memory on very long texts.
DRAWN = 1 << 20
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(whole_text()).alias("size"))


def source_key(source: Column) -> Column:
    """A string that orders sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to sources (size, weight): each round shares by weight what full sources leave."""
    level = held = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= F.col("size") * most
        got = sources.agg(
            F.sum("size").alias("all"),
            F.sum(F.when(full, F.col("size") * most).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not got["all"] or not got["weight"] or held == got["weight"]:
            break
        held = got["weight"]
        level = (share * got["all"] - got["full"]) / got["weight"]
    most_words = (F.col("size") * most).cast("double")
    return sources.withColumn("target", most_words if level is None else F.least(most_words, F.col("weight") * F.lit(level)))


def sharded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, doc_id, size, shard, place) of every row; (key, source number, size, weight) of every source."""
    sizes = written(measured(docs).withColumn("key", source_key(F.col("source"))).drop("source"), "sizes")
    drawn = F.xxhash64("doc_id", F.lit(SEED))
    rows = ranked(sizes, [F.col("key"), drawn, F.col("doc_id").asc_nulls_first(), F.col("size")], "drawn")
    sources = rows.groupBy("key").agg(F.min("rank").alias("first"), F.sum("size").alias("size"))
    sources = ranked(written(sources, "sources"), [F.col("key")], "sources").withColumnRenamed("rank", "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source") % len(WEIGHTS) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight), "sources")
    at = F.col("rank") - F.col("first")
    named = rows.join(sources.select("key", "source", "first"), "key")
    return (
        named.select("source", "doc_id", "size", F.floor(at / SHARD_ROWS).alias("shard"), at.alias("place")),
        sources.select("source", "size", "weight"),
    )


def apportion(shards: DataFrame, sources: DataFrame) -> DataFrame:
    """source, shard, blocks, quota: blocks are dealt to sources, and a source's to its shards."""
    by_source = shards.groupBy("source").agg(F.sum("blocks").alias("blocks"))
    own_blocks = F.col("target") * F.col("blocks") / F.col("size")  # the target in blocks of the source's own length
    parties = by_source.join(sources, "source").select(
        F.lit(0).alias("grp"),
        F.col("source").alias("party"),
        F.when(F.col("size") > 0, own_blocks).alias("votes"),
        (F.col("blocks") * MOST).alias("cap"),
    )
    parties = written(parties, "source-blocks")
    seats = parties.groupBy("grp").agg(F.round(F.sum("votes")).cast("long").alias("seats"))
    quotas = written(sainte_lague(parties, seats), "source-quotas")
    of_shards = shards.select(
        F.col("source").alias("grp"),
        F.col("shard").alias("party"),
        F.col("blocks").cast("double").alias("votes"),
        (F.col("blocks") * MOST).alias("cap"),
    )
    dealt = sainte_lague(of_shards, quotas.select(F.col("party").alias("grp"), F.col("quota").alias("seats")))
    return dealt.select(F.col("grp").alias("source"), F.col("party").alias("shard"), "quota").join(shards, ["source", "shard"])


def drawn_blocks(numbers: np.ndarray, blocks: int, more: int, seed: int) -> np.ndarray:
    """Which blocks are among the ``more`` of ``blocks`` drawn by the seed: a seeded walk through all of them."""
    step = seed % blocks | 1
    while math.gcd(step, blocks) > 1:
        step += 2
    return ((numbers * (step % blocks) + seed // blocks % blocks) % blocks) < more


def taken_in(sizes: np.ndarray, blocks: int, quota: int, seed: int) -> np.ndarray:
    """Words taken of each of a shard's rows, whose words lie end to end in ``blocks`` equal blocks."""
    times, more = divmod(quota, blocks) if blocks else (0, 0)
    taken = sizes * times
    if not more:
        return taken
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    covered = np.zeros(len(sizes) + 1, np.int64)  # words of drawn blocks before each row's end
    before = 0
    for first in range(0, blocks, DRAWN):
        numbers = np.arange(first, min(first + DRAWN, blocks) + 1, dtype=np.int64)
        edges = numbers * total // blocks
        drawn = drawn_blocks(numbers[:-1], blocks, more, seed)
        sums = before + np.concatenate([[0], np.cumsum(np.where(drawn, np.diff(edges), 0))])
        here = np.flatnonzero((ends > edges[0]) & (ends <= edges[-1]))
        block = np.searchsorted(edges, ends[here], side="left") - 1
        covered[here + 1] = sums[block] + np.where(drawn[block], ends[here] - edges[block], 0)
        before = int(sums[-1])
    covered = np.maximum.accumulate(covered)  # a row without words ends where the one before it does
    return taken + np.diff(covered)


def seeded(source: int, shard: int) -> int:
    """A number from 0 to 2**62 for each shard."""
    x = (source * 0x9E3779B97F4A7C15 + shard * 0xC2B2AE3D27D4EB4F + SEED) & (2**64 - 1)
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 & (2**64 - 1)
    return (x ^ x >> 27) * 0x81DADEF4BC2DD44D >> 2 & (2**62 - 1)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows, sources = sharded(docs)
    sources = written(targets(sources), "targets")
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / BLOCK_WORDS).cast("long"))).otherwise(0)
    shards = written(shards.withColumn("blocks", blocks.cast("long")), "shards")
    quotas = written(apportion(shards, sources), "quotas")
    told = quotas.join(sources.withColumnRenamed("size", "source_size"), "source")

    def run(rows: pa.Table, quota: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        own = quota.to_pylist()[0]
        sizes = rows.column("size").to_numpy()
        taken = taken_in(sizes, own["blocks"], own["quota"], seeded(own["source"], own["shard"]))
        n = len(sizes)
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "size": rows.column("size"),
                "source_size": pa.array([own["source_size"]] * n, pa.int64()),
                "target": pa.array([own["target"]] * n, pa.float64()),
                "taken": pa.array(taken, pa.int64()),
            }
        )

    return (
        rows.groupBy("source", "shard")
        .cogroup(told.select("source", "shard", "blocks", "quota", "source_size", "target").groupBy("source", "shard"))
        .applyInArrow(run, "doc_id long, size long, source_size long, target double, taken long")
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of weighted sources takes of every document."""
    return mix(table(spark, sf_dir, "documents"))
