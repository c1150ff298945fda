"""Exact deduplication of a new batch against an immutable snapshot.

Every text is read once for its digest; the digests are written, and all grouping works on them.
The snapshot's digests are dealt into shards, and each shard gets a static binary
fuse filter.  The new batch is grouped by digest by itself; its distinct digests are
screened by the filters, and the positives alone join the snapshot's exact buckets,
where the bytes of the two representatives are compared.

Defined results: a null text equals the empty one; of equal texts the row with the
largest ``doc_id`` stays, a null id counting as smaller than any other; of repeated
rows with that id, one stays; only ``doc_id`` and ``text`` are read, so other columns
cannot clash; empty tables, snapshots or batches give their plain result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.llm import fuse
from ebbflow.llm.common import blocks_for, lower_ascii, table, whole_text, written
from ebbflow.llm.screening import bit_map, passes

#: Digests in one shard of the snapshot, about: a filter of it takes 1.2 bytes each.
SHARD_DIGESTS = 200_000


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(lower_ascii(text), 256))


def grouped(rows: DataFrame, n_shards: int) -> DataFrame:
    """One row for each digest: representative, rows, the filter's key and shard."""
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("rep"), F.count("*").alias("n"))
    key = F.xxhash64("digest")
    return groups.withColumn("key", key).withColumn("shard", F.pmod(key, F.lit(n_shards)))


def snapshot_filters(snapshot: DataFrame) -> DataFrame:
    """shard, filter (binary): one static filter for each shard of the grouped snapshot."""

    def run(keys: pa.Table) -> pa.Table:
        held = keys.column("key").to_numpy().view(np.uint64)
        return pa.table({"shard": keys.column("shard")[:1], "filter": pa.array([fuse.build(held)], pa.binary())})

    return snapshot.select("shard", "key").groupBy("shard").applyInArrow(run, "shard long, filter binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of the grouped batch whose digest the snapshot may hold."""
    fields = ["digest", "rep", "n", "shard", "key"]

    def run(rows: pa.Table, blob: pa.Table) -> pa.Table:
        if not blob.num_rows or not rows.num_rows:
            return rows.slice(0, 0).select(fields[:3])
        keys = rows.column("key").to_numpy().view(np.uint64)
        maybe = fuse.contains(blob.column("filter")[0].as_py(), keys)
        return rows.filter(pa.array(maybe)).select(fields[:3])

    return (
        batch.select(*fields)
        .groupBy("shard")
        .cogroup(filters.groupBy("shard"))
        .applyInArrow(run, "digest binary, rep long, n long")
    )


def fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest, doc_id, bytes of the wanted rows (doc_id, digest); a bit map of their ids keeps the other texts from the shuffle."""
    screen = bit_map(wanted.select(F.xxhash64("doc_id").alias("hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(screen, np.uint8)
        for batch in batches:
            may = np.flatnonzero(passes(bits, batch.column(2).to_numpy().view(np.uint64)))
            if len(may):
                yield batch.select(["doc_id", "text"]).take(pa.array(may))

    hashed = texts.select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
    found = hashed.mapInArrow(run, "doc_id long, text string").withColumn("digest", digest_of(F.col("text")))
    return found.join(wanted, ["doc_id", "digest"]).select("digest", "doc_id", lower_ascii(F.col("text")).alias("bytes"))


def classes(docs: DataFrame, is_new: Column) -> tuple[DataFrame, DataFrame]:
    """The keyed rows (doc_id, digest, new, nth) and, for each (digest, new), keep_id and group_size."""
    new_row = F.coalesce(is_new, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), new_row.alias("new"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest", "new").orderBy(F.lit(1)))
    rows = written(texts.select("doc_id", digest_of(F.col("text")).alias("digest"), "new"), "digests")
    n_shards = blocks_for(rows.count(), SHARD_DIGESTS)
    old = grouped(rows.where(~F.col("new")), n_shards)
    new = grouped(rows.where("new"), n_shards)
    maybe = screen(new, snapshot_filters(old)).alias("b")
    met = maybe.join(old.alias("a"), "digest").select(
        "digest",
        F.col("a.rep").alias("old_rep"),
        F.col("b.rep").alias("new_rep"),
        (F.col("a.n") + F.col("b.n")).alias("both"),
    )
    met = written(met, "met")
    wanted = met.select("digest", F.explode(F.array("old_rep", "new_rep")).alias("doc_id")).where("doc_id IS NOT NULL")
    told = fetched(texts, wanted.distinct())
    compared = told.groupBy("digest").agg((F.min("bytes") == F.max("bytes")).alias("same"))
    same = (
        met.join(compared, "digest", "left")
        .where(F.coalesce("same", F.lit(True)))  # rows without ids have no text to fetch by
        .select("digest", F.greatest("old_rep", "new_rep").alias("keep_id"), F.col("both").alias("group_size"))
    )
    alone = old.select("digest", F.lit(False).alias("new"), "rep", "n").unionByName(
        new.select("digest", F.lit(True).alias("new"), "rep", "n")
    )
    merged = alone.join(same, "digest", "left").select(
        "digest",
        "new",
        F.coalesce("keep_id", "rep").alias("keep_id"),
        F.coalesce("group_size", "n").alias("group_size"),
    )
    return rows.withColumn("nth", nth), merged


def exact_dedup(docs: DataFrame, is_new: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows, merged = classes(docs, is_new)
    return rows.join(merged, ["digest", "new"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, is_new: Column) -> DataFrame:
    """The rows that stay, with all their columns."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    rows = docs.select(F.struct("*").alias("row"), *key, digest_of(whole_text()).alias("digest"))
    nth = F.row_number().over(Window.partitionBy("id", "none", "digest").orderBy(F.lit(1)))
    first = rows.withColumn("nth", nth).where("nth = 1")
    kept = exact_dedup(docs, is_new).where("kept").select(*key, F.unhex("text_sha256").alias("digest"))
    return first.join(kept, ["id", "none", "digest"], "left_semi").select("row.*")


def second_half(column: str = "doc_id") -> Column:
    """Deals rows into a snapshot and a new batch by the hash of their id."""
    return F.pmod(F.xxhash64(column), F.lit(2)) == 1


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, the row that stays of its equal texts."""
    return exact_dedup(table(spark, sf_dir, "documents"), second_half())


UPPER_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, sha256({UPPER_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
