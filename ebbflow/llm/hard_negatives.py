"""Hard negatives of anchors, by exact integer scores from Kronecker-packed products.

Components are floored to integers.  A block of candidates is packed component by component:
each component is raised by the block's largest magnitude, so that it is not negative,
and several candidates' raised components are put into separated fields of one wide integer
(``Packed``).  The anchor's component, raised too, multiplies that integer once; the sum
over components holds every candidate's raised score in its own field, none of which can
overflow into the next, and what the raising added is subtracted.  Fields are as wide as the block's values
need: up to 32 bits they share 64-bit words, beyond that Python's own wide integers.

Anchors and candidates are dealt into blocks, and each pair of blocks meets in one task
(a stated query set against all rows).  The first pass keeps each anchor's best rows of
its label, which make its positives; the second keeps, for each anchor and positive, the
best rows of other labels within the positive's window.  A row is copied once for every
``BLOCK_ROWS`` rows of the other side, and only a task's few best rows leave it.

Defined results: a row with a null label or vector, or a null or non-finite component, takes
no part; shorter vectors count as filled up with zeros; a null ``vec_id`` names no
anchor and comes last among ties; repeated rows are rows each, and an anchor's copy is one of
its other rows; scores are compared whatever their size, and one beyond 64 bits
is returned as null; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ebbflow.llm.common import blocks_for, table, written

POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least so many hundredths of its positive.
LEAST_PERCENT = 80
ANCHOR_ONE_IN = 100
MOVED_ONE_IN = 7
SCALE = 256
BLOCK_ROWS = 4096
#: Anchors scored against a block at a time.
STRIP = 32
WORD_BITS = 64
#: Candidates in one wide integer where fields exceed half a word.
WIDE_FIELDS = 64
U = np.uint64
LONG = 2**63


class Packed:
    """A block of candidates (rows of integers), packed for multiplication with anchors of so large components."""

    def __init__(self, rows: np.ndarray, most_anchor: int):
        n, dims = rows.shape
        self.n, self.raised, self.anchor_raised = n, largest(rows), most_anchor
        self.bits = max(1, (dims * 2 * self.raised * 2 * most_anchor).bit_length())
        self.short = self.bits <= WORD_BITS // 2
        self.fields = WORD_BITS // self.bits if self.short else WIDE_FIELDS
        self.sums = rows.sum(axis=1)
        words = -(-n // self.fields)
        held = np.zeros((words * self.fields, dims), U if self.short else object)
        held[:n] = rows + self.raised
        held = held.reshape(words, self.fields, dims)
        shifts = [U(k * self.bits) if self.short else k * self.bits for k in range(self.fields)]
        self.words = reduce(np.bitwise_or, [held[:, k] << s for k, s in enumerate(shifts)]) if self.short else wide(held, shifts)
        self.words = np.ascontiguousarray(self.words.T)  # a row for each component

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The score of each anchor (row of integers) with each candidate."""
        raised = anchors + self.anchor_raised
        products = np.zeros((len(anchors), self.words.shape[1]), self.words.dtype)
        for k in range(anchors.shape[1]):
            products += raised[:, k, None].astype(self.words.dtype) * self.words[k]
        mask = (1 << self.bits) - 1
        if self.short:
            parts = [(products >> U(k * self.bits) & U(mask)).astype(np.int64) for k in range(self.fields)]
        else:
            parts = [products >> k * self.bits & mask for k in range(self.fields)]
        out = np.stack(parts, axis=2).reshape(len(anchors), -1)[:, : self.n]
        added = self.raised * anchors.sum(axis=1)[:, None] + self.anchor_raised * self.sums[None, :]
        return out - added - anchors.shape[1] * self.raised * self.anchor_raised


def largest(rows: np.ndarray) -> int:
    return int(abs(rows).max()) if rows.size else 0


def wide(held: np.ndarray, shifts: list[int]) -> np.ndarray:
    """One Python integer for each (word, component) of an array of objects (word, field, component)."""
    out = np.zeros((held.shape[0], held.shape[2]), object)
    for k, shift in enumerate(shifts):
        out = out + held[:, k] * (1 << shift)
    return out


def integers(vectors: pa.ListArray) -> np.ndarray:
    """floor(SCALE * x) of every component, zeros where a vector ends; Python integers if 64 bits may not hold sums."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dims = int(lengths.max(initial=0))
    small = not flat.size or dims * SCALE * abs(flat).max() < 2.0**31
    out = np.zeros((len(lengths), dims), np.int64 if small else object)
    inside = np.arange(dims)[None, :] < lengths[:, None]
    out[inside] = np.floor(SCALE * flat).astype(np.int64) if small else [floored(x) for x in flat.tolist()]
    return out


def floored(x: float) -> int:
    """floor(SCALE * x) without overflow: a double this large is whole."""
    return SCALE * int(x) if abs(x) >= 2.0**53 else math.floor(SCALE * x)


def padded(rows: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, dims - rows.shape[1])))


def scored(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first anchor of a strip, scores of the strip with all candidates)."""
    dims = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = padded(anchors, dims), padded(candidates, dims)
    if anchors.dtype != candidates.dtype or 4 * dims * largest(anchors) * largest(candidates) >= LONG:
        anchors, candidates = anchors.astype(object), candidates.astype(object)
    packed = Packed(candidates, largest(anchors))
    for first in range(0, len(anchors), STRIP):
        yield first, packed.scores(anchors[first : first + STRIP])


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by id; every place tied with the last is looked at."""
    if len(scores) > 4 * most and scores.dtype != object:
        cut = np.partition(scores, len(scores) - most)[len(scores) - most]
        held = np.flatnonzero(scores >= cut)
    else:
        held = np.arange(len(scores))
    order = sorted(held, key=lambda k: (-int(scores[k]), ids[k])) if scores.dtype == object else held[np.lexsort((ids[held], -scores[held]))]
    return np.asarray(order[:most], np.int64)


def taking_part(embeddings: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, label (moved), vector of the rows that take part."""
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(F.col("vec_id") % MOVED_ONE_IN == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~wrong).select(
        F.monotonically_increasing_id().alias("row"),
        "vec_id",
        moved.alias("label"),
        "vector",
    )


def dealt(rows: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
    """Each row in its own block, once for every block of the other side."""
    others = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # both sides come from one table
    return rows.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int")).withColumn(other, others)


def text_of(scores: list) -> pa.Array:
    return pa.array([str(int(s)) for s in scores], pa.string())


def ids_of(rows: pa.Table) -> np.ndarray:
    """vec_id, nulls as more than any."""
    return rows.column("vec_id").fill_null(LONG - 1).to_numpy()


def own_label(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """anchor (row), row, vec_id, score (digits): the best of an anchor's label in every block of candidates, itself included."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "row": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            a, c = (integers(t.column("vector").combine_chunks()) for t in (left, right))
            names, labels = left.column("row").to_numpy(), left.column("label").to_numpy()
            ids, rows_, theirs = ids_of(right), right.column("row").to_numpy(), right.column("label").to_numpy()
            real = right.column("vec_id").to_pylist()
            of_label = {x: np.flatnonzero(theirs == x) for x in np.unique(labels)}
            for first, strip in scored(a, c):
                for k, line in enumerate(strip, first):
                    at = of_label[labels[k]]
                    for place in at[best(line[at], ids[at], POSITIVES + 1)]:
                        out["anchor"].append(names[k])
                        out["row"].append(rows_[place])
                        out["vec_id"].append(real[place])
                        out["score"].append(line[place])
        return result(out)

    def result(out: dict[str, list]) -> pa.Table:
        longs = {n: pa.array([None if x is None else int(x) for x in out[n]], pa.int64()) for n in ("anchor", "row", "vec_id")}
        return pa.table(longs | {"score": text_of(out["score"])})

    return met(anchors, rows, n_anchors, n_rows).applyInArrow(run, "anchor long, row long, vec_id long, score string")


def met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    left = dealt(anchors, "a_block", "c_block", n_anchors, n_rows).groupBy("a_block", "c_block")
    right = dealt(rows, "c_block", "a_block", n_rows, n_anchors).groupBy("a_block", "c_block")
    return left.cogroup(right)


def by_score(keys: list[str], tie: str) -> WindowSpec:
    """Rows of a key from the highest score (digits, of any length) on, ties by id, null last."""
    minus = F.col("score").startswith("-")
    digits = F.regexp_replace("score", "^-", "")
    size = F.length(digits)
    up = [F.when(minus, -size).otherwise(size).desc(), F.when(~minus, digits).desc_nulls_last(), F.when(minus, digits).asc()]
    return Window.partitionBy(*keys).orderBy(minus.asc(), *up, F.col(tie).asc_nulls_last())


def positives(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """anchor (row), nth, positive_id, score (digits): the best other rows of the anchor's label."""
    found = own_label(anchors, rows, n_anchors, n_rows)
    found = found.withColumn("nth", F.row_number().over(by_score(["anchor"], "vec_id"))).where(f"nth <= {POSITIVES + 1}")
    others = found.where("row != anchor").withColumn("nth", F.row_number().over(by_score(["anchor"], "vec_id")))
    return others.where(f"nth <= {POSITIVES}").select("anchor", "nth", F.col("vec_id").alias("positive_id"), "score")


def other_labels(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """anchor, nth, vec_id, score (digits): the best of other labels in every block, within each positive's window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "nth": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            a, c = (integers(t.column("vector").combine_chunks()) for t in (left, right))
            names, labels = left.column("row").to_numpy(), left.column("label").to_numpy()
            tops = left.column("tops").to_pylist()
            ids, theirs = ids_of(right), right.column("label").to_numpy()
            real = right.column("vec_id").to_pylist()
            for first, strip in scored(a, c):
                for k, line in enumerate(strip, first):
                    others = np.flatnonzero(theirs != labels[k])
                    scores = line[others]
                    for top in tops[k]:
                        most = int(top["score"])
                        least = -(-LEAST_PERCENT * most // 100)
                        inside = np.flatnonzero((scores <= most) & (scores >= least))
                        at = others[inside]
                        for place in at[best(line[at], ids[at], NEGATIVES)]:
                            out["anchor"].append(int(names[k]))
                            out["nth"].append(top["nth"])
                            out["vec_id"].append(real[place])
                            out["score"].append(line[place])
        longs = {n: pa.array(out[n], pa.int64()) for n in ("anchor", "nth", "vec_id")}
        return pa.table(longs | {"score": text_of(out["score"])})

    return met(anchors, rows, n_anchors, n_rows).applyInArrow(run, "anchor long, nth long, vec_id long, score string")


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = written(taking_part(embeddings), "vectors")
    anchors = rows.where(F.col("vec_id") % ANCHOR_ONE_IN == 0)
    n_rows, n_anchors = blocks_for(rows.count(), BLOCK_ROWS), blocks_for(anchors.count(), BLOCK_ROWS)
    told = written(positives(anchors, rows, n_anchors, n_rows), "positives")
    tops = told.groupBy("anchor").agg(F.collect_list(F.struct("nth", "score")).alias("tops"))
    known = anchors.join(tops.withColumnRenamed("anchor", "row"), "row")
    found = other_labels(known, rows, n_anchors, n_rows)
    ranked = found.withColumn("rank", F.row_number().over(by_score(["anchor", "nth"], "vec_id"))).where(f"rank <= {NEGATIVES}")
    ranked = ranked.select("anchor", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        ranked.join(told.withColumnRenamed("score", "positive_score"), ["anchor", "nth"])
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int"),
            "negative_id",
            F.expr("try_cast(positive_score AS long)").alias("positive_score"),
            F.expr("try_cast(negative_score AS long)").alias("negative_score"),
        )
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and each of its positives."""
    return mine(table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM (SELECT vec_id, CASE WHEN vec_id % {MOVED_ONE_IN} = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
         list_inner_product(a.q, c.q)::BIGINT AS score
  FROM v a JOIN v c ON a.r != c.r WHERE a.vec_id % {ANCHOR_ONE_IN} = 0),
p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, p.nth ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same
  WHERE p.nth <= {POSITIVES} AND {LEAST_PERCENT} * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
