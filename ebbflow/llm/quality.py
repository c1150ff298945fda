"""Supervised subword embeddings that score the quality of a text.

A text is the average of learned vectors, one for each of its words and of its
character n-grams, hashed into a table; a softmax over two classes sits on top, and
all of it is trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows: the ``rows_per_class`` rows of each class whose id hashes lowest.
Scoring a trained model needs one number for each hash bucket (the vector's share of
the difference of the two logits), so whole texts of any length are scored at the cost
of one look-up per word and n-gram.

Defined results: a null text is empty; an empty text scores by what all
texts share; repeated labels of a document count as their maximum; a null
id has remainder null, hence is not held out, and has no label; only ``doc_id`` and
``text`` are read, so other columns cannot clash; without labels of both classes every
text scores the share of good labels (one half without any) and no document is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import table, whole_text

BUCKET_BITS = 18
DIM = 8
GRAMS = (3, 4)
#: Times that each text has the feature all texts share: short texts lean on it.
PRIOR = 24
EPOCHS = 6
RATE = 0.6
#: Labelled rows of each class that training takes at most.
ROWS_PER_CLASS = 1_500
KEEP_SCORE = 0.7
SCORED_ROWS = 2_000
SPACE = 32
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
STEP_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hash buckets of a text's words, word pairs and character n-grams, and of the prior."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, U)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(STEP, 2 * n), powers(STEP_BACK, 2 * n)

    def features(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(U)
        n = len(codes)
        self.grow(n + 1)
        letter = codes > SPACE
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, U), np.cumsum((codes + U(1)) * self.up[:n], dtype=U)])
        words = (total[end] - total[start]) * self.down[start]
        found = [np.zeros(PRIOR, U), words, words[1:] - words[:-1] + U(1)]  # a repeated word is one pair for all words
        for g in GRAMS:
            if n >= g:
                gram = codes[: n - g + 1] + U(g << 24)
                for k in range(1, g):
                    gram = gram * STEP + codes[k : n - g + 1 + k]
                found.append(gram)
        mixed = np.concatenate(found)
        mixed = (mixed ^ (mixed >> U(32))) * U(0xD6E8FEB86659FD93)
        return (mixed >> U(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    weight: np.ndarray  # float32, one for each bucket
    told: bool = True  # whether labels of both classes were seen

    def score(self, hasher: Hasher, text: str) -> float:
        logit = float(self.weight[hasher.features(text)].mean())
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, logit))))


def fit(texts: list[str], labels: list[int], counts: tuple[int, int], seed: int = 7) -> Model:
    """Stochastic gradient descent over the texts, the rate falling linearly.

    ``counts`` are the rows of the two classes among all labels: a class that the
    sample holds too few or too many of weighs as it does there.
    """
    if len(set(labels)) < 2:
        return prior(counts)
    rng, hasher = np.random.default_rng(seed), Hasher()
    rows = []
    for text in texts:
        buckets, count = np.unique(hasher.features(text), return_counts=True)
        rows.append((buckets.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    weighs = np.array(counts) / sum(counts) / (np.bincount(labels, minlength=2) / len(labels))
    at, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - at / steps)
            at += 1
            buckets, weight = rows[i]
            held = vectors[buckets]
            hidden = weight @ held
            logits = out @ hidden
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[i]] -= 1
            error *= weighs[labels[i]]
            back = error @ out
            out -= rate * np.outer(error, hidden)
            vectors[buckets] = held - (rate * len(buckets) ** 0.5) * weight[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32))


def prior(counts: tuple[int, int]) -> Model:
    """Without texts of both classes: every text scores the labels' share of the good, drawn a little to one half."""
    share = (counts[1] + 1) / (sum(counts) + 2)
    return Model(np.full(1 << BUCKET_BITS, math.log(share / (1 - share)), np.float32), told=False)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """A model of the labels that are not held out."""
    told = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").alias("quality"))
    )
    first = F.xxhash64("doc_id")
    wanted = [
        told.where(F.col("quality") == q).orderBy(first, "doc_id").limit(rows_per_class) for q in (0, 1)
    ]
    sample = wanted[0].unionByName(wanted[1])  # at most 2 * rows_per_class rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality")
    rows = found.agg(F.min("text").alias("text")).collect()  # one row for each labelled id, however often it repeats
    rows.sort(key=lambda r: (r.doc_id, r.text))
    counts = dict(told.groupBy("quality").count().collect())
    return fit([r.text for r in rows], [r.quality for r in rows], (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text; the model is one table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(start, SCORED_ROWS)
                scores = [model.score(hasher, t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = KEEP_SCORE) -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``least``; all of them where the model knows one class or none."""
    if not model.told:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            good = [model.score(hasher, t.as_py() or "") >= least for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )
