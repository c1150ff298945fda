"""Boosted regression trees from binned histograms (M4): one shuffle of histograms a level.

Features are cut at their quantiles into at most ``BINS`` bins, and a row becomes one byte a feature,
written once.  A level of a tree is grown from histograms alone: each task sums the rows
and residuals of (node, feature, bin) over its rows, the sums are merged by feature, and each
feature's best split a node comes back, a bounded table whose rows do not depend on
the data.  A row finds its node by walking the trees so far, which travel with the task.
Residuals are those of squared error; the running prediction is written every ``KEEP`` trees, so that a
row walks few trees in a pass and a lost executor repeats few levels.

A split needs ``MIN_ROWS`` rows on both sides; of equal gains the first feature and the lowest
bin win.  NULL and NaN go to a bin of their own, below all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.session import cut_lineage

BINS = 32
TREES = 40
DEPTH = 5
RATE = 0.1
MIN_ROWS = 20
KEEP = 10
ACCURACY = 10_000


@dataclass
class Tree:
    """Arrays over the nodes of a full binary tree (children of k: 2k + 1, 2k + 2); feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int16), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row (of binned features) ends in."""
        at = np.zeros(len(bins), np.int64)
        while True:
            feature = self.feature[at]
            go = np.flatnonzero(feature >= 0)
            if not len(go):
                return at
            right = bins[go, feature[go]] > self.bin[at[go]]
            at[go] = 2 * at[go] + 1 + right


@dataclass
class Booster:
    """Trees over named features cut at ``edges``; a row's bin is 1 + the number of edges below its value, 0 for none."""

    features: list[str]
    edges: list[list[float]]
    start: float = 0.0
    rate: float = RATE
    trees: list[Tree] = field(default_factory=list)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for k, x in enumerate(columns):
            known = ~np.isnan(x)
            out[known, k] = 1 + np.searchsorted(np.array(self.edges[k]), x[known], side="left")
        return out

    def added(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from ``first`` on add to the prediction of binned rows."""
        out = np.zeros(len(bins))
        for tree in self.trees[first:]:
            out += self.rate * tree.value[tree.nodes(bins)]
        return out

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        """Adds the prediction to the rows."""
        fields = df.schema.simpleString()[len("struct<") : -1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = self.bins([doubles(batch.column(c)) for c in self.features])
                score = self.start + self.added(bins) if self.features else np.full(batch.num_rows, self.start)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, out])

        return df.mapInArrow(run, f"{fields},{out}:double")


def doubles(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def cut_points(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 distinct quantiles of each feature."""
    wanted = [(k + 1) / bins for k in range(bins - 1)]
    finite = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in features]
    row = df.agg(*[F.percentile_approx(x, wanted, ACCURACY).alias(f"q{k}") for k, x in enumerate(finite)]).first()
    return [sorted(set(row[f"q{k}"] or [])) for k in range(len(features))]


def binned(df: DataFrame, target: str, booster: Booster) -> DataFrame:
    """y, score, bins (one byte a feature) of the rows that have a target."""
    start, features = booster.start, booster.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = booster.bins([doubles(batch.column(c)) for c in features])
            blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(features)), len(bins), [None, pa.py_buffer(bins.tobytes())])
            y = doubles(batch.column(target))
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(np.full(len(y), start)), blobs.cast(pa.binary())], ["y", "score", "bins"])

    known = df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    rows = known.select(target, *[F.col(f"`{c}`") for c in features])
    return rows.mapInArrow(run, "y double, score double, bins binary")


def unpacked(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, scores, bins) of a batch of binned rows."""
    data = b"".join(batch.column("bins").to_pylist())
    bins = np.frombuffer(data, np.uint8).reshape(batch.num_rows, n_features)
    return batch.column("y").to_numpy(), batch.column("score").to_numpy(), bins


def histograms(rows: DataFrame, booster: Booster, tree: Tree, open_: list[int], kept: int, width: int) -> DataFrame:
    """feature, sums (float64 bytes of (open node, bin, [rows, residuals])): one row a task and feature."""
    n_features = len(booster.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(len(tree.feature), -1, np.int64)
        slot[open_] = np.arange(len(open_))
        counts = np.zeros((n_features, len(open_) * width))
        sums = np.zeros_like(counts)
        for batch in batches:
            y, score, bins = unpacked(batch, n_features)
            node = slot[tree.nodes(bins)]
            live = np.flatnonzero(node >= 0)
            rest = (y - score - booster.added(bins, kept))[live]
            place = node[live, None] * width + bins[live]
            for k in range(n_features):
                counts[k] += np.bincount(place[:, k], minlength=counts.shape[1])
                sums[k] += np.bincount(place[:, k], weights=rest, minlength=counts.shape[1])
        if counts.any():
            blobs = [np.stack([counts[k], sums[k]], axis=1).tobytes() for k in range(n_features)]
            yield pa.RecordBatch.from_arrays([pa.array(range(n_features), pa.int32()), pa.array(blobs, pa.binary())], ["feature", "sums"])

    return rows.mapInArrow(run, "feature int, sums binary")


def best_splits(parts: DataFrame, n_nodes: int, width: int, min_rows: int) -> DataFrame:
    """For every feature and open node: rows, their residuals, and the best split's gain, bin, left rows and residuals."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(n_nodes * width * 2)
        for blob in table.column("sums"):
            total += np.frombuffer(blob.as_py())
        h = total.reshape(n_nodes, width, 2)
        left = h.cumsum(axis=1)[:, :-1]
        all_ = h.sum(axis=1)
        right = all_[:, None] - left
        fits = (left[..., 0] >= min_rows) & (right[..., 0] >= min_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - (all_[:, 1] ** 2 / all_[:, 0])[:, None]
        gain = np.where(fits, gain, -1.0)
        at = gain.argmax(axis=1)
        each = np.arange(n_nodes)
        out = {
            "feature": pa.array([table.column("feature")[0].as_py()] * n_nodes, pa.int32()),
            "node": pa.array(each, pa.int32()),
            "gain": pa.array(gain[each, at]),
            "bin": pa.array(at, pa.int32()),
            "rows": pa.array(all_[:, 0]),
            "rest": pa.array(all_[:, 1]),
            "left_rows": pa.array(left[each, at, 0]),
            "left_rest": pa.array(left[each, at, 1]),
        }
        return pa.table(out)

    schema = "feature int, node int, gain double, bin int, rows double, rest double, left_rows double, left_rest double"
    return parts.groupBy("feature").applyInArrow(run, schema)


def grown(rows: DataFrame, booster: Booster, kept: int, depth: int, min_rows: int) -> Tree:
    """One more tree, level by level."""
    tree, open_ = Tree.empty(depth), [0]
    width = max((len(e) for e in booster.edges), default=0) + 2
    for _ in range(depth):
        found = best_splits(histograms(rows, booster, tree, open_, kept, width), len(open_), width, min_rows)
        best: dict[int, dict] = {}
        for r in found.collect():  # a row for each open node and feature
            b = best.get(r["node"])
            if b is None or (r["gain"], -r["feature"]) > (b["gain"], -b["feature"]):
                best[r["node"]] = r
        following = []
        for slot, r in best.items():
            node = open_[slot]
            tree.value[node] = r["rest"] / max(r["rows"], 1)
            if r["gain"] > 1e-12:
                tree.feature[node], tree.bin[node] = r["feature"], r["bin"]
                tree.value[2 * node + 1] = r["left_rest"] / r["left_rows"]
                tree.value[2 * node + 2] = (r["rest"] - r["left_rest"]) / (r["rows"] - r["left_rows"])
                following += [2 * node + 1, 2 * node + 2]
        open_ = sorted(following)
        if not open_:
            break
    return tree


def fit_boosted(df: DataFrame, features: list[str], target: str, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
                min_rows: int = MIN_ROWS, bins: int = BINS) -> Booster:
    """M4: a booster of ``trees`` trees; without rows it predicts 0."""
    mean = df.agg(F.avg(F.when(~F.isnan(F.col(target).cast("double")), F.col(target)))).first()[0]
    booster = Booster(list(features), cut_points(df, features, bins), float(mean or 0.0), rate)
    if mean is None or not features:
        return booster
    rows = cut_lineage(binned(df, target, booster))
    kept = 0
    for n in range(1, trees + 1):
        booster.trees.append(grown(rows, booster, kept, depth, min_rows))
        if n % KEEP == 0 and n < trees:
            rows, kept = cut_lineage(rescored(rows, booster, kept)), n
    return booster


def rescored(rows: DataFrame, booster: Booster, kept: int) -> DataFrame:
    """The binned rows with the trees from ``kept`` on added to their scores."""
    n_features = len(booster.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, score, bins = unpacked(batch, n_features)
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(score + booster.added(bins, kept)), batch.column("bins")], ["y", "score", "bins"]
            )

    return rows.mapInArrow(run, "y double, score double, bins binary")
