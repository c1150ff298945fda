"""Packed scores against Python integers, and the mined table against a plain search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from ebbflow.llm import hard_negatives as H

FIELDS = [
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType()),
    T.StructField("row", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("anchor", T.StringType()),
]


def brute(rows):
    held = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        held.append((vec_id, label, [H.floored(x) for x in vector]))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (anchor_id, label, vector) in enumerate(held):
        if anchor_id is None or anchor_id % 100:
            continue
        scored = [(sum(x * y for x, y in zip(vector, v)), i, own == label) for k, (i, own, v) in enumerate(held) if k != a]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for score, positive, _ in [s for s in scored if s[2]][:5]:
            negatives = [s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score][:5]
            fits = lambda s: s if -(2**63) <= s < 2**63 else None
            out += [(anchor_id, positive, n, s[1], fits(score), fits(s[0])) for n, s in enumerate(negatives, 1)]
    return sorted(out, key=str)


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], T.StructType(FIELDS)).repartition(3)
    return sorted(map(tuple, H.mine(frame).collect()), key=str)


def clustered(n, dims, seed, scale=1.0):
    r = random.Random(seed)
    centre = [r.uniform(0.2, 1) for _ in range(dims)]
    return [(k * 5, [scale * (c + r.gauss(0, 0.15)) for c in centre], r.randint(0, 3)) for k in range(n)]


@pytest.mark.parametrize("scale", [1, 200, 10**6, 10**12, 10**25])
def test_packed_scores(scale):
    r = np.random.default_rng(scale % 97)
    anchors = [[int(x) * scale for x in r.integers(-300, 300, 9)] for _ in range(70)]
    candidates = [[int(x) * scale for x in r.integers(-300, 300, 9)] for _ in range(131)]
    expected = [[sum(x * y for x, y in zip(a, c)) for c in candidates] for a in anchors]
    kind = object if scale > 10**12 else np.int64
    got = [[int(x) for x in line] for _, strip in H.scored(np.array(anchors, kind), np.array(candidates, kind)) for line in strip]
    assert got == expected


def test_against_a_plain_search(spark):
    rows = clustered(260, 16, 1)
    got = mined(spark, rows)
    assert got == brute(rows) and len({r[0] for r in got}) == 13


def test_awkward_rows(spark):
    rows = clustered(80, 6, 2)
    rows += rows[:3] + [(0, [0.5] * 6, 2), (100, None, 1), (200, [1.0, None], 1), (300, [math.nan], 1), (400, [math.inf], 0)]
    rows += [(500, [0.3] * 6, None), (None, [0.6] * 6, 1), (None, [0.6] * 6, 2), (600, [], 1), (700, [0.4], 3), (707, [0.0] * 6, 1)]
    rows += [(800, [-0.5] * 6, 1), (900, [0.5] * 9, 0), (901, [0.45] * 9, 1), (902, [0.45] * 9, 1), (905, [0.5] * 9, 0)]
    assert mined(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = clustered(60, 4, 3, 1e30) + clustered(60, 4, 4, 1e7) + [(1100, [1e305, -1e305], 1), (1111, [1e305, 0.1], 1)]
    assert mined(spark, rows) == brute(rows)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 20)
    rows = clustered(400, 5, 5)
    rows = [(k, v, label) for (_, v, label), k in zip(rows, range(0, 40_000, 50))]
    assert mined(spark, rows) == brute(rows)


def test_empty(spark):
    assert mined(spark, []) == []
