"""Targets by hand, quotas by handing out seats one by one, and what the mix takes."""

import random
import re
from heapq import heapify, heapreplace

import numpy as np
import pytest

from cases import CLASHING, empty_docs, words
from ebbflow.llm import apportion, mixing

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, source string, text string, " + ", ".join(f"{c} string" for c in CLASHING)


def water_fill(sizes):
    """Targets of sources in order, the excess shared again by weight until none is above."""
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    left, out, full = 1.5 * sum(sizes), [0.0] * len(sizes), set()
    while True:
        open_ = [k for k in range(len(sizes)) if k not in full]
        share = sum(weights[k] for k in open_)
        if not open_:
            return out
        for k in open_:
            out[k] = left * weights[k] / share
        above = [k for k in open_ if out[k] >= 2 * sizes[k]]
        if not above:
            return out
        for k in above:
            out[k] = 2.0 * sizes[k]
            left -= out[k]
            full.add(k)


def one_by_one(votes, caps, seats):
    """Sainte-Laguë, seat by seat."""
    quota = dict.fromkeys(votes, 0)
    heap = [(-v, p) for p, v in votes.items() if caps[p] > 0]
    heapify(heap)
    while heap and sum(quota.values()) < seats:
        _, p = heap[0]
        quota[p] += 1
        heapreplace(heap, (-votes[p] / (2 * quota[p] + 1) if quota[p] < caps[p] else 1.0, p))
        if heap[0][0] > 0:
            break
    return quota


def dealt(spark, groups):
    rows = [(g, p, float(v), int(c)) for g, (votes, caps, _) in groups.items() for p, v in votes.items() for c in [caps[p]]]
    parties = spark.createDataFrame(rows, "grp long, party long, votes double, cap long")
    seats = spark.createDataFrame([(g, s) for g, (_, _, s) in groups.items()], "grp long, seats long")
    out = {}
    for r in apportion.sainte_lague(parties, seats).collect():
        out.setdefault(r["grp"], {})[r["party"]] = r["quota"]
    return out


@pytest.mark.parametrize("few", [256, 3])
def test_quotas(spark, monkeypatch, few):
    monkeypatch.setattr(apportion, "FEW", few)
    r = random.Random(5)
    groups = {}
    for g in range(12):
        n = r.choice([1, 2, 5, 40, 300])
        votes = {p: r.choice([r.uniform(0.5, 9), r.uniform(100, 5000)]) for p in range(n)}
        caps = {p: r.choice([0, 1, 3, 10_000]) if g % 3 == 2 else 10_000 for p in range(n)}
        groups[g] = (votes, caps, r.choice([0, 1, 7, 500, 4000]))
    got = dealt(spark, groups)
    assert got == {g: one_by_one(*x) for g, x in groups.items()}


def test_quotas_of_equal_votes(spark):
    n = 5000
    got = dealt(spark, {1: (dict.fromkeys(range(n), 4.0), dict.fromkeys(range(n), 9), 3 * n + 1234), 2: ({0: 0.0}, {0: 5}, 3)})
    assert sorted(set(got[1].values())) == [3, 4] and sum(got[1].values()) == 3 * n + 1234 and got[2] == {0: 0}
    assert dealt(spark, {1: ({0: 5.0, 1: 2.0}, {0: 3, 1: 2}, 99)}) == {1: {0: 3, 1: 2}}


def test_drawn_blocks_are_as_many_as_asked():
    r = random.Random(2)
    for blocks in (1, 2, 3, 10, 97, 1024, 5000):
        for more in {0, 1, blocks // 3, blocks - 1, blocks}:
            drawn = mixing.drawn_blocks(np.arange(blocks), blocks, more, r.getrandbits(62))
            assert drawn.sum() == more


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_words_taken_are_those_under_the_blocks(monkeypatch, step):
    monkeypatch.setattr(mixing, "DRAWN", step)
    r = random.Random(4)
    for _ in range(60):
        sizes = np.array([r.choice([0, 1, 5, 33, 400]) for _ in range(r.randint(1, 30))])
        total = int(sizes.sum())
        blocks = max(1, round(total / 16)) if total else 0
        quota, seed = r.randint(0, 2 * blocks), r.getrandbits(62)
        got = mixing.taken_in(sizes, blocks, quota, seed)
        word = np.zeros(total, np.int64)
        if blocks:
            times, more = divmod(quota, blocks)
            drawn = mixing.drawn_blocks(np.arange(blocks), blocks, more, seed)
            for b in range(blocks):
                word[b * total // blocks : (b + 1) * total // blocks] = times + drawn[b]
        ends = np.cumsum(sizes)
        assert got.tolist() == [int(word[e - s : e].sum()) for s, e in zip(sizes, ends)]


def documents():
    r = random.Random(8)
    out, sizes = [], {"b": 40, "B": 700, None: 90, "ä": 30, "a": 5, "": 60, "\U0001f600": 20, "￿": 15}
    for source, n in sizes.items():
        out += [(len(out) + k, source, words(len(out) + k, r.randint(1, 120))) for k in range(n)]
    out += [(7777, "b", None), (7778, "b", ""), (7779, "none", " \t "), (None, "b", "no id here"), (None, "b", "no id here")]
    out += [(7780, "B", "w " * 20_000), (3, "a", "same id"), (3, "a", "same id"), (7781, "nbsp", "a b\x0bc\x1cd")]
    return out


def mixed(spark, rows):
    frame = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, mixing.mix(frame).collect()), key=str)


def test_mix(spark):
    rows = documents()
    got = mixed(spark, rows)
    by = {}
    for _, source, text in rows:
        by[source] = by.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, water_fill([by[s] for s in order])))
    expected = sorted(((i, len(WORD.findall(t or "")), by[s], round(target[s], 6)) for i, s, t in rows), key=str)
    assert sorted(((i, n, s, round(t, 6)) for i, n, s, t, _ in got), key=str) == expected
    taken = {}
    for _, size, of_source, own_target, k in got:
        assert 0 <= k <= 2 * size
        taken[of_source, own_target] = taken.get((of_source, own_target), 0) + k
    for (of_source, own_target), k in taken.items():
        assert abs(k - own_target) <= mixing.BLOCK_WORDS + 0.001 * own_target
    assert mixed(spark, rows[::-1]) == got


def test_several_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 25)
    got = mixed(spark, documents())
    taken = {}
    for _, size, of_source, target, k in got:
        assert 0 <= k <= 2 * size
        taken[of_source, target] = taken.get((of_source, target), 0) + k
    for (_, target), k in taken.items():
        assert abs(k - target) <= mixing.BLOCK_WORDS + 0.01 * target


def test_empty(spark):
    from pyspark.sql import functions as F

    assert mixing.mix(empty_docs(spark).withColumn("source", F.lit("x"))).collect() == []
    got = mixed(spark, [(1, "a", None), (2, None, "")])
    assert got == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
