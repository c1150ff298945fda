"""The manifest against a plain-Python tree, with tiles of 4096 leaves and of 16."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cases import empty_docs, words
from ebbflow.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank long, hash string, tiles int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    out = ""
    for value in (row[0], row[3], row[2], row[4], row[1]):
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return h(out)


def climb(hashes):
    """The root, and for each place its steps (before, after)."""
    steps = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        for k, place in enumerate(at):
            first = place - place % 16
            steps[k].append(("".join(hashes[first:place]), "".join(hashes[place + 1 : first + 16])))
            at[k] = place // 16
        hashes = [h("".join(hashes[k : k + 16])) for k in range(0, len(hashes), 16)]
    return hashes[0], steps


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: climb([leaf(r) for r in by[s]]) for s in order}
    root, tops = climb([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for row, own in zip(by[s], trees[s][1]):
            steps = own + top
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            now = leaf((row[0], row[1].translate(LOWER), *row[2:])) if tampered and row[1] is not None else leaf(row)
            for before, after in steps:
                now = h(before + now + after)
            proof = h("".join(b + a for b, a in steps))
            out.append((row[0], leaf(row), trees[s][0], root, proof, now, now == root))
    return sorted(out, key=str)


def result(spark, rows, height=merkle.TILE_LEVELS):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, merkle.manifest(docs, height).collect()), key=str)


def many():
    out = [(k, "Word " * (k % 5) + str(k), "en", f"s{k % 3}", k) for k in range(700)]
    out += [(5000 + k, f"Big {k}", None, "hot", None) for k in range(1100)]
    out += [(9000 + k, f"T{k}", "de", f"one-{k}", 1) for k in range(40)]
    return out


def awkward():
    return [
        (1, "Text A", "en", None, 6),
        (2, None, None, None, None),
        (None, "No Id", "en", "a", 5),
        (None, "Other", "en", "a", 5),
        (3, "", "en", "a", 0),
        (3, "", "en", "a", 0),
        (3, "ties", "en", "a", 4),
        (10, "ünï ÇA", "en", "ä", 6),
        (11, words(3, 40).upper(), "en", "Z", 9),
        (15, "LONG " * 60_000, "en", "", 300_000),
        (-4, "Minus", "en", "\U0001f600", 5),
        (20, "Y", "en", "￿", 1),
    ]


@pytest.mark.parametrize("height", [1, 3])
def test_against_a_plain_tree(spark, height):
    rows = many() + awkward()
    got = result(spark, rows, height)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [awkward(), awkward()[:1], many()[:17], many()[700:717]])
def test_small_trees(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_ragged_partners_meet_once(spark):
    """Whatever the count, every place receives the root of each node of its group exactly once."""
    for count in (2, 16, 17, 33, 256, 257, 273, 300):
        for turn in range(merkle.levels(count)):
            sent = spark.range(count).withColumn("to", F.explode(merkle.partners("id", str(count), turn)))
            got = sent.groupBy("to").agg(F.sort_array(F.collect_list(F.col("id").cast("long"))).alias("ids")).collect()
            width = 16**turn
            assert len(got) == count
            for row in got:
                first = row["to"] // (width * 16) * 16
                nodes = [n for n in range(first, first + 16) if n * width < count]
                assert [k // width for k in row["ids"]] == nodes and row["to"] in row["ids"]


def test_empty(spark):
    docs = empty_docs(spark).withColumns({"lang": F.lit("x"), "source": F.lit("x"), "n_chars": F.lit(1)})
    assert merkle.manifest(docs).collect() == []
