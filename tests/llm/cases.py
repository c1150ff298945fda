"""Small tables with every awkward case: nulls, ties, repeated rows, long texts, clashing names."""

import random

from pyspark.sql import types as T

LONG = "the quick brown fox " * 12_000
CLASHING = ("rid", "row", "batch", "digest", "key", "set_id", "n", "score", "shard", "slot", "word", "kept", "root", "a", "hash")


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(n))


def edge_texts() -> list[tuple]:
    base = words(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base),
        (2, base.upper()),
        (3, " ".join(near)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "two words"),
        (8, "Two Words"),
        (9, LONG),
        (10, LONG),
        (11, "ünï çødé 😀 " + base[:200]),
        (12, words(2, 80)),
        (13, words(3, 80) + " " + words(2, 80)),
        (None, base),
        (None, None),
        (14, "\x00 control \x7f"),
        (15, "a"),
    ]


def edge_docs(spark, rows=None):
    """doc_id, text and columns whose names the operators use themselves."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(c, T.StringType()) for c in CLASHING]
    rows = edge_texts() if rows is None else rows
    return spark.createDataFrame([(*r, *["x", None] * 7, "y") for r in rows], T.StructType(fields)).repartition(3)


def empty_docs(spark):
    return edge_docs(spark, [])
