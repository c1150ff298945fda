"""Exact global quantiles that do not gather a whole column in one task.

Spark's exact ``percentile`` keeps every distinct value of the group in one
aggregation buffer; for a table-wide quantile that is the whole column in the
final task.  Here a ``percentile_approx`` sketch (rank error <= n/accuracy)
first gives, per column and probability, a value bracket around the wanted order
statistics.  A second pass counts the values below each bracket and keeps the
nearest value on either side of it (one aggregate, one row).  A third counts the
rows of each distinct value inside the brackets: ties collapse before the shuffle,
so a value that a column repeats is one row, and a running count over the distinct
values (about 4n/accuracy at most, as rows of a sorted window, not as an array)
finds the order statistics.  One path serves every size.  The result is the exact
linearly interpolated quantile (numpy / pandas 'linear', DuckDB ``quantile_cont``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sketch accuracy: rank error <= n / ACCURACY, so each bracket holds about
# 4n / ACCURACY values; the sketch keeps O(ACCURACY) entries per column.
ACCURACY = 2000


def quantile_name(c: str, p: float) -> str:
    return f"{c}__q{repr(float(p)).replace('.', '_').replace('-', 'm')}"


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """One-row DataFrame with column ``quantile_name(c, p)`` for every column and probability.

    NULLs are ignored, as in pandas; a column without values gives NULL.
    """
    if not cols:
        raise ValueError("no columns")
    delta = 2.0 / accuracy
    k = len(probs)
    ps = [max(0.0, p - delta) for p in probs] + [min(1.0, p + delta) for p in probs]
    # long form: the plan is as large for three columns as for three hundred
    values = F.array(*[F.struct(F.lit(ci).alias("ci"), F.col(f"`{c}`").cast("double").alias("v")) for ci, c in enumerate(cols)])
    long = df.select(F.explode(values).alias("x")).select("x.*").where("v is not null")
    # pass 1: one sketch per column, then a row for each column and probability
    sketches = long.groupBy("ci").agg(F.count("v").alias("n"), F.percentile_approx("v", ps, accuracy).alias("b"))
    wanted = F.array(
        *[
            F.struct(F.lit(pi).alias("pi"), F.lit(float(p)).alias("p"), F.col("b")[pi].alias("lo"), F.col("b")[pi + k].alias("hi"))
            for pi, p in enumerate(probs)
        ]
    )
    brackets = sketches.select("ci", "n", F.explode(wanted).alias("w")).select("ci", "n", "w.*")
    met = long.join(F.broadcast(brackets), "ci")  # columns x probabilities rows
    # pass 2: the values below each bracket, and its nearest neighbours: where few rows make
    # the sketch's margin less than a rank, the bracket can miss the wanted one by that rank
    under, over = F.col("v") < F.col("lo"), F.col("v") > F.col("hi")
    pos = (F.col("n") - F.lit(1)).cast("double") * F.col("p")
    sides = (
        met.groupBy("ci", "pi", "n", "p")
        .agg(
            F.count_if(under).alias("below"),
            F.max(F.when(under, F.col("v"))).alias("left"),
            F.min(F.when(over, F.col("v"))).alias("right"),
        )
        .select("ci", "pi", "below", "left", "right", pos.alias("pos"), F.floor(pos).alias("r0"), F.ceil(pos).alias("r1"))
    )
    # pass 3: rows of each distinct value inside each bracket, and the order statistics from their running count
    counted = met.where(~under & ~over).groupBy("ci", "pi", "v").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("ci", "pi").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("rows").over(upto)).join(F.broadcast(sides), ["ci", "pi"])

    def statistic(rank):
        inner = F.min(F.when(F.col("below") + F.col("upto") > F.col(rank), F.col("v")))
        first = F.when(F.first(rank) < F.first("below"), F.first("left"))
        return F.coalesce(first, inner, F.first("right"))

    picked = ranked.groupBy("ci", "pi").agg(
        statistic("r0").alias("v0"), statistic("r1").alias("v1"), (F.first("pos") - F.first("r0")).alias("share")
    )
    found = picked.select("ci", "pi", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("share")).alias("q"))
    # back to one row: a pivot over at most (columns x probabilities) small rows
    every = [(ci, pi) for ci in range(len(cols)) for pi in range(k)]
    keys = [f"{ci}_{pi}" for ci, pi in every]
    wide = found.select(F.concat_ws("_", F.col("ci").cast("string"), F.col("pi").cast("string")).alias("key"), "q")
    row = wide.groupBy().pivot("key", keys).agg(F.first("q"))
    return row.select(*[F.col(f"`{ci}_{pi}`").alias(quantile_name(cols[ci], probs[pi])) for ci, pi in every])
