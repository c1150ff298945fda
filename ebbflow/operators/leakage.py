"""Leakage checks (K1-K5).

K1 and K5 are aggregates; K2 is a rule on column names; K3 runs the feature
plan on the full table, a truncated one and one with a day perturbed, and compares
them by fingerprints for each column and block of days, which one aggregate makes
of each run; only blocks that differ are joined row by row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.exprs import sample_corr
from ebbflow.operators.clean import numeric_columns
from ebbflow.operators.metrics import wmape_global_expr
from ebbflow.schema import D, K, TARGETS
from ebbflow.session import cut_lineage


def _long(wide: DataFrame, cols, field: str) -> DataFrame:
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(field)) for c in cols])).alias("x")
    ).select("x.*")


# ------------------------------------------------------------------------ K1
def future_variance(df: DataFrame, start, cols=None, date: str = D, tol: float = 1e-12) -> DataFrame:
    """(column, max_daily_variance, suspicious): cross-key variance per future date, max over dates.

    A feature whose variance is 0 (below ``tol``: floating sums of equal
    values may leave ~1e-30) on every future date does not tell the keys
    apart in the forecast period.
    """
    cols = list(cols or numeric_columns(df, exclude=(K, date, *TARGETS)))
    fut = df.where(F.col(date) >= F.to_date(F.lit(str(start))))
    daily = fut.groupBy(date).agg(*[F.var_samp(F.col(f"`{c}`")).alias(c) for c in cols])
    mx = daily.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in cols])
    return _long(mx, cols, "max_daily_variance").withColumn(
        "suspicious", F.coalesce(F.col("max_daily_variance") <= F.lit(tol), F.lit(False))
    )


# ------------------------------------------------------------------------ K2
def is_available(name: str) -> bool:
    """Can the feature be computed at prediction time? (same-day cross-key ranks / market means cannot)."""
    if "daily_rank" in name:
        return False
    if "market_mean" in name and "historical" not in name:
        return False
    return True


def availability(df: DataFrame) -> DataFrame:
    """(column, available) for every column of ``df`` (a tiny frame of names)."""
    rows = [(c, is_available(c)) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, available boolean")


# ------------------------------------------------------------------------ K3
#: Days in one block of fingerprints.
BLOCK_DAYS = 16
#: The relative difference up to which two numbers count as equal: the order of additions may differ.
CLOSE = 1e-9


def _significant(c: str) -> Column:
    """A number in single precision, where the order of additions seldom shows (a block that differs for it is looked into)."""
    return F.col(f"`{c}`").cast("float") + F.lit(0.0).cast("float")


def fingerprints(df: DataFrame, cols, key: str = K, date: str = D) -> DataFrame:
    """One row for each block of days: for every column a hash of its values that does not depend on the order of rows."""
    numbers = set(numeric_columns(df))
    value = {c: _significant(c) if c in numbers else F.col(f"`{c}`").cast("string") for c in cols}
    marks = [F.bit_xor(F.xxhash64(F.col(key), F.col(date), value[c])).alias(f"c{i}") for i, c in enumerate(cols)]
    return df.groupBy(_block(date).alias("block")).agg(F.count(F.lit(1)).alias("n"), *marks)


def _block(date: str) -> Column:
    return F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / F.lit(BLOCK_DAYS))


def differing_blocks(a: DataFrame, b: DataFrame, cols, key: str = K, date: str = D) -> dict[str, list[int]]:
    """The blocks in which a column differs between two runs: one aggregate of each run."""
    fa, fb = fingerprints(a, cols, key, date).alias("a"), fingerprints(b, cols, key, date).alias("b")
    apart = F.array(*[F.when(~F.col(f"a.c{i}").eqNullSafe(F.col(f"b.c{i}")), F.lit(i)) for i in range(len(cols))])
    both = fa.join(fb, F.col("a.block") == F.col("b.block"), "full").select(
        F.coalesce("a.block", "b.block").alias("block"), F.explode(F.filter(apart, lambda i: i.isNotNull())).alias("i")
    )
    out: dict[str, list[int]] = {}
    for r in both.collect():  # a number for each block of days and column at most
        out.setdefault(cols[r["i"]], []).append(r["block"])
    return out


def differences(a: DataFrame, b: DataFrame, cols, key: str = K, date: str = D) -> DataFrame:
    """(column, n_diff, first_date) of every column: rows of both runs whose values differ, found from the blocks that do."""
    spark, found = a.sparkSession, differing_blocks(a, b, cols, key, date)
    none = spark.createDataFrame([(c,) for c in cols], "column string")
    if not found:
        return none.select("column", F.lit(0).cast("long").alias("n_diff"), F.lit(None).cast("date").alias("first_date"))
    blocks = sorted({k for held in found.values() for k in held})
    numbers = set(numeric_columns(a))
    named = list(found)
    some = [df.where(_block(date).isin(blocks)).select(key, date, *[F.col(f"`{c}`") for c in named]) for df in (a, b)]
    j = some[0].alias("a").join(some[1].alias("b"), [key, date], "inner")
    aggs = []
    for i, c in enumerate(named):
        x, y = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        same = x.eqNullSafe(y)
        if c in numbers:
            same = same | F.coalesce(F.abs(x - y) <= F.lit(CLOSE) * (F.abs(x) + F.abs(y)), F.lit(False))
        aggs += [F.sum((~same).cast("bigint")).alias(f"n{i}"), F.min(F.when(~same, F.col(date))).alias(f"d{i}")]
    row = j.agg(*aggs)
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_diff"), F.col(f"d{i}").alias("first_date")) for i, c in enumerate(named)])).alias("r"))
    return none.join(long.select("r.*"), "column", "left").select("column", F.coalesce("n_diff", F.lit(0).cast("long")).alias("n_diff"), "first_date")


def truncation_test(df: DataFrame, build: Callable[[DataFrame], DataFrame], cutoff, key: str = K, date: str = D,
                    targets=TARGETS) -> DataFrame:
    """(column, n_diff_future, first_date, n_diff_same_day) per feature.

    ``n_diff_future``: rows <= cutoff whose value changes when the rows after
    the cutoff are removed (look-ahead), ``first_date`` the first of them.  ``n_diff_same_day``: rows on the
    cutoff date whose value changes when that day's targets are perturbed
    (the feature reads the same day's target).  Each run of ``build`` is written once and read
    by fingerprints; rows are joined only in the blocks of days that differ.
    """
    cut = F.to_date(F.lit(str(cutoff)))
    full = cut_lineage(build(df).where(F.col(date) <= cut))
    trunc = cut_lineage(build(df.where(F.col(date) <= cut)))
    cols = [c for c in full.columns if c not in (key, date, *targets)]
    look = differences(full, trunc, cols, key, date).withColumnRenamed("n_diff", "n_diff_future")
    pert = df.select(
        *[
            (F.when(F.col(date) == cut, F.col(c) * F.lit(1.5) + F.lit(1.0)).otherwise(F.col(c)).alias(c) if c in targets else F.col(c))
            for c in df.columns
        ]
    )
    moved = cut_lineage(build(pert).where(F.col(date) == cut))
    same = differences(full.where(F.col(date) == cut), moved, cols, key, date)
    return look.join(same.select("column", F.col("n_diff").alias("n_diff_same_day")), "column")


# ------------------------------------------------------------------------ K4
def score_gap(train_pred: DataFrame, valid_pred: DataFrame, y: str, p: str) -> DataFrame:
    """(train_wmape, valid_wmape, ratio, suspicious): a gap of 2x or more is suspicious."""
    tr = train_pred.agg(wmape_global_expr(y, p).alias("train_wmape"))
    va = valid_pred.agg(wmape_global_expr(y, p).alias("valid_wmape"))
    ratio = F.try_divide(F.col("valid_wmape"), F.col("train_wmape"))
    return tr.crossJoin(va).select("*", ratio.alias("ratio"), F.coalesce(ratio >= F.lit(2.0), F.lit(False)).alias("suspicious"))


# ------------------------------------------------------------------------ K5
def suspicious_correlation(df: DataFrame, target: str, top: int = 20, threshold: float = 0.99, cols=None) -> DataFrame:
    """Top features by |corr with the target|; above ``threshold`` they likely encode the target."""
    cols = list(cols or numeric_columns(df, exclude=(K, D, *TARGETS)))
    wide = df.agg(*[F.abs(sample_corr(F.col(f"`{c}`"), F.col(target))).alias(c) for c in cols])
    long = _long(wide, cols, "abs_corr")
    return (
        long.where(F.col("abs_corr").isNotNull())
        .orderBy(F.desc("abs_corr"), "column")
        .limit(top)
        .withColumn("suspicious", F.col("abs_corr") > F.lit(threshold))
    )


def permutation_importance(df: DataFrame, features: list[str], target: str, score: Callable[[np.ndarray], np.ndarray],
                           bucket_rows: int = 5000, seed: int = 7) -> DataFrame:
    """(feature, base_wmape, permuted_wmape, importance): how much worse the model is without a feature's order, from one scan.

    ``score`` gives the predictions of an array (rows x features).  Rows are dealt by a hash of key and date into
    buckets of about ``bucket_rows``; within a bucket each feature in turn gets the values of other
    rows, by a seeded shift of their order, and the bucket's errors are summed for all features at once.  NULLs
    reach ``score`` as NaN.
    """
    rows = df.where(F.col(target).isNotNull()).select(
        F.xxhash64(K, D, F.lit(seed)).alias("h"), F.col(target).cast("double").alias("y"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    )
    n_buckets = max(1, -(-rows.count() // bucket_rows))
    n = len(features)

    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("h", "ascending"), ("y", "ascending")])
        y = bucket.column("y").to_numpy()
        x = np.stack([bucket.column(f"x{i}").to_numpy() for i in range(n)], axis=1)
        shift = 1 + (seed + int(bucket.column("h")[0].as_py() & 0xFFFF)) % max(len(y) - 1, 1)
        base = float(np.abs(score(x) - y).sum())
        errors = []
        for i in range(n):
            moved = x.copy()
            moved[:, i] = np.roll(x[:, i], shift)
            errors.append(float(np.abs(score(moved) - y).sum()))
        size = float(np.abs(y).sum())
        return pa.table({"i": pa.array(range(n), pa.int32()), "base": pa.array([base] * n), "moved": pa.array(errors), "size": pa.array([size] * n)})

    dealt = rows.withColumn("bucket", F.pmod("h", F.lit(n_buckets)))
    sums = dealt.groupBy("bucket").applyInArrow(run, "i int, base double, moved double, size double")
    named = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("i") + 1).alias("feature")
    out = sums.groupBy("i").agg(F.sum("base").alias("base"), F.sum("moved").alias("moved"), F.sum("size").alias("size"))
    base, moved = F.try_divide("base", "size"), F.try_divide("moved", "size")
    return out.select(named, base.alias("base_wmape"), moved.alias("permuted_wmape"), (moved - base).alias("importance"))
