"""Scoring (M7-M12, J5).

All scores are aggregates: per key a ``groupBy`` (partial aggregation, no
key ever gathered in one place beyond its sums), global totals by a one-row
aggregate broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.schema import D, K

SUFFIX = "_pred"


# ----------------------------------------------------------------------- J5
def align_by_position(actual: DataFrame, pred: DataFrame, key: str = K, order: str = D) -> DataFrame:
    """Match the i-th row of each key in both frames (the reference's positional match).

    Row counts per key must agree: a mismatch raises at execution time, whichever
    column the caller reads, as the check sits in every one of them.
    """
    w = Window.partitionBy(key).orderBy(order)
    a = actual.withColumn("__rn", F.row_number().over(w))
    p = pred.withColumn("__rn", F.row_number().over(w))
    pa = p.select(*[F.col(c).alias(f"__p_{c}") if c not in (key, "__rn") else F.col(c) for c in p.columns])
    j = a.join(pa, [key, "__rn"], "full_outer")
    check = F.when(
        F.col(order).isNull() | F.col(f"__p_{order}").isNull(),
        F.raise_error(F.concat(F.lit("row counts differ for key "), F.col(key))),
    )

    def checked(c: str, name: str, kind) -> Column:
        return F.coalesce(check.cast(kind), F.col(c)).alias(name)

    mine = [checked(f.name, f.name, f.dataType) for f in actual.schema.fields if f.name not in (key, order)]
    theirs = [checked(f"__p_{f.name}", f.name, f.dataType) for f in pred.schema.fields if f.name not in actual.columns]
    return j.select(key, checked(order, order, actual.schema[order].dataType), *mine, *theirs)


def align_by_date(actual: DataFrame, pred: DataFrame, key: str = K, date: str = D) -> DataFrame:
    """The better key: inner join on (key, date)."""
    keep = [c for c in pred.columns if c not in actual.columns or c in (key, date)]
    return actual.join(pred.select(*keep), [key, date], "inner")


# ----------------------------------------------------------------------- M7
def wmape_per_fund(df: DataFrame, y: str, p: str, key: str = K) -> DataFrame:
    """sum over y != 0 of |p - y| / sum y (= the reference's weighted daily errors); 0 if sum y = 0."""
    err = F.sum(F.when(F.col(y) != F.lit(0), F.abs(F.col(p) - F.col(y))))
    tot = F.sum(y)
    return df.groupBy(key).agg(
        F.when(tot == F.lit(0), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(err, tot), F.lit(0.0))).alias("wmape"),
        tot.alias("total"),
    )


# ----------------------------------------------------------------------- M8
def wmape_global_expr(y: str, p: str):
    den = F.sum(F.abs(F.col(y)))
    return F.when(den == F.lit(0), F.lit(0.0)).otherwise(F.try_divide(F.sum(F.abs(F.col(p) - F.col(y))), den))


def wmape_global(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(wmape_global_expr(y, p).alias("wmape"))


# ----------------------------------------------------------------------- M9
def competition_score(df: DataFrame, targets=("apply_amt", "redeem_amt"), key: str = K, suffix: str = SUFFIX) -> DataFrame:
    """Per target: sum over funds of wmape_i x (fund total / global total); final = mean of the two."""
    out = None
    for t in targets:
        per = wmape_per_fund(df, t, f"{t}{suffix}", key)
        glob = df.agg(F.sum(t).alias("__g"))
        w = per.crossJoin(F.broadcast(glob)).select(
            (F.col("wmape") * F.when(F.col("__g") > F.lit(0), F.col("total") / F.col("__g")).otherwise(F.lit(0.0))).alias("x")
        )
        part = w.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias(f"{t}_wmape"))
        out = part if out is None else out.crossJoin(part)
    final = sum((F.col(f"{t}_wmape") for t in targets[1:]), F.col(f"{targets[0]}_wmape")) / F.lit(float(len(targets)))
    return out.select("*", final.alias("final_wmape"))


def fund_weights(df: DataFrame, target: str, key: str = K) -> DataFrame:
    """The competition weights: fund total / global total (they sum to 1 when the total is > 0)."""
    glob = df.agg(F.sum(target).alias("__g"))
    per = df.groupBy(key).agg(F.sum(target).alias("total"))
    return per.crossJoin(F.broadcast(glob)).select(
        key, F.when(F.col("__g") > F.lit(0), F.col("total") / F.col("__g")).otherwise(F.lit(0.0)).alias("weight")
    )


# ---------------------------------------------------------------------- M10
def score_from_wmape(c: str = "wmape"):
    """1 - WMAPE: larger is better."""
    return F.lit(1.0) - F.col(c)


# ---------------------------------------------------------------------- M11
def error_metrics(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """MAE, RMSE and WMAPE (per group of ``by`` columns)."""
    aggs = [
        F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"),
        F.sqrt(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))).alias("rmse"),
        wmape_global_expr(y, p).alias("wmape"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


# ---------------------------------------------------------------------- M12
def direction_accuracy(df: DataFrame, y: str, p: str, key: str = K, date: str = D, by=()) -> DataFrame:
    """Per key the share of days with sign(diff actual) = sign(diff pred); mean over keys with > 1 row."""
    w = Window.partitionBy(*by, key).orderBy(date)
    s = df.select(
        *by,
        key,
        F.signum(F.col(y) - F.lag(y).over(w)).alias("__sa"),
        F.signum(F.col(p) - F.lag(p).over(w)).alias("__sp"),
    ).where(F.col("__sa").isNotNull() & F.col("__sp").isNotNull())
    per = s.groupBy(*by, key).agg(F.avg((F.col("__sa") == F.col("__sp")).cast("double")).alias("acc"))
    agg = F.coalesce(F.avg("acc"), F.lit(0.0)).alias("direction_accuracy")
    return per.groupBy(*by).agg(agg) if by else per.agg(agg)
