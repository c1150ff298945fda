"""Time splits (M1-M3): filters and a fold table, no shuffle of the wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.schema import D


def holdout_days(n_rows_col, max_days: int = 30, share: float = 0.05):
    """min(30, floor(5 % of the row count)): the reference mixes rows and days."""
    return F.least(F.lit(max_days), F.floor(n_rows_col * F.lit(share)).cast("int"))


def holdout_split(df: DataFrame, overlap: bool = False, max_days: int = 30, share: float = 0.05, date: str = D):
    """M1: (train, valid). valid = rows later than max date - k days.

    ``overlap=True`` is the reference (train = all rows); the default keeps
    the two parts disjoint.
    """
    cut = df.agg(
        F.date_sub(F.max(date), holdout_days(F.count(F.lit(1)), max_days, share)).alias("__cut")
    )
    j = df.crossJoin(F.broadcast(cut))
    valid = j.where(F.col(date) > F.col("__cut")).drop("__cut")
    train = df if overlap else j.where(F.col(date) <= F.col("__cut")).drop("__cut")
    return train, valid


def holdout_flags(df: DataFrame, max_days: int = 30, share: float = 0.05, date: str = D) -> DataFrame:
    """M1 as a column: ``is_valid`` = 1 for the hold-out rows."""
    cut = df.agg(F.date_sub(F.max(date), holdout_days(F.count(F.lit(1)), max_days, share)).alias("__cut"))
    return (
        df.crossJoin(F.broadcast(cut))
        .withColumn("is_valid", F.when(F.col(date) > F.col("__cut"), F.lit(1)).otherwise(F.lit(0)))
        .drop("__cut")
    )


def three_way_split(df: DataFrame, train_end: str, valid_end: str, date: str = D) -> DataFrame:
    """M2: split label 'train' (<= train_end), 'valid' (<= valid_end), 'test' (later)."""
    d = F.col(date)
    label = (
        F.when(d <= F.to_date(F.lit(train_end)), F.lit("train"))
        .when(d <= F.to_date(F.lit(valid_end)), F.lit("valid"))
        .otherwise(F.lit("test"))
    )
    return df.withColumn("split", label)


def walk_forward_folds(df: DataFrame, window: int = 90, step: int = 7, date: str = D) -> DataFrame:
    """M3: fold assignment by calendar days.

    Fold f trains on days [d0 + f*step, d0 + f*step + window) and tests on the
    next ``step`` days.  A row is in the test part of one fold and in the
    train part of at most ceil(window / step) folds, so the output is a
    bounded multiple of the input; folds come from ``sequence`` per row, not
    from a join.
    """
    d0 = df.agg(F.min(date).alias("__d0"), F.max(date).alias("__d1"))
    j = df.crossJoin(F.broadcast(d0)).withColumn("__day", F.datediff(F.col(date), F.col("__d0")))
    last_fold = F.floor((F.datediff(F.col("__d1"), F.col("__d0")) - F.lit(window)) / F.lit(step))
    # test fold: day in [f*step + window, f*step + window + step)
    test_f = F.floor((F.col("__day") - F.lit(window)) / F.lit(step))
    # train folds: f*step <= day < f*step + window
    lo = F.greatest(F.ceil((F.col("__day") - F.lit(window) + F.lit(1)) / F.lit(step)), F.lit(0))
    hi = F.least(F.floor(F.col("__day") / F.lit(step)), last_fold)
    train_arr = F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
    roles = F.concat(
        F.transform(train_arr, lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
        F.when(
            (F.col("__day") >= F.lit(window)) & (test_f <= last_fold),
            F.array(F.struct(test_f.cast("int").alias("fold"), F.lit("test").alias("role"))),
        ).otherwise(F.array().cast("array<struct<fold:int,role:string>>")),
    )
    return j.select(*df.columns, F.explode(roles).alias("__r")).select(*df.columns, "__r.fold", "__r.role")
