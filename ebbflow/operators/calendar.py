"""Calendar features.

D1-D4 are per-row expressions.  D5 joins a holiday table once: the table is
first turned into (date, is_holiday, is_before_holiday, is_after_holiday)
flags, so one broadcast equi-join replaces three look-ups; its size is a few
rows per calendar year, a proven bound.  D6 is an average rank in a window
by (key, month).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.exprs import average_rank
from ebbflow.schema import D, K

TWO_PI = 2.0 * math.pi


def date_part_columns(date: str = D) -> list[Column]:
    """Month, day_of_week (Mon=0), day_of_month, day_of_year, ISO week, quarter."""
    d = F.col(date)
    return [
        F.month(d).alias("month"),
        F.weekday(d).alias("day_of_week"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        F.quarter(d).alias("quarter"),
    ]


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def date_flag_columns(date: str = D) -> list[Column]:
    """D2 + D3: weekend and period start / end flags (0/1 ints)."""
    d = F.col(date)
    m = F.month(d)
    first = F.dayofmonth(d) == F.lit(1)
    last = d == F.last_day(d)
    return [
        _flag(F.weekday(d).isin(5, 6)).alias("is_weekend"),
        _flag(first).alias("is_month_start"),
        _flag(last).alias("is_month_end"),
        _flag(first & m.isin(1, 4, 7, 10)).alias("is_quarter_start"),
        _flag(last & m.isin(3, 6, 9, 12)).alias("is_quarter_end"),
        _flag(first & (m == F.lit(1))).alias("is_year_start"),
        _flag(last & (m == F.lit(12))).alias("is_year_end"),
    ]


def cyclic_columns(date: str = D) -> list[Column]:
    """Sine / cosine of month (/12), weekday (/7) and day of year (/365)."""
    d = F.col(date)
    parts = [("month", F.month(d), 12), ("day_of_week", F.weekday(d), 7), ("day_of_year", F.dayofyear(d), 365)]
    out = []
    for name, x, p in parts:
        ang = F.lit(TWO_PI) * x / F.lit(float(p))
        out += [F.sin(ang).alias(f"sin_{name}"), F.cos(ang).alias(f"cos_{name}")]
    return out


def holiday_flag_table(holidays: DataFrame, col: str = "holiday_date") -> DataFrame:
    """(date, is_holiday, is_before_holiday, is_after_holiday) for every date next to a holiday."""
    h = F.col(col)
    marks = holidays.select(
        F.explode(
            F.array(
                F.struct(h.alias("d"), F.lit(1).alias("hol"), F.lit(0).alias("bef"), F.lit(0).alias("aft")),
                # the day before a holiday is "before holiday"
                F.struct(F.date_sub(h, 1).alias("d"), F.lit(0).alias("hol"), F.lit(1).alias("bef"), F.lit(0).alias("aft")),
                F.struct(F.date_add(h, 1).alias("d"), F.lit(0).alias("hol"), F.lit(0).alias("bef"), F.lit(1).alias("aft")),
            )
        ).alias("m")
    )
    return marks.groupBy(F.col("m.d").alias("__hdate")).agg(
        F.max("m.hol").alias("is_holiday"),
        F.max("m.bef").alias("is_before_holiday"),
        F.max("m.aft").alias("is_after_holiday"),
    )


def add_holiday_flags(df: DataFrame, holidays: DataFrame, date: str = D) -> DataFrame:
    """Left join to the (small, broadcast) holiday flag table."""
    flags = holiday_flag_table(holidays)
    j = df.join(F.broadcast(flags), df[date] == flags["__hdate"], "left").drop("__hdate")
    return j.fillna(0, subset=["is_holiday", "is_before_holiday", "is_after_holiday"])


def add_month_rank(df: DataFrame, key: str = K, date: str = D) -> DataFrame:
    return (
        df.withColumn("__month", F.trunc(F.col(date), "MM"))
        .withColumn("work_days_since_month_start", average_rank(date, [key, "__month"]))
        .drop("__month")
    )


def add_date_features(df: DataFrame, holidays: DataFrame | None = None, date: str = D, key: str = K) -> DataFrame:
    """D1-D6, the reference's date stage; without a holiday table the D5 flags are 0."""
    out = df.select("*", *date_part_columns(date), *date_flag_columns(date), *cyclic_columns(date))
    if holidays is not None:
        out = add_holiday_flags(out, holidays, date)
    else:
        out = out.select("*", *[F.lit(0).alias(c) for c in ("is_holiday", "is_before_holiday", "is_after_holiday")])
    return add_month_rank(out, key, date)
