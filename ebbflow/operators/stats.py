"""Per-key statistics over the last N rows.

Plan shape: one Exchange on the key; ``row_number`` (descending) keeps the
last N rows, the series windows (pct change, RSI, Bollinger, drawdown ...)
run on the same partitioning, and the final ``groupBy(key)`` needs no new
shuffle.  Groups are bounded by N rows, so per-group percentiles are exact
``percentile`` aggregates of at most N values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions.exprs import (
    bias_corrected_kurt,
    bias_corrected_skew,
    clip,
    eps_ratio,
    pct_change,
    sample_corr,
)
from ebbflow.schema import D, EPS, K

SQRT252 = math.sqrt(252.0)  # fixed value: trading days per year


def last_n(df: DataFrame, n: int = 60, key: str = K, date: str = D) -> DataFrame:
    """A0: the last ``n`` rows of every key (top-k per group)."""
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= F.lit(n)).drop("__rn")


def _prepared(df: DataFrame, n: int, key: str, date: str) -> DataFrame:
    """Last-n rows with the row-level series the statistics need."""
    a, r = F.col("apply_amt"), F.col("redeem_amt")
    rows = df.select(key, date, "apply_amt", "redeem_amt", F.count(F.lit(1)).over(Window.partitionBy(key)).alias("history"))
    base = last_n(rows, n, key, date)
    w = Window.partitionBy(key).orderBy(date)
    s1 = base.select(
        key,
        date,
        "apply_amt",
        "redeem_amt",
        "history",
        (a - r).alias("net"),
        (a + r).alias("vol"),
        F.row_number().over(w).alias("idx"),
        F.count(F.lit(1)).over(Window.partitionBy(key)).alias("cnt"),
        pct_change("apply_amt", F.lag("apply_amt", 1).over(w)).alias("apply_pct"),
        pct_change("redeem_amt", F.lag("redeem_amt", 1).over(w)).alias("redeem_pct"),
        pct_change(a + r, F.lag(a + r, 1).over(w)).alias("vol_pct"),
        pct_change(a - r, F.lag(a - r, 1).over(w)).alias("ret"),
        pct_change(a - r, F.lag(a - r, 10).over(w)).alias("mom10"),
        ((a - r) - F.lag(a - r, 1).over(w)).alias("dnet"),
        F.weekday(date).isin(5, 6).alias("is_weekend"),
        (F.col(date) == F.last_day(date)).alias("is_month_end"),
    )
    gain = F.when(F.col("dnet") > F.lit(0), F.col("dnet")).otherwise(F.lit(0.0))
    loss = F.when(F.col("dnet") < F.lit(0), -F.col("dnet")).otherwise(F.lit(0.0))
    w14 = w.rowsBetween(-13, 0)
    w20 = w.rowsBetween(-19, 0)
    w5 = w.rowsBetween(-4, 0)
    wcum = w.rowsBetween(Window.unboundedPreceding, 0)
    rs = F.try_divide(F.avg(gain).over(w14), F.avg(loss).over(w14) + F.lit(EPS))
    s2 = s1.select(
        "*",
        (F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + rs)).alias("rsi14"),
        F.try_divide(F.col("net") - F.avg("net").over(w20), F.lit(2.0) * F.stddev_samp("net").over(w20) + F.lit(EPS)).alias("bpos"),
        eps_ratio(F.col("net") - F.min("net").over(w5), F.max("net").over(w5) - F.min("net").over(w5)).alias("sr"),
        F.product(F.lit(1.0) + F.col("ret")).over(wcum).alias("cum"),
        F.row_number().over(Window.partitionBy(key).orderBy("vol")).alias("vrank"),
        F.percentile("ret", 0.05).over(Window.partitionBy(key)).alias("var95_w"),
    )
    runmax = F.max("cum").over(wcum)
    return s2.select("*", F.try_divide(F.col("cum") - runmax, runmax).alias("dd"))


def _at_last(c: str):
    return F.max(F.when(F.col("idx") == F.col("cnt"), F.col(c)))


def _fund_aggs():
    a, r = F.col("apply_amt"), F.col("redeem_amt")
    return [
        F.avg(a).alias("avg_apply"),
        F.avg(r).alias("avg_redeem"),
        F.stddev_samp(a).alias("std_apply"),
        F.stddev_samp(r).alias("std_redeem"),
        F.max(a).alias("max_apply"),
        F.max(r).alias("max_redeem"),
        F.avg(a - r).alias("avg_net_flow"),
    ]


def fund_stats(df: DataFrame, n: int = 60, key: str = K, date: str = D, history: bool = True) -> DataFrame:
    """A1: mean / sample std / max of both targets and mean net flow over the last n rows.

    ``history`` adds ``history_days``: the number of rows of the key's whole history.
    """
    stats = last_n(df.select(key, date, "apply_amt", "redeem_amt"), n, key, date).groupBy(key).agg(*_fund_aggs())
    if history:
        hist = df.groupBy(key).agg(F.count(F.lit(1)).alias("history_days"))
        stats = stats.join(hist, key)
    return stats


def summary_stats(df: DataFrame, n: int = 30, key: str = K, date: str = D) -> DataFrame:
    """Min / max / mean / std of both targets, mean net flow and mean apply/redeem ratio."""
    a, r = F.col("apply_amt"), F.col("redeem_amt")
    aggs = []
    for t, short in (("apply_amt", "apply"), ("redeem_amt", "redeem")):
        aggs += [
            F.min(t).alias(f"{short}_min"),
            F.max(t).alias(f"{short}_max"),
            F.avg(t).alias(f"{short}_mean"),
            F.stddev_samp(t).alias(f"{short}_std"),
        ]
    # ratio mean over days with redemptions: a zero day would put ~1e8 x apply into the mean
    aggs += [F.avg(a - r).alias("net_flow_mean"), F.avg(F.try_divide(a, F.when(r > F.lit(0), r))).alias("ratio_mean")]
    return last_n(df.select(key, date, "apply_amt", "redeem_amt"), n, key, date).groupBy(key).agg(*aggs)


def _behavior_aggs():
    a, r, v = F.col("apply_amt"), F.col("redeem_amt"), F.col("vol")
    cnt = F.count(F.lit(1))
    total = F.sum(a) + F.sum(r)
    sum_v = F.sum(v)
    gini = F.when(
        sum_v > F.lit(0),
        F.lit(2.0) * F.sum(F.col("vrank") * v) / (cnt * sum_v) - (cnt + F.lit(1)) / cnt,
    ).otherwise(F.lit(0.0))
    return [
        F.coalesce(sample_corr(a, r), F.lit(0.0)).alias("correlation"),
        F.when(cnt > F.lit(1), F.stddev_samp("net")).otherwise(F.lit(0.0)).alias("net_flow_vol"),
        F.when(cnt > F.lit(1), F.avg("apply_pct")).otherwise(F.lit(0.0)).alias("apply_trend"),
        F.when(cnt > F.lit(1), F.avg("redeem_pct")).otherwise(F.lit(0.0)).alias("redeem_trend"),
        eps_ratio(
            F.coalesce(F.sum(F.when(F.col("is_weekend"), a)), F.lit(0.0))
            + F.coalesce(F.sum(F.when(F.col("is_weekend"), r)), F.lit(0.0)),
            total,
        ).alias("weekend_ratio"),
        eps_ratio(
            F.coalesce(F.sum(F.when(F.col("is_month_end"), a)), F.lit(0.0))
            + F.coalesce(F.sum(F.when(F.col("is_month_end"), r)), F.lit(0.0)),
            total,
        ).alias("month_end_ratio"),
        gini.alias("concentration"),
    ]


def behavior_stats(df: DataFrame, n: int = 60, key: str = K, date: str = D) -> DataFrame:
    """A2-A5: correlation, net-flow volatility, trends, weekend / month-end share, Gini concentration."""
    return _prepared(df, n, key, date).groupBy(key).agg(*_behavior_aggs())


def gini(df: DataFrame, value: str, key: str = K) -> DataFrame:
    """A5 alone: Gini concentration of ``value`` per key over all its rows."""
    w = Window.partitionBy(key).orderBy(value)
    ranked = df.select(key, F.col(value).alias("__v"), F.row_number().over(w).alias("__i"))
    cnt = F.count(F.lit(1))
    s = F.sum("__v")
    return ranked.groupBy(key).agg(
        F.when(s > F.lit(0), F.lit(2.0) * F.sum(F.col("__i") * F.col("__v")) / (cnt * s) - (cnt + F.lit(1)) / cnt)
        .otherwise(F.lit(0.0))
        .alias("concentration")
    )


def _signal_aggs():
    cnt = F.count(F.lit(1))
    trend = F.abs(sample_corr(F.col("idx").cast("double"), F.col("net")))
    return [
        F.coalesce(_at_last("rsi14"), F.lit(50.0)).alias("rsi"),
        F.when(cnt > F.lit(10), F.coalesce(_at_last("mom10"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("momentum"),
        clip(_at_last("bpos"), -1.0, 1.0).alias("bollinger_pos"),
        F.when(cnt > F.lit(1), F.coalesce(F.avg("vol_pct"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("volume_trend"),
        F.when(cnt > F.lit(5), F.coalesce(trend, F.lit(0.0))).otherwise(F.lit(0.0)).alias("trend_strength"),
        clip(_at_last("sr"), 0.0, 1.0).alias("support_resistance"),
    ]


def signal_stats(df: DataFrame, n: int = 60, key: str = K, date: str = D) -> DataFrame:
    """Last RSI-14, 10-row momentum, Bollinger position, volume trend, trend strength, support/resistance."""
    return _prepared(df, n, key, date).groupBy(key).agg(*_signal_aggs())


def _risk_aggs():
    ret = F.col("ret")
    m = F.count(ret)
    std = F.stddev_samp(ret)
    few = m < F.lit(5)
    z = F.lit(0.0)
    return [
        F.when(few, z).otherwise(F.percentile(ret, 0.05)).alias("var95"),
        F.when(few, z).otherwise(F.min("dd")).alias("max_drawdown"),
        F.when(few, z).otherwise(F.avg(ret) / (std + F.lit(EPS)) * F.lit(SQRT252)).alias("sharpe"),
        F.when(few, z).otherwise(std * F.lit(SQRT252)).alias("volatility"),
        F.when(few, z).otherwise(F.coalesce(bias_corrected_skew(m.cast("double"), F.skewness(ret)), z)).alias("skewness"),
        F.when(few, z).otherwise(F.coalesce(bias_corrected_kurt(m.cast("double"), F.kurtosis(ret)), z)).alias("kurtosis"),
        F.when(few, z)
        .otherwise(F.coalesce(F.avg(F.when(ret <= F.col("var95_w"), ret)), z))
        .alias("tail_risk"),
    ]


def risk_stats(df: DataFrame, n: int = 60, key: str = K, date: str = D) -> DataFrame:
    """VaR 95, max drawdown, Sharpe, volatility, skewness, kurtosis, tail risk; zeros below 5 returns."""
    return _prepared(df, n, key, date).groupBy(key).agg(*_risk_aggs())


def all_fund_stats(df: DataFrame, n: int = 60, key: str = K, date: str = D) -> DataFrame:
    """A1-A17 in one row per key: one preparation and one aggregate."""
    history = F.max("history").alias("history_days")
    return _prepared(df, n, key, date).groupBy(key).agg(
        *_fund_aggs(), history, *_behavior_aggs(), *_signal_aggs(), *_risk_aggs()
    )
