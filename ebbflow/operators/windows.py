"""Row-window features per key.

All frames are ROWS frames over ``Window.partitionBy(fund_code).orderBy(date)``
exactly as the reference (a missing day shifts them).  Each builder returns a
list of column expressions so that a whole stage is issued in one ``select``:
Catalyst then plans one Exchange on the key and one sort, and evaluates every
frame of the same spec in one Window operator.

Scale note: the flow table has one row per (key, day), so a partition of this
window holds at most one row per calendar day of that key; every frame here
is bounded (at most 30 rows back), so the Window operator streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.exprs import eps_ratio, fund_window, pct_change
from ebbflow.schema import D, K, FlowConfig, series_cols


def _w(key=K, date=D):
    return fund_window(key, date)


# ------------------------------------------------------------------------- W1
def lag_columns(cols, lags=(1, 3, 7, 14), key=K, date=D) -> list[Column]:
    w = _w(key, date)
    return [F.lag(c, n).over(w).alias(f"{c}_lag_{n}") for c in cols for n in lags]


# ------------------------------------------------------------------- W2 / W3
def rolling_columns(cols, windows=(7, 14, 30), key=K, date=D, with_ratio=True) -> list[Column]:
    """Mean / sample std / max / min of the previous n rows (today excluded)."""
    out = []
    base = _w(key, date)
    for c in cols:
        for n in windows:
            w = base.rowsBetween(-n, -1)
            mean = F.avg(c).over(w)
            out += [
                mean.alias(f"{c}_roll_mean_{n}"),
                F.stddev_samp(c).over(w).alias(f"{c}_roll_std_{n}"),
                F.max(c).over(w).alias(f"{c}_roll_max_{n}"),
                F.min(c).over(w).alias(f"{c}_roll_min_{n}"),
            ]
            if with_ratio:
                out.append(eps_ratio(c, mean).alias(f"{c}_vs_roll_mean_{n}"))
    return out


# -------------------------------------------------------------- W4 / W5 / W6
def diff_columns(cols, periods=(1, 7, 14), key=K, date=D, accel_max: int = 7) -> list[Column]:
    out = []
    w = _w(key, date)
    for c in cols:
        for n in periods:
            lagged = F.lag(c, n).over(w)
            out.append((F.col(c) - lagged).alias(f"{c}_diff_{n}"))
            out.append(pct_change(c, lagged).alias(f"{c}_pct_change_{n}"))
            if n <= accel_max:
                # diff_n(t) - diff_n(t-1) = x(t) - x(t-1) - x(t-n) + x(t-n-1)
                accel = (F.col(c) - lagged) - (F.lag(c, 1).over(w) - F.lag(c, n + 1).over(w))
                out.append(accel.alias(f"{c}_acceleration_{n}"))
    return out


# ------------------------------------------------------------------------- W7
def rolling_inclusive_columns(cols, windows=(7,), key=K, date=D, centred: bool = False) -> list[Column]:
    """Right-aligned mean including today; ``centred=True`` is the leaking form (K3 negative case)."""
    out = []
    base = _w(key, date)
    for c in cols:
        for n in windows:
            if centred:
                half = n // 2
                w = base.rowsBetween(-half, n - 1 - half)
                out.append(F.avg(c).over(w).alias(f"{c}_roll_mean_centred_{n}"))
            else:
                w = base.rowsBetween(-(n - 1), 0)
                out.append(F.avg(c).over(w).alias(f"{c}_roll_mean_incl_{n}"))
    return out


# ---------------------------------------------------------------- operators
def add_rolling(df: DataFrame, cfg: FlowConfig = FlowConfig(), cols=None) -> DataFrame:
    return df.select("*", *rolling_columns(cols or series_cols(df.columns, cfg), cfg.rolling_windows))


def add_diffs(df: DataFrame, cfg: FlowConfig = FlowConfig(), cols=None) -> DataFrame:
    return df.select("*", *diff_columns(cols or series_cols(df.columns, cfg), cfg.diff_periods))


def time_series_columns(df_columns, cfg: FlowConfig = FlowConfig()) -> list[Column]:
    """W1-W6 for every series column (the reference's time-series stage)."""
    cols = series_cols(df_columns, cfg)
    return (
        lag_columns(cols, cfg.lag_periods)
        + rolling_columns(cols, cfg.rolling_windows)
        + diff_columns(cols, cfg.diff_periods)
    )


def add_time_series_features(df: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    return df.select("*", *time_series_columns(df.columns, cfg))
