"""Queries for the window feature stages (W*, T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import windows as W
from ebbflow.plans.catalog import R, flows, query, round_floats
from ebbflow.plans.oracle_sql import with_flows
from ebbflow.schema import D, K

ROLL_COLS = ("apply_amt", "redeem_amt", "uv_key_page_1")


def _rolling_sql() -> str:
    parts, wins = [], []
    for n in (7, 14, 30):
        wins.append(
            f"w{n} AS (PARTITION BY fund_code ORDER BY transaction_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        )
    for c in ROLL_COLS:
        for n in (7, 14, 30):
            parts += [
                f"round(avg({c}) OVER w{n}, {R}) AS {c}_roll_mean_{n}",
                f"round(stddev_samp({c}) OVER w{n}, {R}) AS {c}_roll_std_{n}",
                f"round(CAST(max({c}) OVER w{n} AS DOUBLE), {R}) AS {c}_roll_max_{n}",
                f"round(CAST(min({c}) OVER w{n} AS DOUBLE), {R}) AS {c}_roll_min_{n}",
            ]
    return with_flows(
        f"SELECT fund_code, transaction_date, {', '.join(parts)} FROM flows WINDOW {', '.join(wins)}"
    )


@query("rolling_stats", _rolling_sql())
def rolling_stats(spark, sf):
    """Previous-n-row mean / std / max / min (the minimum slice query)."""
    df = flows(spark, sf).select(K, D, *[F.col(c).cast("double").alias(c) for c in ROLL_COLS])
    out = df.select(K, D, *W.rolling_columns(ROLL_COLS, (7, 14, 30), with_ratio=False))
    return round_floats(out)


SERIES = ("apply_amt", "redeem_amt", "uv_key_page_1", "uv_key_page_2", "uv_key_page_3")
WIN = "WINDOW w AS (PARTITION BY fund_code ORDER BY transaction_date)"


def _r(expr: str) -> str:
    """Rounded oracle value; ``+ 0.0`` turns a negative zero into zero."""
    return f"round({expr}, {R}) + 0.0"


@query(
    "lags",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(f"lag({c}, {n}) OVER w AS {c}_lag_{n}" for c in SERIES for n in (1, 3, 7, 14))
        + f" FROM flows {WIN}"
    ),
)
def lags(spark, sf):
    """Lags 1, 3, 7, 14 of every series column."""
    df = flows(spark, sf)
    return df.select(K, D, *W.lag_columns(SERIES, (1, 3, 7, 14)))


@query(
    "rolling_inclusive",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"avg({c}) OVER (PARTITION BY fund_code ORDER BY transaction_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS {c}_roll_mean_incl_7"
            for c in ("apply_amt", "redeem_amt")
        )
        + " FROM flows"
    ),
)
def rolling_inclusive(spark, sf):
    """Right-aligned 7-row mean including today."""
    df = flows(spark, sf)
    return df.select(K, D, *W.rolling_inclusive_columns(("apply_amt", "redeem_amt"), (7,)))


def _ratio_sql() -> str:
    parts = []
    for c in ("apply_amt", "redeem_amt"):
        for n in (7, 14, 30):
            parts.append(
                f"{c} / (avg({c}) OVER (PARTITION BY fund_code ORDER BY transaction_date "
                f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) + 1e-8) AS {c}_vs_roll_mean_{n}"
            )
    return with_flows(f"SELECT fund_code, transaction_date, {', '.join(parts)} FROM flows", "lineitem_week")


@query("ratio_to_rolling", _ratio_sql())
def ratio_to_rolling(spark, sf):
    """Value / (previous-n-row mean + 1e-8), on the dense weekly adapter."""
    df = flows(spark, sf, "lineitem_week")
    cols = [c for c in W.rolling_columns(("apply_amt", "redeem_amt"), (7, 14, 30)) if "_vs_roll_mean_" in str(c)]
    return df.select(K, D, *cols)


@query(
    "diffs",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(f"{c} - lag({c}, {n}) OVER w AS {c}_diff_{n}" for c in SERIES for n in (1, 7, 14))
        + f" FROM flows {WIN}"
    ),
)
def diffs(spark, sf):
    """Differences over 1, 7, 14 rows."""
    df = flows(spark, sf)
    cols = [c for c in W.diff_columns(SERIES, (1, 7, 14)) if "_diff_" in str(c)]
    return df.select(K, D, *cols)


@query(
    "pct_change",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"CAST({c} AS DOUBLE) / nullif(lag({c}, {n}) OVER w, 0) - 1 AS {c}_pct_change_{n}"
            for c in SERIES
            for n in (1, 7, 14)
        )
        + f" FROM flows {WIN}"
    ),
)
def pct_change(spark, sf):
    """Percent change over n rows; NULL where the earlier value is 0."""
    df = flows(spark, sf)
    cols = [c for c in W.diff_columns(SERIES, (1, 7, 14)) if "_pct_change_" in str(c)]
    return df.select(K, D, *cols)


@query(
    "acceleration",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"({c} - lag({c}, {n}) OVER w) - (lag({c}, 1) OVER w - lag({c}, {n + 1}) OVER w) AS {c}_acceleration_{n}"
            for c in SERIES
            for n in (1, 7)
        )
        + f" FROM flows {WIN}"
    ),
)
def acceleration(spark, sf):
    """Difference of the n-row difference (n <= 7)."""
    df = flows(spark, sf)
    cols = [c for c in W.diff_columns(SERIES, (1, 7, 14)) if "_acceleration_" in str(c)]
    return df.select(K, D, *cols)
