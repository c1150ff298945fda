"""Queries for historical / cross-sectional and interaction features."""

from __future__ import annotations

from ebbflow.operators import calendar as CAL
from ebbflow.operators import interact as I
from ebbflow.operators import market as M
from ebbflow.plans.catalog import R, flows, query, round_floats
from ebbflow.plans.oracle_sql import HOLIDAYS_SQL, with_flows
from ebbflow.schema import D, K, TARGETS
from ebbflow.sources import adapters as A
from pyspark.sql import functions as F

T2 = ("apply_amt", "redeem_amt")
PART = "PARTITION BY fund_code ORDER BY transaction_date"


def _r(expr: str) -> str:
    return f"round({expr}, {R}) + 0.0"


def _round_cols(df, names):
    return df.select(*[(F.round(F.col(c), R).alias(c) if c in names else F.col(c)) for c in df.columns])


@query(
    "expanding_zscore",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"{t} / (avg({t}) OVER we + 1e-8) AS {t}_vs_self_expanding_mean, "
            f"{_r(f'({t} - avg({t}) OVER we) / (stddev_samp({t}) OVER we + 1e-8)')} AS {t}_self_zscore"
            for t in T2
        )
        + f" FROM flows WINDOW we AS ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ),
)
def expanding_zscore(spark, sf):
    """X2 + X3: ratio to and z-score against the mean of all earlier rows of the fund."""
    out = flows(spark, sf).select(K, D, *M.expanding_columns(T2))
    return _round_cols(out, {f"{t}_self_zscore" for t in T2})


@query(
    "rolling_zscore",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"{t} / (avg({t}) OVER w{n} + 1e-8) AS {t}_vs_historical_mean_{n}, "
            f"{_r(f'({t} - avg({t}) OVER w{n}) / (stddev_samp({t}) OVER w{n} + 1e-8)')} AS {t}_historical_zscore_{n}"
            for t in T2
            for n in (7, 14, 30)
        )
        + " FROM flows WINDOW "
        + ", ".join(f"w{n} AS ({PART} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (7, 14, 30))
    ),
)
def rolling_zscore(spark, sf):
    """Ratio to and z-score against the previous 7 / 14 / 30 rows."""
    out = flows(spark, sf).select(K, D, *M.historical_window_columns(T2))
    return _round_cols(out, {f"{t}_historical_zscore_{n}" for t in T2 for n in (7, 14, 30)})


@query(
    "hist_percentile",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"coalesce(CAST(len(list_filter(h_{t}, lambda y: y <= {t})) AS DOUBLE) / nullif(len(h_{t}), 0), 0.5) "
            f"AS {t}_historical_percentile_{n}"
            for t in T2
            for n in (7, 14, 30)
        )
        + " FROM (SELECT *, "
        + ", ".join(
            f"list({t}) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h_{t}" for t in T2
        )
        + " FROM flows)"
    ),
)
def hist_percentile(spark, sf):
    """Share of all earlier values <= today's (0.5 on the first row)."""
    out = M.add_historical_percentile(flows(spark, sf).select(K, D, *T2), T2)
    return out.select(K, D, *[f"{t}_historical_percentile_{n}" for t in T2 for n in (7, 14, 30)])


@query(
    "daily_rank",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"(rank() OVER (PARTITION BY transaction_date ORDER BY {t}) "
            f"+ (count(*) OVER (PARTITION BY transaction_date, {t}) - 1) / 2.0) "
            f"/ count(*) OVER (PARTITION BY transaction_date) AS {t}_daily_rank, "
            f"{_r(f'({t} - avg({t}) OVER (PARTITION BY transaction_date)) / nullif(stddev_samp({t}) OVER (PARTITION BY transaction_date), 0)')} AS {t}_daily_zscore, "
            f"{t} / nullif(avg({t}) OVER (PARTITION BY transaction_date), 0) AS {t}_vs_market_mean"
            for t in T2
        )
        + " FROM flows"
    ),
)
def daily_rank(spark, sf):
    """X6 + X7: same-day percent rank, z-score and ratio to the same-day mean (leaking forms)."""
    out = M.add_daily_features(flows(spark, sf).select(K, D, *T2), T2).drop(*T2)
    return _round_cols(out, {f"{t}_daily_zscore" for t in T2})


def _market_sql() -> str:
    sel = []
    for t in T2:
        sel.append(
            f"CAST(count(*) FILTER (WHERE b.{t} <= a.{t}) AS DOUBLE) / nullif(count(b.{t}), 0) AS {t}_market_pct_30d"
        )
        sel.append(
            f"{_r(f'(a.{t} - avg(b.{t})) / nullif(stddev_samp(b.{t}), 0)')} AS {t}_market_zscore_30d"
        )
    return with_flows(
        f"""SELECT a.fund_code, a.transaction_date, {', '.join(sel)}
FROM flows a LEFT JOIN flows b
  ON b.transaction_date BETWEEN a.transaction_date - INTERVAL 30 DAY AND a.transaction_date - INTERVAL 1 DAY
GROUP BY a.fund_code, a.transaction_date, {', '.join('a.' + t for t in T2)}"""
    )


@query("market_30d", _market_sql())
def market_30d(spark, sf):
    """Position among all funds' values of the previous 30 calendar days."""
    out = M.market_30d(flows(spark, sf).select(K, D, *T2), T2)
    cols = [f"{t}_market_pct_30d" for t in T2] + [f"{t}_market_zscore_30d" for t in T2]
    return _round_cols(out.select(K, D, *cols), {f"{t}_market_zscore_30d" for t in T2})


def _hist_rank_sql() -> str:
    sel = []
    for t in T2:
        m = f"{t}_historical_mean"
        sel.append(m)
        sel.append(
            f"CASE WHEN {m} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY transaction_date, {m} IS NULL ORDER BY {m}) "
            f"+ (count(*) OVER (PARTITION BY transaction_date, {m} IS NULL, {m}) - 1) / 2.0) "
            f"/ count(*) OVER (PARTITION BY transaction_date, {m} IS NULL) END AS {t}_historical_rank"
        )
    inner = ", ".join(
        f"avg({t}) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {t}_historical_mean" for t in T2
    )
    return with_flows(f"SELECT fund_code, transaction_date, {', '.join(sel)} FROM (SELECT *, {inner} FROM flows)")


@query("historical_rank", _hist_rank_sql())
def historical_rank(spark, sf):
    """Each fund's mean of earlier rows, ranked across funds per day."""
    out = M.add_historical_rank(flows(spark, sf).select(K, D, *T2), T2)
    return out.select(K, D, *[c for t in T2 for c in (f"{t}_historical_mean", f"{t}_historical_rank")])


# ------------------------------------------------------------- interactions
@query(
    "flow_ratios",
    with_flows(
        "SELECT fund_code, transaction_date, apply_amt / (redeem_amt + 1e-8) AS apply_redeem_ratio, "
        "apply_amt - redeem_amt AS net_flow, (apply_amt - redeem_amt) / (apply_amt + redeem_amt + 1e-8) AS net_flow_ratio, "
        "apply_amt + redeem_amt AS total_volume, apply_amt * redeem_amt AS flow_momentum, "
        f"{_r('sqrt(apply_amt * apply_amt + redeem_amt * redeem_amt)')} AS flow_volatility FROM flows"
    ),
)
def flow_ratios(spark, sf):
    """I1 + I5: apply/redeem ratio, net flow, net-flow ratio, volume, momentum, volatility."""
    out = flows(spark, sf).select(K, D, *I.flow_columns())
    return _round_cols(out, {"flow_volatility"})


def _uv_sql() -> str:
    uvs = ["uv_key_page_1", "uv_key_page_2", "uv_key_page_3"]
    total = "CAST(" + " + ".join(f"coalesce({u}, 0)" for u in uvs) + " AS DOUBLE)"
    sel = [f"{total} AS total_uv"]
    sel += [f"{u} / ({total} + 1e-8) AS uv_page_{i}_ratio" for i, u in enumerate(uvs, 1)]
    sel += [
        f"apply_amt / ({total} + 1e-8) AS apply_per_uv",
        f"redeem_amt / ({total} + 1e-8) AS redeem_per_uv",
        f"(apply_amt + redeem_amt) / ({total} + 1e-8) AS volume_per_uv",
    ]
    for u in uvs:
        sel += [f"apply_amt / ({u} + 1e-8) AS {u}_apply_conversion", f"redeem_amt / ({u} + 1e-8) AS {u}_redeem_conversion"]
    return with_flows(f"SELECT fund_code, transaction_date, {', '.join(sel)} FROM flows")


@query("uv_ratios", _uv_sql())
def uv_ratios(spark, sf):
    """Total UV, page shares, amounts per UV and conversions."""
    df = flows(spark, sf)
    return df.select(K, D, *I.uv_columns(df.columns))


def _effects_sql() -> str:
    sel = []
    for t in T2:
        sel += [
            f"{t} * CASE WHEN isodow(transaction_date) IN (6, 7) THEN 1 ELSE 0 END AS {t}_weekend_effect",
            f"{t} * CASE WHEN transaction_date = last_day(transaction_date) THEN 1 ELSE 0 END AS {t}_month_end_effect",
            f"{t} * CASE WHEN transaction_date IN (SELECT holiday_date FROM hol) THEN 1 ELSE 0 END AS {t}_holiday_effect",
        ]
    return with_flows(
        f"SELECT fund_code, transaction_date, {', '.join(sel)} FROM flows", extra_ctes=f"hol AS ({HOLIDAYS_SQL})"
    )


@query("calendar_effects", _effects_sql())
def calendar_effects(spark, sf):
    """Targets times the weekend, month-end and holiday flags."""
    df = flows(spark, sf)
    cal = CAL.add_holiday_flags(df.select(K, D, *T2, *CAL.date_flag_columns()), A.holidays_for(df))
    return cal.select(K, D, *I.calendar_effect_columns(TARGETS))
