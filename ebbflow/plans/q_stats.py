"""Queries for per-fund statistics over the last N rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import attributes as AT
from ebbflow.operators import stats as S
from ebbflow.plans.catalog import R, flows, query, round_floats
from ebbflow.plans.oracle_sql import ORACLE, with_flows
from ebbflow.schema import D, K


def _r(expr: str) -> str:
    return f"round({expr}, {R}) + 0.0"


def _last(n: int) -> str:
    return (
        f"SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY fund_code ORDER BY transaction_date DESC) <= {n}"
    )


# The last-60 rows with the row-level series of the statistics.
SERIES_CTE = f"""s0 AS ({_last(60)}),
s AS (
  SELECT *, apply_amt - redeem_amt AS net, apply_amt + redeem_amt AS vol,
    row_number() OVER w AS idx, count(*) OVER (PARTITION BY fund_code) AS cnt,
    apply_amt / nullif(lag(apply_amt) OVER w, 0) - 1 AS apply_pct,
    redeem_amt / nullif(lag(redeem_amt) OVER w, 0) - 1 AS redeem_pct,
    (apply_amt + redeem_amt) / nullif(lag(apply_amt + redeem_amt) OVER w, 0) - 1 AS vol_pct,
    (apply_amt - redeem_amt) / nullif(lag(apply_amt - redeem_amt) OVER w, 0) - 1 AS ret,
    (apply_amt - redeem_amt) / nullif(lag(apply_amt - redeem_amt, 10) OVER w, 0) - 1 AS mom10,
    coalesce((apply_amt - redeem_amt) - lag(apply_amt - redeem_amt) OVER w, 0) AS dnet,
    row_number() OVER (PARTITION BY fund_code ORDER BY apply_amt + redeem_amt) AS vrank
  FROM s0 WINDOW w AS (PARTITION BY fund_code ORDER BY transaction_date)),
s2 AS (
  SELECT *,
    100 - 100 / (1 + avg(CASE WHEN dnet > 0 THEN dnet ELSE 0 END) OVER w14
                   / (avg(CASE WHEN dnet < 0 THEN -dnet ELSE 0 END) OVER w14 + 1e-8)) AS rsi14,
    (net - avg(net) OVER w20) / (2 * stddev_samp(net) OVER w20 + 1e-8) AS bpos,
    (net - min(net) OVER w5) / (max(net) OVER w5 - min(net) OVER w5 + 1e-8) AS sr
  FROM s WINDOW w14 AS (PARTITION BY fund_code ORDER BY transaction_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
                w20 AS (PARTITION BY fund_code ORDER BY transaction_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                w5 AS (PARTITION BY fund_code ORDER BY transaction_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@query(
    "last60",
    with_flows(f"SELECT fund_code, transaction_date, apply_amt, redeem_amt FROM ({_last(60)})"),
)
def last60(spark, sf):
    """A0: the last 60 rows of every fund (top-k per group)."""
    return S.last_n(flows(spark, sf).select(K, D, "apply_amt", "redeem_amt"), 60)


@query(
    "fund_stats",
    with_flows(
        f"""SELECT l.fund_code, {_r('avg(apply_amt)')} AS avg_apply, {_r('avg(redeem_amt)')} AS avg_redeem,
  {_r('stddev_samp(apply_amt)')} AS std_apply, {_r('stddev_samp(redeem_amt)')} AS std_redeem,
  max(apply_amt) AS max_apply, max(redeem_amt) AS max_redeem, {_r('avg(apply_amt - redeem_amt)')} AS avg_net_flow,
  any_value(h.history_days) AS history_days
FROM ({_last(60)}) l JOIN (SELECT fund_code, count(*) AS history_days FROM flows GROUP BY fund_code) h USING (fund_code)
GROUP BY l.fund_code"""
    ),
)
def fund_stats(spark, sf):
    """A1: mean / std / max of both targets, mean net flow, history length."""
    return round_floats(S.fund_stats(flows(spark, sf)))


@query(
    "summary30",
    with_flows(
        "SELECT fund_code, "
        + ", ".join(
            f"min({t}) AS {s}_min, max({t}) AS {s}_max, {_r(f'avg({t})')} AS {s}_mean, {_r(f'stddev_samp({t})')} AS {s}_std"
            for t, s in (("apply_amt", "apply"), ("redeem_amt", "redeem"))
        )
        + f", {_r('avg(apply_amt - redeem_amt)')} AS net_flow_mean, {_r('avg(apply_amt / CASE WHEN redeem_amt > 0 THEN redeem_amt END)')} AS ratio_mean"
        + f" FROM ({_last(30)}) GROUP BY fund_code",
        "lineitem_week",
    ),
)
def summary30(spark, sf):
    """30-row summary (min, max, mean, std, net flow, apply/redeem ratio)."""
    return round_floats(S.summary_stats(flows(spark, sf, "lineitem_week"), 30))


@query(
    "behavior_stats",
    with_flows(
        f"""SELECT fund_code,
  {_r('coalesce(covar_samp(apply_amt, redeem_amt) / nullif(stddev_samp(apply_amt) * stddev_samp(redeem_amt), 0), 0)')} AS correlation,
  {_r('CASE WHEN count(*) > 1 THEN stddev_samp(net) ELSE 0 END')} AS net_flow_vol,
  {_r('CASE WHEN count(*) > 1 THEN avg(apply_pct) ELSE 0 END')} AS apply_trend,
  {_r('CASE WHEN count(*) > 1 THEN avg(redeem_pct) ELSE 0 END')} AS redeem_trend,
  {_r('(coalesce(sum(apply_amt) FILTER (WHERE isodow(transaction_date) IN (6, 7)), 0) + coalesce(sum(redeem_amt) FILTER (WHERE isodow(transaction_date) IN (6, 7)), 0)) / (sum(apply_amt) + sum(redeem_amt) + 1e-8)')} AS weekend_ratio,
  {_r('(coalesce(sum(apply_amt) FILTER (WHERE transaction_date = last_day(transaction_date)), 0) + coalesce(sum(redeem_amt) FILTER (WHERE transaction_date = last_day(transaction_date)), 0)) / (sum(apply_amt) + sum(redeem_amt) + 1e-8)')} AS month_end_ratio,
  {_r('CASE WHEN sum(vol) > 0 THEN 2.0 * sum(vrank * vol) / (count(*) * sum(vol)) - (count(*) + 1) / count(*) ELSE 0 END')} AS concentration
FROM s2 GROUP BY fund_code""",
        extra_ctes=SERIES_CTE,
    ),
)
def behavior_stats(spark, sf):
    """A2-A5: correlation, net-flow volatility, trends, weekend / month-end share, concentration."""
    return round_floats(S.behavior_stats(flows(spark, sf)))


@query(
    "gini",
    with_flows(
        f"""SELECT fund_code, {_r('CASE WHEN sum(v) > 0 THEN 2.0 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*) ELSE 0 END')} AS concentration
FROM (SELECT fund_code, apply_amt + redeem_amt AS v,
        row_number() OVER (PARTITION BY fund_code ORDER BY apply_amt + redeem_amt) AS i FROM flows)
GROUP BY fund_code"""
    ),
)
def gini(spark, sf):
    """A5: Gini concentration of daily volume over each fund's whole history."""
    df = flows(spark, sf).withColumn("volume", F.col("apply_amt") + F.col("redeem_amt"))
    return round_floats(S.gini(df, "volume"))


def _at_last(c: str) -> str:
    return f"max({c}) FILTER (WHERE idx = cnt)"


@query(
    "signal_stats",
    with_flows(
        f"""SELECT fund_code,
  {_r(f"coalesce({_at_last('rsi14')}, 50)")} AS rsi,
  {_r(f"CASE WHEN count(*) > 10 THEN coalesce({_at_last('mom10')}, 0) ELSE 0 END")} AS momentum,
  {_r(f"CASE WHEN {_at_last('bpos')} IS NOT NULL THEN least(greatest({_at_last('bpos')}, -1), 1) END")} AS bollinger_pos,
  {_r('CASE WHEN count(*) > 1 THEN coalesce(avg(vol_pct), 0) ELSE 0 END')} AS volume_trend,
  {_r('CASE WHEN count(*) > 5 THEN coalesce(abs(covar_samp(idx, net) / nullif(stddev_samp(idx) * stddev_samp(net), 0)), 0) ELSE 0 END')} AS trend_strength,
  {_r(f"least(greatest({_at_last('sr')}, 0), 1)")} AS support_resistance
FROM s2 GROUP BY fund_code""",
        extra_ctes=SERIES_CTE,
    ),
)
def signal_stats(spark, sf):
    """Last RSI-14, 10-row momentum, Bollinger position, volume trend, trend strength, support/resistance."""
    return round_floats(S.signal_stats(flows(spark, sf)))


RISK_CTE = (
    SERIES_CTE
    + """,
rr AS (SELECT fund_code, transaction_date, ret, product(1 + ret) OVER (PARTITION BY fund_code ORDER BY transaction_date
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s WHERE ret IS NOT NULL),
dd AS (SELECT fund_code, min((cum - rm) / nullif(rm, 0)) AS mdd FROM
         (SELECT *, max(cum) OVER (PARTITION BY fund_code ORDER BY transaction_date
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rm FROM rr)
       GROUP BY fund_code),
v AS (SELECT fund_code, quantile_cont(ret, 0.05) AS var95, count(ret) AS m FROM s GROUP BY fund_code)"""
)


def _risk_sql() -> str:
    z = "CASE WHEN any_value(v.m) < 5 THEN 0 ELSE {} END"
    return with_flows(
        f"""SELECT s.fund_code,
  {_r(z.format('any_value(v.var95)'))} AS var95,
  {_r(z.format('any_value(dd.mdd)'))} AS max_drawdown,
  {_r(z.format('avg(s.ret) / (stddev_samp(s.ret) + 1e-8) * sqrt(252)'))} AS sharpe,
  {_r(z.format('stddev_samp(s.ret) * sqrt(252)'))} AS volatility,
  {_r(z.format("CASE WHEN isnan(skewness(s.ret)) THEN 0 ELSE coalesce(skewness(s.ret), 0) END"))} AS skewness,
  {_r(z.format("CASE WHEN isnan(kurtosis(s.ret)) THEN 0 ELSE coalesce(kurtosis(s.ret), 0) END"))} AS kurtosis,
  {_r(z.format('coalesce(avg(s.ret) FILTER (WHERE s.ret <= v.var95), 0)'))} AS tail_risk
FROM s JOIN v USING (fund_code) LEFT JOIN dd USING (fund_code) GROUP BY s.fund_code""",
        extra_ctes=RISK_CTE,
    )


@query("risk_stats", _risk_sql())
def risk_stats(spark, sf):
    """VaR 95, max drawdown, Sharpe, volatility, skewness, kurtosis, tail risk."""
    return round_floats(S.risk_stats(flows(spark, sf)))


# ------------------------------------------------------------------------ L12
AS_OF = """flows AS (
  WITH n AS (SELECT *, row_number() OVER (PARTITION BY fund_code ORDER BY transaction_date) AS rn,
               strftime(transaction_date, '%Y-%m') AS ym FROM flows_raw),
       e AS (SELECT fund_code, ym, max(rn) AS last FROM n GROUP BY fund_code, ym)
  SELECT n.fund_code || ' ' || e.ym AS fund_code, transaction_date, apply_amt, redeem_amt
  FROM n JOIN e ON n.fund_code = e.fund_code AND e.last - n.rn BETWEEN 0 AND 59)"""


def as_of_months(sql: str) -> str:
    """A statement on flows, on the last 60 rows up to each month end instead, keyed by fund and month."""
    return sql.replace("flows AS (SELECT * FROM flows_raw)", AS_OF)


def _monthly(spark, sf, *columns):
    stats = AT.monthly_all_stats(flows(spark, sf))
    key = F.concat(F.col(K), F.lit(" "), F.date_format("month", "yyyy-MM")).alias(K)
    return round_floats(stats.select(key, *columns))


@query("monthly_behavior", as_of_months(ORACLE["behavior_stats"]))
def monthly_behavior(spark, sf):
    """A2-A5 as of every month end."""
    return _monthly(spark, sf, "correlation", "net_flow_vol", "apply_trend", "redeem_trend", "weekend_ratio", "month_end_ratio", "concentration")


@query("monthly_signal", as_of_months(ORACLE["signal_stats"]))
def monthly_signal(spark, sf):
    """A6-A11 as of every month end."""
    return _monthly(spark, sf, "rsi", "momentum", "bollinger_pos", "volume_trend", "trend_strength", "support_resistance")


@query("monthly_risk", as_of_months(ORACLE["risk_stats"]))
def monthly_risk(spark, sf):
    """A12-A17 as of every month end."""
    return _monthly(spark, sf, "var95", "max_drawdown", "sharpe", "volatility", "skewness", "kurtosis", "tail_risk")
