"""Queries for the leakage checks (K1, K3, K5) and the composed pipeline."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from ebbflow.operators import attributes as AT
from ebbflow.operators import clean as C
from ebbflow.operators import leakage as LK
from ebbflow.operators import normal_eq as NE
from ebbflow.operators import recursion as RE
from ebbflow.operators import select as SEL
from ebbflow.operators import windows as W
from ebbflow.plans import pipeline as PL
from ebbflow.plans.catalog import R, flows, query, round_floats, written_flows
from ebbflow.plans.oracle_sql import with_flows
from ebbflow.plans.q_select import GAPPY, GAPPY_CTE, gappy
from ebbflow.schema import D, K, FlowConfig
from ebbflow.session import cut_lineage
from ebbflow.sources import adapters as A


def _r(expr: str) -> str:
    return f"round({expr}, {R}) + 0.0"


K1_COLS = ("day_of_week", "is_weekend", "sin_day_of_year", "net_flow_ratio", "redeem_share")
K1_CTE = """fv AS (SELECT transaction_date, CAST(isodow(transaction_date) - 1 AS DOUBLE) AS day_of_week,
  CAST(CASE WHEN isodow(transaction_date) IN (6, 7) THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend,
  sin(2 * pi() * dayofyear(transaction_date) / 365.0) AS sin_day_of_year,
  (apply_amt - redeem_amt) / (apply_amt + redeem_amt + 1e-8) AS net_flow_ratio,
  redeem_amt / nullif(apply_amt + redeem_amt, 0) AS redeem_share
FROM flows WHERE transaction_date >= (SELECT max(transaction_date) - 6 FROM flows))"""


@query(
    "future_variance",
    with_flows(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {_r('max(v)')} AS max_daily_variance, coalesce(max(v) <= 1e-12, false) AS suspicious "
            f"FROM (SELECT var_samp({c}) AS v FROM fv GROUP BY transaction_date)"
            for c in K1_COLS
        ),
        extra_ctes=K1_CTE,
    ),
)
def future_variance(spark, sf):
    """K1: features with zero cross-fund variance on every day of the last week are flagged."""
    f = flows(spark, sf)
    start = f.agg(F.max(D)).first()[0] - dt.timedelta(days=6)
    x = f.select(
        K,
        D,
        F.weekday(D).cast("double").alias("day_of_week"),
        F.when(F.weekday(D).isin(5, 6), 1.0).otherwise(0.0).alias("is_weekend"),
        F.sin(F.lit(2 * 3.141592653589793) * F.dayofyear(D) / F.lit(365.0)).alias("sin_day_of_year"),
        F.try_divide(F.col("apply_amt") - F.col("redeem_amt"), F.col("apply_amt") + F.col("redeem_amt") + F.lit(1e-8)).alias("net_flow_ratio"),
        F.try_divide(F.col("redeem_amt"), F.col("apply_amt") + F.col("redeem_amt")).alias("redeem_share"),
    )
    rep = LK.future_variance(x, start, list(K1_COLS))
    return rep.select("column", F.round("max_daily_variance", R).alias("max_daily_variance"), "suspicious")


@query("truncation_test", None)
def truncation_test(spark, sf):
    """K3: look-ahead and same-day use of every feature of the table, and of a centred mean (which must be caught)."""
    f = written_flows(spark, sf)
    holidays = A.holidays_for(f)
    cut = f.agg(F.max(D)).first()[0] - dt.timedelta(days=30)

    def build(df):
        table = PL.create_features(df, holidays, fill=False)
        centred = df.select(K, D, *W.rolling_inclusive_columns(("apply_amt",), (7,), centred=True))
        return table.join(centred, [K, D])

    return LK.truncation_test(f, build, cut, targets=("apply_amt", "redeem_amt"))


@query("permutation_importance", None)
def permutation_importance(spark, sf):
    """K5: every feature known the day before, by how much a fitted model loses when its values are exchanged."""
    f = cut_lineage(C.clean_flows(written_flows(spark, sf)).select(K, D, "apply_amt"))
    table = cut_lineage(RE.add_model_features(f, ["apply_amt"]))
    names = RE.feature_names(["apply_amt"])
    model = NE.fit_parts(table, names, "apply_amt", F.lit(0), F.array(F.lit(0).cast("long"))).first()
    coef, intercept = np.array(model["coef"]), model["intercept"]

    def score(x):
        return intercept + np.nan_to_num(x) @ coef

    out = LK.permutation_importance(table, names, "apply_amt", score)
    return out.select("feature", *[F.round(c, R).alias(c) for c in ("base_wmape", "permuted_wmape", "importance")])


K5_CTE = GAPPY_CTE + """,
k AS (SELECT *, (apply_amt - redeem_amt) / (apply_amt + redeem_amt + 1e-8) AS net_flow_ratio,
  apply_amt + redeem_amt AS total_volume, apply_amt - redeem_amt AS net_flow FROM g)"""
K5_COLS = GAPPY + ("uv_key_page_1", "net_flow_ratio", "total_volume", "net_flow", "redeem_amt")


@query(
    "suspicious_corr",
    with_flows(
        'SELECT "column", abs_corr, abs_corr > 0.99 AS suspicious FROM ('
        + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_r(f'abs(corr({c}, apply_amt))')} AS abs_corr FROM k" for c in K5_COLS)
        + ') WHERE abs_corr IS NOT NULL ORDER BY abs_corr DESC, "column" LIMIT 5',
        extra_ctes=K5_CTE,
    ),
)
def suspicious_corr(spark, sf):
    """K5: the 5 features most correlated with the target; > 0.99 is flagged."""
    g = gappy(spark, sf)
    a, r = F.col("apply_amt"), F.col("redeem_amt")
    k = g.select(
        "*",
        F.try_divide(a - r, a + r + F.lit(1e-8)).alias("net_flow_ratio"),
        (a + r).alias("total_volume"),
        (a - r).alias("net_flow"),
    ).select(K, D, "apply_amt", *K5_COLS)
    out = LK.suspicious_correlation(k, "apply_amt", top=5, cols=list(K5_COLS))
    return out.select("column", F.round("abs_corr", R).alias("abs_corr"), (F.round("abs_corr", R) > F.lit(0.99)).alias("suspicious"))


# ------------------------------------------------------------------ pipeline
@query("flagship_features", None)
def flagship_features(spark, sf):
    """E1's table: cleaned flows, every feature stage, attributes, selection and fills."""
    f = written_flows(spark, sf)
    return PL.training_table(f, A.holidays_for(f), AT.default_attributes(f))


@query("select_report", None)
def select_report(spark, sf):
    """V1-V5 over every feature: the columns that selection drops, and why."""
    f = written_flows(spark, sf)
    feats = PL.training_table(f, A.holidays_for(f), AT.default_attributes(f), select=False, fill=False)
    _, report = SEL.validate_and_select(cut_lineage(feats))
    return spark.createDataFrame([(r["column"], r["reason"]) for r in report], "column string, reason string")


@query("train_predict", None)
def train_predict(spark, sf):
    """E1 and E2 end to end: table, hold-out split, preparation, a linear model per target, 7-day blended forecast.

    ``PL.train(kind="gbt")`` fits the boosted model on the same table; it takes longer.
    """
    f = written_flows(spark, sf)
    feats = PL.training_table(f, A.holidays_for(f), AT.default_attributes(f))
    models, _ = PL.train(feats, FlowConfig(), kind="linear")
    start = f.agg(F.max(D)).first()[0] + dt.timedelta(days=1)
    return PL.submission(PL.predict(feats, models, start))
