"""Queries for splits, scoring and the score-gap check.

Predictions to score come from the data: the mean of the 7 rows before each
fund's last week (a per-fund forecast of that week), and a rolling
previous-7-row mean for every row.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbflow.operators import leakage as LK
from ebbflow.operators import metrics as MT
from ebbflow.operators import split as SP
from ebbflow.plans.catalog import R, flows, query, round_floats
from ebbflow.plans.oracle_sql import with_flows
from ebbflow.schema import D, K

T2 = ("apply_amt", "redeem_amt")


def _r(expr: str) -> str:
    return f"round({expr}, {R}) + 0.0"


WEEK_CTES = """r AS (SELECT fund_code, transaction_date, apply_amt, redeem_amt,
    row_number() OVER (PARTITION BY fund_code ORDER BY transaction_date DESC) AS rn FROM flows),
b AS (SELECT fund_code, avg(apply_amt) AS apply_amt_pred, avg(redeem_amt) AS redeem_amt_pred FROM r WHERE rn BETWEEN 8 AND 14 GROUP BY fund_code),
s AS (SELECT r.fund_code, r.transaction_date, apply_amt, redeem_amt, apply_amt_pred, redeem_amt_pred
      FROM r JOIN b USING (fund_code) WHERE rn <= 7)"""
ROLL_CTE = """s AS (SELECT * FROM (SELECT fund_code, transaction_date, apply_amt, redeem_amt,
    avg(apply_amt) OVER w AS apply_amt_pred, avg(redeem_amt) OVER w AS redeem_amt_pred
  FROM flows WINDOW w AS (PARTITION BY fund_code ORDER BY transaction_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
  WHERE apply_amt_pred IS NOT NULL)"""


def last_week(spark, sf):
    """(actual, predicted): last 7 rows per fund and the mean of the 7 rows before them."""
    f = flows(spark, sf).select(K, D, *T2)
    w = Window.partitionBy(K).orderBy(F.col(D).desc())
    r = f.withColumn("__rn", F.row_number().over(w))
    base = r.where("__rn BETWEEN 8 AND 14").groupBy(K).agg(*[F.avg(t).alias(f"{t}_pred") for t in T2])
    actual = r.where("__rn <= 7").drop("__rn")
    pred = actual.select(K, D).join(base, K)
    return actual, pred


def rolling_pred(spark, sf):
    f = flows(spark, sf).select(K, D, *T2)
    w = Window.partitionBy(K).orderBy(D).rowsBetween(-7, -1)
    out = f.select("*", *[F.avg(t).over(w).alias(f"{t}_pred") for t in T2])
    return out.where(F.col("apply_amt_pred").isNotNull())


def _fund_wmape_sql(y: str) -> str:
    p = f"{y}_pred"
    return (
        f"CASE WHEN sum({y}) = 0 THEN 0 ELSE coalesce(sum(abs({p} - {y})) FILTER (WHERE {y} <> 0) / sum({y}), 0) END"
    )


@query(
    "wmape_fund",
    with_flows(
        f"SELECT fund_code, {_r(_fund_wmape_sql('apply_amt'))} AS apply_wmape, {_r(_fund_wmape_sql('redeem_amt'))} AS redeem_wmape "
        "FROM s GROUP BY fund_code",
        extra_ctes=WEEK_CTES,
    ),
)
def wmape_fund(spark, sf):
    """M7: per-fund volume-weighted error of the last week."""
    actual, pred = last_week(spark, sf)
    j = MT.align_by_date(actual, pred)
    a = MT.wmape_per_fund(j, "apply_amt", "apply_amt_pred").select(K, F.col("wmape").alias("apply_wmape"))
    r = MT.wmape_per_fund(j, "redeem_amt", "redeem_amt_pred").select(K, F.col("wmape").alias("redeem_wmape"))
    return round_floats(a.join(r, K))


def _global_sql(y: str) -> str:
    return f"CASE WHEN sum(abs({y})) = 0 THEN 0 ELSE sum(abs({y}_pred - {y})) / sum(abs({y})) END"


@query(
    "wmape_global",
    with_flows(
        f"SELECT {_r(_global_sql('apply_amt'))} AS apply_wmape, {_r(_global_sql('redeem_amt'))} AS redeem_wmape FROM s",
        extra_ctes=ROLL_CTE,
    ),
)
def wmape_global(spark, sf):
    """M8: global WMAPE of the rolling 7-row mean forecast."""
    s = rolling_pred(spark, sf)
    return round_floats(s.agg(*[MT.wmape_global_expr(t, f"{t}_pred").alias(f"{t.split('_')[0]}_wmape") for t in T2]))


def _comp_sql() -> str:
    parts = []
    for y in T2:
        parts.append(
            f"(SELECT coalesce(sum(w * CASE WHEN g > 0 THEN tot / g ELSE 0 END), 0) FROM "
            f"(SELECT {_fund_wmape_sql(y)} AS w, sum({y}) AS tot FROM s GROUP BY fund_code), (SELECT sum({y}) AS g FROM s))"
        )
    a, r = parts
    return with_flows(
        f"SELECT {_r(a)} AS apply_amt_wmape, {_r(r)} AS redeem_amt_wmape, {_r(f'({a} + {r}) / 2')} AS final_wmape",
        extra_ctes=WEEK_CTES,
    )


@query("wmape_competition", _comp_sql())
def wmape_competition(spark, sf):
    """M9 + J5: fund WMAPEs weighted by fund share, 0.5 apply + 0.5 redeem; rows matched by position."""
    actual, pred = last_week(spark, sf)
    j = MT.align_by_position(actual, pred)
    return round_floats(MT.competition_score(j))


@query(
    "mae_rmse",
    with_flows(
        " UNION ALL ".join(
            f"SELECT '{y}' AS target, {_r(f'avg(abs({y}_pred - {y}))')} AS mae, "
            f"{_r(f'sqrt(avg(({y}_pred - {y}) * ({y}_pred - {y})))')} AS rmse, {_r(_global_sql(y))} AS wmape FROM s"
            for y in T2
        ),
        extra_ctes=ROLL_CTE,
    ),
)
def mae_rmse(spark, sf):
    """MAE, RMSE and WMAPE per target."""
    s = rolling_pred(spark, sf)
    parts = [MT.error_metrics(s, y, f"{y}_pred").select(F.lit(y).alias("target"), "*") for y in T2]
    return round_floats(parts[0].unionByName(parts[1]))


def _dir_sql() -> str:
    parts = []
    for y in T2:
        parts.append(
            f"""SELECT '{y}' AS target, {_r('coalesce(avg(acc), 0)')} AS direction_accuracy FROM (
  SELECT fund_code, avg(CASE WHEN sa = sp THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM (
    SELECT fund_code, sign({y} - lag({y}) OVER w) AS sa, sign({y}_pred - lag({y}_pred) OVER w) AS sp
    FROM s WINDOW w AS (PARTITION BY fund_code ORDER BY transaction_date))
  WHERE sa IS NOT NULL AND sp IS NOT NULL GROUP BY fund_code)"""
        )
    return with_flows(" UNION ALL ".join(parts), extra_ctes=ROLL_CTE)


@query("direction_accuracy", _dir_sql())
def direction_accuracy(spark, sf):
    """Share of days the forecast moves in the actual direction, averaged over funds."""
    s = rolling_pred(spark, sf)
    parts = [MT.direction_accuracy(s, y, f"{y}_pred").select(F.lit(y).alias("target"), "*") for y in T2]
    return round_floats(parts[0].unionByName(parts[1]))


CUT = "(SELECT max(transaction_date) - CAST(least(30, floor(count(*) * 0.05)) AS INTEGER) FROM flows)"


@query(
    "holdout_split",
    with_flows(f"SELECT fund_code, transaction_date, CASE WHEN transaction_date > {CUT} THEN 1 ELSE 0 END AS is_valid FROM flows"),
)
def holdout_split(spark, sf):
    """M1: hold-out rows after max date - min(30, 5 % of rows) days."""
    return SP.holdout_flags(flows(spark, sf).select(K, D))


@query(
    "three_way_split",
    with_flows(
        "SELECT fund_code, transaction_date, CASE WHEN transaction_date <= DATE '1998-01-01' THEN 'train' "
        "WHEN transaction_date <= DATE '1999-01-01' THEN 'valid' ELSE 'test' END AS split FROM flows"
    ),
)
def three_way_split(spark, sf):
    """M2: train / valid / test by two cut-off dates."""
    return SP.three_way_split(flows(spark, sf).select(K, D), "1998-01-01", "1999-01-01")


def _wf_sql() -> str:
    return with_flows(
        """SELECT fund_code, transaction_date, CAST(fold AS INTEGER) AS fold, 'train' AS role
FROM d JOIN folds ON day >= fold * 7 AND day < fold * 7 + 90
UNION ALL
SELECT fund_code, transaction_date, CAST(fold AS INTEGER) AS fold, 'test' AS role
FROM d JOIN folds ON day >= fold * 7 + 90 AND day < fold * 7 + 97""",
        "lineitem_week",
        extra_ctes="""d AS (SELECT *, datediff('day', (SELECT min(transaction_date) FROM flows), transaction_date) AS day FROM flows),
folds AS (SELECT unnest(range(0, CAST(floor((datediff('day', min(transaction_date), max(transaction_date)) - 90) / 7) AS BIGINT) + 1)) AS fold FROM flows)""",
    )


@query("walk_forward_folds", _wf_sql())
def walk_forward_folds(spark, sf):
    """M3: walk-forward fold membership (90-day train window, 7-day step) on the weekly adapter."""
    return SP.walk_forward_folds(flows(spark, sf, "lineitem_week").select(K, D), 90, 7)


@query(
    "score_gap",
    with_flows(
        f"""SELECT {_r('tr')} AS train_wmape, {_r('va')} AS valid_wmape, {_r('va / nullif(tr, 0)')} AS ratio,
  coalesce(va / nullif(tr, 0) >= 2, false) AS suspicious
FROM (SELECT {_global_sql('apply_amt').replace('apply_amt', 'apply_amt')} AS tr FROM s WHERE transaction_date <= {CUT}),
     (SELECT {_global_sql('apply_amt')} AS va FROM s WHERE transaction_date > {CUT})""",
        extra_ctes=ROLL_CTE,
    ),
)
def score_gap(spark, sf):
    """K4: train versus hold-out WMAPE of the rolling forecast; a 2x gap is suspicious."""
    s = rolling_pred(spark, sf)
    f = flows(spark, sf).select(K, D)
    cut = f.agg(F.date_sub(F.max(D), SP.holdout_days(F.count(F.lit(1)))).alias("__cut"))
    j = s.crossJoin(F.broadcast(cut))
    tr = j.where(F.col(D) <= F.col("__cut"))
    va = j.where(F.col(D) > F.col("__cut"))
    out = LK.score_gap(tr, va, "apply_amt", "apply_amt_pred")
    return out.select(*[F.round(c, R).alias(c) for c in ("train_wmape", "valid_wmape", "ratio")], "suspicious")
