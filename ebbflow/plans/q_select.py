"""Queries for imputation (C5-C12) and feature validation / selection (V1-V8).

The input with gaps is derived from the flow table: a 7-row lag and a
previous-7-row mean (NULL at each fund's start) and day-on-day percent
changes (NULL after a zero day).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.functions.exprs import fund_window, pct_change
from ebbflow.operators import calendar as CAL
from ebbflow.operators import clean as C
from ebbflow.operators import interact as I
from ebbflow.operators import select as SEL
from ebbflow.operators import split as SP
from ebbflow.plans.catalog import R, flows, query, round_floats
from ebbflow.plans.oracle_sql import with_flows
from ebbflow.schema import D, K

GAPPY = ("apply_lag_7", "apply_roll_mean_7", "apply_pct_1", "redeem_pct_1")
PART = "PARTITION BY fund_code ORDER BY transaction_date"
GAPPY_CTE = f"""g AS (SELECT fund_code, transaction_date, apply_amt, redeem_amt, uv_key_page_1,
  lag(apply_amt, 7) OVER ({PART}) AS apply_lag_7,
  avg(apply_amt) OVER ({PART} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS apply_roll_mean_7,
  apply_amt / nullif(lag(apply_amt) OVER ({PART}), 0) - 1 AS apply_pct_1,
  redeem_amt / nullif(lag(redeem_amt) OVER ({PART}), 0) - 1 AS redeem_pct_1
FROM flows)"""
CUT_CTE = "c AS (SELECT max(transaction_date) - CAST(least(30, floor(count(*) * 0.05)) AS INTEGER) AS cut FROM flows)"


def _r(expr: str) -> str:
    return f"round({expr}, {R}) + 0.0"


def gappy(spark, sf):
    f = flows(spark, sf)
    w = fund_window()
    return f.select(
        K,
        D,
        "apply_amt",
        "redeem_amt",
        "uv_key_page_1",
        F.lag("apply_amt", 7).over(w).alias("apply_lag_7"),
        F.avg("apply_amt").over(w.rowsBetween(-7, -1)).alias("apply_roll_mean_7"),
        pct_change("apply_amt", F.lag("apply_amt", 1).over(w)).alias("apply_pct_1"),
        pct_change("redeem_amt", F.lag("redeem_amt", 1).over(w)).alias("redeem_pct_1"),
    )


def _ffill_sql() -> str:
    sel = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in GAPPY
    )
    return with_flows(f"SELECT fund_code, transaction_date, {sel} FROM g", extra_ctes=GAPPY_CTE)


@query("ffill_bfill", _ffill_sql())
def ffill_bfill(spark, sf):
    """Forward then backward fill within each fund."""
    return C.ffill_bfill(gappy(spark, sf).select(K, D, *GAPPY), list(GAPPY))


@query(
    "median_fill",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(f"{_r(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM g), 0)')} AS {c}" for c in GAPPY)
        + " FROM g",
        extra_ctes=GAPPY_CTE,
    ),
)
def median_fill(spark, sf):
    """Remaining NULLs take the exact global median of the column, then 0."""
    return round_floats(C.median_fill(gappy(spark, sf).select(K, D, *GAPPY), list(GAPPY)))


def _split(spark, sf):
    f = flows(spark, sf)
    return SP.holdout_split(f, overlap=False)


@query(
    "train_clip",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(f"{_r(f'least(greatest({c}, {c}_lo), {c}_hi)')} AS {c}" for c in ("apply_amt", "redeem_amt"))
        + " FROM flows, (SELECT "
        + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in ("apply_amt", "redeem_amt"))
        + " FROM flows WHERE transaction_date <= (SELECT cut FROM c)) b WHERE transaction_date > (SELECT cut FROM c)",
        extra_ctes=CUT_CTE,
    ),
)
def train_clip(spark, sf):
    """C8 with M1: 1 % / 99 % bounds fitted on the training rows, applied to the hold-out rows."""
    tr, va = _split(spark, sf)
    cols = ["apply_amt", "redeem_amt"]
    clipper = C.TrainClipper().fit(tr.select(*cols), cols)
    return round_floats(clipper.transform(va.select(K, D, *cols)))


PERIOD = "concat(CAST(year(transaction_date) AS VARCHAR), '-', CAST(quarter(transaction_date) AS VARCHAR))"


def _period(df):
    return df.withColumn("period", F.concat(F.year(D).cast("string"), F.lit("-"), F.quarter(D).cast("string")))


@query(
    "unseen_category",
    with_flows(
        f"""SELECT fund_code, transaction_date,
  CASE WHEN {PERIOD} IN (SELECT period FROM tr) THEN {PERIOD} ELSE (SELECT period FROM m) END AS period
FROM flows WHERE transaction_date >= DATE '1999-01-01'""",
        extra_ctes=f"""tr AS (SELECT {PERIOD} AS period FROM flows WHERE transaction_date < DATE '1999-07-01'),
m AS (SELECT period FROM tr GROUP BY period ORDER BY count(*) DESC, period LIMIT 1)""",
    ),
)
def unseen_category(spark, sf):
    """Hold-out categories never seen in training take the training mode (smallest on ties)."""
    f = _period(flows(spark, sf).select(K, D))
    tr = f.where(F.col(D) < F.lit("1999-07-01").cast("date"))
    va = f.where(F.col(D) >= F.lit("1999-01-01").cast("date"))
    return C.unseen_to_mode(tr.select("period"), va, ["period"]).select(K, D, "period")


@query(
    "train_impute",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"{_r(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM g WHERE transaction_date <= (SELECT cut FROM c)), 0)')} AS {c}"
            for c in GAPPY
        )
        + ", coalesce(period, (SELECT period FROM g2 WHERE transaction_date <= (SELECT cut FROM c) AND period IS NOT NULL "
        "GROUP BY period ORDER BY count(*) DESC, period LIMIT 1), 'unknown') AS period"
        + " FROM g2 WHERE transaction_date > (SELECT cut FROM c)",
        extra_ctes=GAPPY_CTE
        + f",\n{CUT_CTE},\ng2 AS (SELECT *, CASE WHEN redeem_amt > 0 THEN {PERIOD} END AS period FROM g)",
    ),
)
def train_impute(spark, sf):
    """C10 + C11: hold-out NULLs take the training median (numbers) or mode (text)."""
    g = gappy(spark, sf).withColumn(
        "period", F.when(F.col("redeem_amt") > F.lit(0), F.concat(F.year(D).cast("string"), F.lit("-"), F.quarter(D).cast("string")))
    )
    tr, va = SP.holdout_split(g, overlap=False)
    cols = list(GAPPY)
    out = C.mode_fill(tr, C.train_median_fill(tr, va, cols), ["period"])
    return round_floats(out.select(K, D, *cols, "period"))


@query(
    "prepare_target",
    with_flows(
        "SELECT fund_code, transaction_date, greatest(apply_amt, 0.1) AS apply_amt, "
        + ", ".join(GAPPY)
        + " FROM g WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in GAPPY),
        extra_ctes=GAPPY_CTE,
    ),
)
def prepare_target(spark, sf):
    """Target floored at 0.1, rows with any NULL dropped."""
    g = gappy(spark, sf).select(K, D, "apply_amt", *GAPPY)
    return C.floor_target_drop_nulls(g, "apply_amt")


# ------------------------------------------------------------------ selection
CAL_EVENT_COLS = ("month", "day_of_week", "day_of_month", "quarter", "is_quarter_end", "is_year_start", "is_weekend")


@query(
    "constant_cols",
    with_flows(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", coalesce(min({c}) = max({c}), true) AS is_constant FROM cal" for c in CAL_EVENT_COLS
        ),
        "events",
        extra_ctes="cal AS (SELECT month(transaction_date) AS month, isodow(transaction_date) - 1 AS day_of_week, "
        "day(transaction_date) AS day_of_month, quarter(transaction_date) AS quarter, "
        "CASE WHEN transaction_date = last_day(transaction_date) AND month(transaction_date) IN (3,6,9,12) THEN 1 ELSE 0 END AS is_quarter_end, "
        "CASE WHEN day(transaction_date) = 1 AND month(transaction_date) = 1 THEN 1 ELSE 0 END AS is_year_start, "
        "CASE WHEN isodow(transaction_date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend FROM flows)",
    ),
)
def constant_cols(spark, sf):
    """V1: columns with at most one distinct value (calendar parts of the one-month events adapter)."""
    f = flows(spark, sf, "events").select(K, D, *CAL.date_part_columns(), *CAL.date_flag_columns())
    return SEL.constant_report(f.select(*CAL_EVENT_COLS), list(CAL_EVENT_COLS))


CORR_COLS = ("apply_amt", "redeem_amt", "uv_key_page_1") + GAPPY


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS col_i, '{b}' AS col_j, CAST(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS DOUBLE) AS n, "
                f"{_r(f'corr({a}, {b})')} AS corr FROM g"
            )
    return with_flows(" UNION ALL ".join(parts), extra_ctes=GAPPY_CTE)


@query("corr_filter", _corr_sql())
def corr_filter(spark, sf):
    """V2: pairwise-complete Pearson correlation of every column pair (partial moments, no collect)."""
    pc = SEL.pairwise_correlations(gappy(spark, sf), list(CORR_COLS))
    return pc.select("col_i", "col_j", "n", F.round("corr", R).alias("corr"))


@query(
    "missing_cols",
    with_flows(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS missing_ratio FROM g" for c in GAPPY
        ),
        extra_ctes=GAPPY_CTE,
    ),
)
def missing_cols(spark, sf):
    """V3: share of NULLs per column (dropped above 0.8)."""
    return SEL.missing_report(gappy(spark, sf), list(GAPPY))


VAR_COLS = ("sin_month", "cos_day_of_week", "is_weekend", "net_flow_ratio", "uv_page_1_ratio")
VAR_CTE = (
    "v AS (SELECT sin(2 * pi() * month(transaction_date) / 12.0) AS sin_month, "
    "cos(2 * pi() * (isodow(transaction_date) - 1) / 7.0) AS cos_day_of_week, "
    "CASE WHEN isodow(transaction_date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend, "
    "(apply_amt - redeem_amt) / (apply_amt + redeem_amt + 1e-8) AS net_flow_ratio, "
    "uv_key_page_1 / (CAST(coalesce(uv_key_page_1, 0) + coalesce(uv_key_page_2, 0) + coalesce(uv_key_page_3, 0) AS DOUBLE) + 1e-8) AS uv_page_1_ratio "
    "FROM flows)"
)


def _var_frame(spark, sf):
    f = flows(spark, sf)
    cols = CAL.cyclic_columns() + CAL.date_flag_columns() + I.flow_columns() + I.uv_columns(f.columns)
    return f.select(*cols).select(*VAR_COLS)


@query(
    "variance_cols",
    with_flows(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {_r(f'var_samp({c})')} AS variance, var_samp({c}) < 1e-8 AS low_variance FROM v"
            for c in VAR_COLS
        ),
        extra_ctes=VAR_CTE,
    ),
)
def variance_cols(spark, sf):
    """V4: sample variance per column and the < 1e-8 flag."""
    rep = SEL.variance_report(_var_frame(spark, sf), list(VAR_COLS))
    return rep.select("column", F.round("variance", R).alias("variance"), (F.col("variance") < F.lit(1e-8)).alias("low_variance"))


TOPK_COLS = GAPPY + ("uv_key_page_1",)


def _topk_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", var_samp({c}) * (1 + greatest(coalesce(abs(corr({c}, apply_amt)), 0), "
        f"coalesce(abs(corr({c}, redeem_amt)), 0))) AS score FROM g"
        for c in TOPK_COLS
    ]
    return with_flows(
        'SELECT "column", CAST(row_number() OVER (ORDER BY score DESC, "column") AS INTEGER) AS rank FROM ('
        + " UNION ALL ".join(parts)
        + ") WHERE score IS NOT NULL QUALIFY rank <= 3",
        extra_ctes=GAPPY_CTE,
    )


@query("top_k_features", _topk_sql())
def top_k_features(spark, sf):
    """V6: the k = 3 best features by variance x (1 + max |corr with a target|)."""
    from pyspark.sql import Window

    sc = SEL.feature_scores(gappy(spark, sf), list(TOPK_COLS))
    w = Window.orderBy(F.desc("score"), "column")  # ranks a handful of feature names
    return sc.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("column", "rank")


def _stage_sql() -> str:
    cols = ["apply_redeem_ratio", "net_flow", "net_flow_ratio", "total_volume", "total_uv", "apply_per_uv"]
    exprs = {
        "apply_redeem_ratio": "apply_amt / (redeem_amt + 1e-8)",
        "net_flow": "apply_amt - redeem_amt",
        "net_flow_ratio": "(apply_amt - redeem_amt) / (apply_amt + redeem_amt + 1e-8)",
        "total_volume": "apply_amt + redeem_amt",
        "total_uv": "CAST(coalesce(uv_key_page_1, 0) + coalesce(uv_key_page_2, 0) + coalesce(uv_key_page_3, 0) AS DOUBLE)",
        "apply_per_uv": "apply_amt / (CAST(coalesce(uv_key_page_1, 0) + coalesce(uv_key_page_2, 0) + coalesce(uv_key_page_3, 0) AS DOUBLE) + 1e-8)",
    }
    parts = [
        f"SELECT '{c}' AS \"column\", avg(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS null_ratio, "
        f"CAST(count(*) FILTER (WHERE isinf(x)) AS BIGINT) AS inf_count, coalesce(min(x) = max(x), true) AS is_constant, "
        f"avg(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.5 AS flagged FROM (SELECT {exprs[c]} AS x FROM flows)"
        for c in cols
    ]
    return with_flows(" UNION ALL ".join(parts))


@query("stage_report", _stage_sql())
def stage_report(spark, sf):
    """V7: quality report of the columns an interaction stage adds."""
    f = flows(spark, sf)
    stage = f.select("*", *I.flow_columns(), *I.uv_columns(f.columns))
    keep = ["apply_redeem_ratio", "net_flow", "net_flow_ratio", "total_volume", "total_uv", "apply_per_uv"]
    return SEL.stage_report(f.columns, stage.select(*f.columns, *keep))


@query(
    "std_scale",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"{_r(f'({c} - {c}_m) / CASE WHEN {c}_s > 0 THEN {c}_s ELSE 1 END')} AS {c}"
            for c in ("apply_amt", "redeem_amt", "uv_key_page_1")
        )
        + " FROM flows, (SELECT "
        + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in ("apply_amt", "redeem_amt", "uv_key_page_1"))
        + " FROM flows WHERE transaction_date <= (SELECT cut FROM c)) s WHERE transaction_date > (SELECT cut FROM c)",
        extra_ctes=CUT_CTE,
    ),
)
def std_scale(spark, sf):
    """V8: standard scaling fitted on training rows (population std), applied to hold-out rows."""
    tr, va = _split(spark, sf)
    cols = ["apply_amt", "redeem_amt", "uv_key_page_1"]
    sc = SEL.TrainScaler().fit(tr, cols)
    return round_floats(sc.transform(va.select(K, D, *cols)))
