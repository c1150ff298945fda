"""Queries for operators that others only use in passing: fills, projections, sinks, appends, scores."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbflow.operators import attributes as AT
from ebbflow.operators import clean as C
from ebbflow.operators import forecast as FC
from ebbflow.operators import leakage as LK
from ebbflow.operators import metrics as ME
from ebbflow.plans.catalog import R, flows, query
from ebbflow.plans.oracle_sql import with_flows
from ebbflow.plans.q_attr import _code_sql
from ebbflow.schema import D, K
from ebbflow.session import checkpoint_dir
from ebbflow.sources import io as IO

T2 = ("apply_amt", "redeem_amt")


def _r(expr: str) -> str:
    return f"round({expr}, {R}) + 0.0"


def shared_path(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "nonfinite_to_null",
    with_flows(
        f"SELECT fund_code, transaction_date, {_r('CASE WHEN redeem_amt > 0 THEN apply_amt / redeem_amt END')} AS ratio, "
        "redeem_amt + 0.0 AS kept FROM flows"
    ),
)
def nonfinite_to_null(spark, sf):
    """NaN and infinities of float columns become NULL."""
    r = F.col("redeem_amt")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    odd = F.when(r > 0, F.col("apply_amt") / r).when(F.dayofmonth(D) % 2 == 0, nan).otherwise(F.when(F.col("apply_amt") > 0, inf).otherwise(-inf))
    out = C.nulls_for_nonfinite(flows(spark, sf).select(K, D, odd.alias("ratio"), r.alias("kept")))
    return out.select(K, D, F.round("ratio", R).alias("ratio"), "kept")


@query(
    "drop_all_null_rows",
    with_flows(
        "SELECT count(*) AS n, count(a) AS n_a, sum(a) AS a, sum(r) AS r FROM (SELECT CASE WHEN apply_amt > 100000 THEN apply_amt END AS a, "
        "nullif(redeem_amt, 0) AS r FROM flows) WHERE a IS NOT NULL OR r IS NOT NULL"
    ),
)
def drop_all_null_rows(spark, sf):
    """Rows without any value go."""
    large, r = F.when(F.col("apply_amt") > 100_000, F.col("apply_amt")), F.when(F.col("redeem_amt") != 0, F.col("redeem_amt"))
    left = C.drop_all_null_rows(flows(spark, sf).select(large.alias("a"), r.alias("r")))
    return left.agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("n_a"), F.sum("a").alias("a"), F.sum("r").alias("r"))


@query(
    "model_inputs",
    with_flows("SELECT uv_key_page_1, uv_key_page_2, uv_key_page_3 FROM flows"),
)
def model_inputs(spark, sf):
    """C14: every column but key, date and targets."""
    f = flows(spark, sf)
    return f.select(*C.feature_columns(f))


@query(
    "enriched_round_trip",
    with_flows(f"SELECT fund_code, transaction_date, apply_amt, redeem_amt, {_code_sql()['fund_category']} AS fund_category FROM flows"),
)
def enriched_round_trip(spark, sf):
    """The enriched table written as CSV (dates as text) and as Parquet by fund, and read back."""
    f = flows(spark, sf).select(K, D, *T2)
    category = AT.code_inference_columns(F.col(K))["fund_category"]
    csv, table = shared_path(spark, "enriched"), shared_path(spark, "training")
    IO.write_enriched(f.select("*", category.alias("fund_category")), csv)
    back = IO.load_flows(spark, csv, "csv")
    if not IO.has_semantic_columns(back):
        raise ValueError("the enriched table lost its attributes")
    IO.write_table(back, table, partition_by=["fund_category"])
    return IO.load_flows(spark, table).select(K, D, *T2, "fund_category")


LAST = "(SELECT max(transaction_date) FROM flows)"


@query(
    "append_forecast",
    with_flows(
        f"SELECT fund_code, CAST(transaction_date + 1 AS DATE) AS transaction_date, apply_amt, redeem_amt FROM flows "
        f"WHERE transaction_date = {LAST}"
    ),
)
def append_forecast(spark, sf):
    """forecast rows appended to the history and taken out again by their date."""
    f = flows(spark, sf).select(K, D, *T2)
    last = f.agg(F.max(D)).first()[0]
    day = f.where(F.col(D) == F.lit(last)).withColumn(D, F.date_add(D, 1).cast("date")).withColumn("day_idx", F.lit(0))
    return FC.forecast_part(FC.append_forecast(f, day), last + dt.timedelta(days=1))


@query(
    "submission_by_date",
    with_flows(
        "SELECT fund_code, strftime(transaction_date, '%Y%m%d') AS date, apply_amt AS apply_amt_pred, redeem_amt AS redeem_amt_pred FROM flows"
    ),
)
def submission_by_date(spark, sf):
    """The submission whose date column is named ``date``, written and read back."""
    fc = flows(spark, sf).select(K, D, *[F.col(t).alias(f"{t}_pred") for t in T2])
    path = shared_path(spark, "submission")
    IO.write_submission(fc, path, "date")
    back = spark.read.option("header", True).csv(path)
    return back.select(K, "date", *[F.col(f"{t}_pred").cast("double").alias(f"{t}_pred") for t in T2])


@query(
    "stats_as_of",
    with_flows(
        f"SELECT fund_code, count(*) AS n, max(transaction_date) AS last_date, {_r('avg(apply_amt)')} AS avg_apply FROM flows "
        f"WHERE transaction_date <= {LAST} - 100 GROUP BY fund_code"
    ),
)
def stats_as_of(spark, sf):
    """Statistics from the rows up to a cut-off date."""
    f = flows(spark, sf)
    cut = f.agg(F.max(D)).first()[0] - dt.timedelta(days=100)
    return AT.stats_as_of(f, cut).groupBy(K).agg(
        F.count(F.lit(1)).alias("n"), F.max(D).alias("last_date"), F.round(F.avg("apply_amt"), R).alias("avg_apply")
    )


@query(
    "short_descriptions",
    with_flows(
        "SELECT fund_code, CASE WHEN n % 2 = 0 THEN '混合型基金，多元化投资策略' ELSE 'a longer description of ' || fund_code END AS text "
        "FROM (SELECT fund_code, count(*) AS n FROM flows GROUP BY fund_code)"
    ),
)
def short_descriptions(spark, sf):
    """A text under ten characters, or none, becomes the default description."""
    n = flows(spark, sf).groupBy(K).agg(F.count(F.lit(1)).alias("n"))
    given = F.when(F.col("n") % 4 == 0, F.lit("short")).when(F.col("n") % 2 == 1, F.concat(F.lit("a longer description of "), F.col(K)))
    return n.select(K, AT.description_text(given).alias("text"))


@query(
    "fund_scores",
    with_flows(
        "SELECT fund_code, round(1 - sum(abs(p - y)) / sum(abs(y)), 4) + 0.0 AS score FROM (SELECT fund_code, apply_amt AS y, "
        "coalesce(lag(apply_amt) OVER (PARTITION BY fund_code ORDER BY transaction_date), apply_amt) AS p FROM flows) "
        "GROUP BY fund_code"
    ),
)
def fund_scores(spark, sf):
    """1 - WMAPE per fund, larger is better, of yesterday's value as forecast."""
    w = Window.partitionBy(K).orderBy(D)
    x = flows(spark, sf).select(K, F.col("apply_amt").alias("y"), F.coalesce(F.lag("apply_amt").over(w), "apply_amt").alias("p"))
    return ME.error_metrics(x, "y", "p", by=(K,)).select(K, F.round(ME.score_from_wmape(), R).alias("score"))


AVAILABLE = ("apply_amt_daily_rank", "apply_amt_vs_market_mean", "apply_amt_historical_rank", "apply_amt_vs_historical_mean_7", "apply_amt_lag_7")


@query(
    "availability",
    with_flows(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {str(k > 1).lower()} AS available, (SELECT count(*) FROM flows) AS n" for k, c in enumerate(AVAILABLE)
        )
    ),
)
def availability(spark, sf):
    """K2: which features exist at prediction time; same-day ranks and market means do not."""
    f = flows(spark, sf)
    named = LK.availability(f.select(*[F.lit(0.0).alias(c) for c in AVAILABLE]))
    return named.crossJoin(f.agg(F.count(F.lit(1)).alias("n")))
