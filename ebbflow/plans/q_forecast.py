"""Queries for the forecast (F1-F10, J6) and its sinks.

The forecast starts the day after the last date of the data; the start date
is one scalar read from the table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbflow.operators import forecast as FC
from ebbflow.plans import pipeline as PL
from ebbflow.plans.catalog import R, flows, query, round_floats
from ebbflow.plans.oracle_sql import with_flows
from ebbflow.schema import D, K
from ebbflow.sources import io as IO

T2 = ("apply_amt", "redeem_amt")
UV3 = ("uv_key_page_1", "uv_key_page_2", "uv_key_page_3")


def _r(expr: str) -> str:
    return f"round({expr}, {R}) + 0.0"


def start_of(df) -> dt.date:
    """Day after the last date: one scalar action."""
    return df.agg(F.max(D)).first()[0] + dt.timedelta(days=1)


ST = "st AS (SELECT max(transaction_date) + 1 AS start FROM flows)"
BASE_CTES = (
    ST
    + """,
r AS (SELECT fund_code, apply_amt, redeem_amt,
        row_number() OVER (PARTITION BY fund_code ORDER BY transaction_date DESC) AS rn
      FROM flows WHERE transaction_date < (SELECT start FROM st)),
b0 AS (SELECT fund_code, count(*) AS n_real, """
    + ", ".join(
        f"""avg({t}) FILTER (WHERE rn <= 7) AS {t}_ma7, avg({t}) FILTER (WHERE rn <= 14) AS {t}_ma14,
        CASE WHEN count(*) >= 7 THEN avg({t}) FILTER (WHERE rn <= 7)
             + (max({t}) FILTER (WHERE rn = 1) - max({t}) FILTER (WHERE rn = 7)) / 7.0 ELSE avg({t}) END AS {t}_trend,
        avg({t}) FILTER (WHERE rn <= 7) * (1 + 0.1 * sin(2 * pi() * dayofyear((SELECT start FROM st)) / 365.0)) AS {t}_seasonal"""
        for t in T2
    )
    + """ FROM r GROUP BY fund_code),
b AS (SELECT *, """
    + ", ".join(
        f"list_avg(list_filter([{t}_ma7, {t}_ma14, {t}_trend, {t}_seasonal], lambda v: v IS NOT NULL AND v > 0)) AS {t}_baseline"
        for t in T2
    )
    + " FROM b0)"
)


@query(
    "baselines",
    with_flows(
        "SELECT fund_code, n_real, "
        + ", ".join(f"{_r(f'{t}_{n}')} AS {t}_{n}" for t in T2 for n in ("ma7", "ma14", "trend", "seasonal", "baseline"))
        + " FROM b",
        extra_ctes=BASE_CTES,
    ),
)
def baselines(spark, sf):
    """F2 + F3: ma7, ma14, trend, seasonal baselines and their ensemble per fund."""
    f = flows(spark, sf).select(K, D, *T2)
    return round_floats(FC.baselines(f, start_of(f)))


LATEST = "lt AS (SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY fund_code ORDER BY transaction_date DESC) = 1)"


@query(
    "forecast_frame",
    with_flows(
        "SELECT fund_code, CAST((SELECT start FROM st) + CAST(i AS INTEGER) AS DATE) AS transaction_date, apply_amt, redeem_amt, "
        "CAST(i AS INTEGER) AS day_idx FROM lt, (SELECT unnest(range(0, 7)) AS i)",
        extra_ctes=ST + ",\n" + LATEST,
    ),
)
def forecast_frame(spark, sf):
    """Funds x the next 7 dates, values copied from each fund's latest row."""
    f = flows(spark, sf).select(K, D, *T2)
    return FC.future_frame(f, start_of(f), 7)


MODEL_CTE = (
    "mdl AS (SELECT fund_code, avg(apply_amt - redeem_amt) AS apply_amt_model, avg(redeem_amt - apply_amt) AS redeem_amt_model "
    "FROM (SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY fund_code ORDER BY transaction_date DESC) <= 30) GROUP BY fund_code)"
)


def _blend_sql(with_model: bool) -> str:
    sel = []
    for t in T2:
        base = f"b.{t}_baseline"
        floored = f"greatest(100, {base})"
        if with_model:
            w = "greatest(0.1, 0.8 - 0.1 * i)"
            val = (
                f"CASE WHEN i % 3 = 0 AND mdl.{t}_model IS NOT NULL AND mdl.{t}_model > 0 "
                f"THEN greatest(100, {w} * mdl.{t}_model + (1 - {w}) * {base}) ELSE {floored} END"
            )
        else:
            val = floored
        sel.append(f"{_r(f'CASE WHEN coalesce(b.n_real, 0) >= 7 AND {base} IS NOT NULL THEN {val} ELSE lt.{t} END')} AS {t}")
    join_model = " LEFT JOIN mdl USING (fund_code)" if with_model else ""
    return (
        f"SELECT lt.fund_code, CAST((SELECT start FROM st) + CAST(i AS INTEGER) AS DATE) AS transaction_date, "
        f"CAST(i AS INTEGER) AS day_idx, {', '.join(sel)} "
        f"FROM lt CROSS JOIN (SELECT unnest(range(0, 7)) AS i) LEFT JOIN b USING (fund_code){join_model}"
    )


def model_stand_in(f):
    """A per-fund 'model value' derived from the data: mean net flow of the last 30 rows (negative ones exercise F4)."""
    w = Window.partitionBy(K).orderBy(F.col(D).desc())
    last = f.withColumn("__rn", F.row_number().over(w)).where("__rn <= 30")
    return last.groupBy(K).agg(
        F.avg(F.col("apply_amt") - F.col("redeem_amt")).alias("apply_amt_model"),
        F.avg(F.col("redeem_amt") - F.col("apply_amt")).alias("redeem_amt_model"),
    )


@query(
    "blend_forecast",
    with_flows(_blend_sql(True), extra_ctes=BASE_CTES + ",\n" + LATEST + ",\n" + MODEL_CTE),
)
def blend_forecast(spark, sf):
    """Baseline ensemble blended with a model value on days 0, 3, 6; floor 100; carry when no baseline."""
    f = flows(spark, sf).select(K, D, *T2)
    fc = FC.forecast(f, start_of(f), 7, model_preds=model_stand_in(f))
    return round_floats(fc.select(K, D, "day_idx", *T2))


def _heur_sql() -> str:
    doy = "dayofyear((SELECT start FROM st))"
    wd = "(isodow((SELECT start FROM st)) - 1)"
    sel = ["count(*) AS n_rows"]
    for t in T2:
        ma7, ma14, ma30 = (f"avg({t}) FILTER (WHERE rn <= {k})" for k in (7, 14, 30))
        std14 = f"stddev_samp({t}) FILTER (WHERE rn <= 14)"
        pred = (
            f"{ma7} * (1 + (0.7 * (({ma7} - {ma14}) / ({ma14} + 1e-8)) + 0.3 * (({ma14} - {ma30}) / ({ma30} + 1e-8))) * 0.3)"
            f" * (1 + 0.05 * sin(2 * pi() * {doy} / 365.0))"
            f" * greatest(0.8, least(1.2, 1 - {std14} / ({ma14} + 1e-8) * 0.1))"
        )
        sel.append(f"{_r(f'CASE WHEN count(*) >= 14 THEN greatest(100, {pred}) ELSE greatest(100, avg({t})) END')} AS {t}")
    for u in UV3:
        ma = f"avg({u}) FILTER (WHERE rn <= 7)"
        tr = f"avg(pct_{u}) FILTER (WHERE rn <= 7)"
        pred = (
            f"{ma} * (1 + {tr} * 0.2) * (1 + 0.1 * sin(2 * pi() * {doy} / 365.0)) * CASE WHEN {wd} >= 5 THEN 0.8 ELSE 1.0 END"
        )
        sel.append(
            f"{_r(f'CASE WHEN count(*) >= 7 THEN greatest(0, {pred}) ELSE CAST(max({u}) FILTER (WHERE rn = 1) AS DOUBLE) END')} AS {u}"
        )
    pcts = ", ".join(
        f"{u} / nullif(lag({u}) OVER (PARTITION BY fund_code ORDER BY transaction_date), 0) - 1 AS pct_{u}" for u in UV3
    )
    return with_flows(
        f"SELECT fund_code, (SELECT start FROM st) AS transaction_date, {', '.join(sel)} FROM "
        f"(SELECT *, {pcts}, row_number() OVER (PARTITION BY fund_code ORDER BY transaction_date DESC) AS rn FROM flows) "
        "GROUP BY fund_code",
        extra_ctes=ST,
    )


@query("heuristic_day", _heur_sql())
def heuristic_day(spark, sf):
    """F8 + F9: one-step heuristic forecast of amounts and UV for the next day."""
    f = flows(spark, sf)
    out = FC.heuristic_day(f, start_of(f))
    return round_floats(out.select(K, D, "n_rows", *T2, *[F.col(u).cast("double").alias(u) for u in UV3]))


@query("recursive_forecast", None)
def recursive_forecast(spark, sf):
    """true 7-day recursion of the heuristics (rows-only; brute-force test in tests/)."""
    f = flows(spark, sf)
    return FC.recursive_forecast(f, start_of(f), 7)


@query(
    "submission",
    with_flows(
        "SELECT fund_code, strftime(transaction_date, '%Y%m%d') AS transaction_date, apply_amt AS apply_amt_pred, "
        f"redeem_amt AS redeem_amt_pred FROM ({_blend_sql(False)})",
        extra_ctes=BASE_CTES + ",\n" + LATEST,
    ),
)
def submission(spark, sf):
    """The 4-column submission of the 7-day forecast (date as yyyyMMdd text)."""
    f = flows(spark, sf).select(K, D, *T2)
    return round_floats(PL.submission(FC.forecast(f, start_of(f), 7)))


@query(
    "forecast_summary",
    with_flows(
        "SELECT count(DISTINCT fund_code) AS n_funds, count(DISTINCT transaction_date) AS n_days, count(*) AS n_rows, "
        + ", ".join(f"{_r(f'min({t})')} AS {t}_min, {_r(f'max({t})')} AS {t}_max" for t in T2)
        + f" FROM ({_blend_sql(False)})",
        extra_ctes=BASE_CTES + ",\n" + LATEST,
    ),
)
def forecast_summary(spark, sf):
    """Funds, days, rows and per-target min / max of the forecast."""
    f = flows(spark, sf).select(K, D, *T2)
    return round_floats(IO.forecast_summary(FC.forecast(f, start_of(f), 7), suffix=""))


@query(
    "head_rows",
    with_flows("SELECT fund_code, transaction_date, apply_amt, redeem_amt FROM flows ORDER BY fund_code, transaction_date LIMIT 10"),
)
def head_rows(spark, sf):
    """The first 10 rows in (fund, date) order (a top-k report)."""
    return IO.head_rows(flows(spark, sf).select(K, D, *T2), 10)
