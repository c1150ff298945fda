"""Queries for sources, cleaning and calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import calendar as CAL
from ebbflow.operators import clean as C
from ebbflow.plans.catalog import R, flows, query, round_floats, written_flows
from ebbflow.plans.oracle_sql import HOLIDAYS_SQL, with_flows
from ebbflow.schema import D, K
from ebbflow.sources import adapters as A
from ebbflow.sources import io as IO

FLOW_COLS = "fund_code, transaction_date, apply_amt, redeem_amt, uv_key_page_1, uv_key_page_2, uv_key_page_3"


@query("flow_daily", with_flows(f"SELECT {FLOW_COLS} FROM flows"))
def flow_daily(spark, sf):
    """Adapter A: the daily flow table from lineitem x part."""
    return flows(spark, sf)


@query("flow_events", with_flows(f"SELECT {FLOW_COLS} FROM flows", "events"))
def flow_events(spark, sf):
    """Adapter B: the daily flow table from events."""
    return flows(spark, sf, "events")


@query("flow_supplier", with_flows(f"SELECT {FLOW_COLS} FROM flows", "supplier"))
def flow_supplier(spark, sf):
    """Adapter C: one fund per supplier (the bench input)."""
    return flows(spark, sf, "supplier")


@query(
    "profile",
    with_flows(
        "SELECT count(*) AS n_rows, 7 AS n_columns, min(transaction_date) AS min_date, "
        "max(transaction_date) AS max_date, count(DISTINCT fund_code) AS n_funds FROM flows"
    ),
)
def profile(spark, sf):
    """S3: rows, columns, date range and distinct funds."""
    return IO.profile(flows(spark, sf))


def _iqr_sql() -> str:
    cols = ["apply_amt", "redeem_amt", "uv_key_page_1", "uv_key_page_2", "uv_key_page_3"]
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS "column", q1, q3, q3 - q1 AS iqr, q1 - 3 * (q3 - q1) AS lower, q3 + 3 * (q3 - q1) AS upper,
  (SELECT count(*) FROM flows WHERE {c} < b.q1 - 3 * (b.q3 - b.q1) OR {c} > b.q3 + 3 * (b.q3 - b.q1)) AS outliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM flows) b"""
        )
    body = " UNION ALL ".join(parts)
    return with_flows(
        f'SELECT "column", round(q1, {R}) AS q1, round(q3, {R}) AS q3, round(iqr, {R}) AS iqr, '
        f"round(lower, {R}) AS lower, round(upper, {R}) AS upper, outliers FROM ({body})"
    )


@query("iqr_bounds", _iqr_sql())
def iqr_bounds(spark, sf):
    """Exact IQR bounds (factor 3) and outlier counts per column."""
    return round_floats(C.outlier_counts(written_flows(spark, sf)))


def _clean_sql() -> str:
    cols = ["apply_amt", "redeem_amt", "uv_key_page_1", "uv_key_page_2", "uv_key_page_3"]
    bounds = ", ".join(
        f"quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, "
        f"quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi"
        for c in cols
    )
    sel = ", ".join(
        f"round(greatest(CASE WHEN {c} < {c}_lo THEN {c}_lo WHEN {c} > {c}_hi THEN {c}_hi ELSE CAST({c} AS DOUBLE) END, 0.0), {R}) AS {c}"
        for c in cols
    )
    return with_flows(
        f"""SELECT fund_code, transaction_date, {sel}
FROM flows, (SELECT {bounds} FROM flows) b
WHERE fund_code IN (SELECT fund_code FROM flows GROUP BY fund_code HAVING count(*) >= 30)"""
    )


@query("clean_flows", _clean_sql())
def clean_flows(spark, sf):
    """Winsorise to the IQR bounds, clip at 0, keep funds with >= 30 rows."""
    return round_floats(C.clean_flows(written_flows(spark, sf)))


@query(
    "min_history",
    with_flows(
        f"SELECT {FLOW_COLS} FROM flows WHERE fund_code IN "
        "(SELECT fund_code FROM flows GROUP BY fund_code HAVING count(*) >= 30)",
        "events",
    ),
)
def min_history(spark, sf):
    """C4 / J2 on the short events adapter (every fund sits on the 30-row edge)."""
    return C.min_history(flows(spark, sf, "events"), 30)


# ---------------------------------------------------------------- calendar
@query(
    "calendar_parts",
    with_flows(
        "SELECT fund_code, transaction_date, CAST(month(transaction_date) AS INTEGER) AS month, "
        "CAST(isodow(transaction_date) - 1 AS INTEGER) AS day_of_week, CAST(day(transaction_date) AS INTEGER) AS day_of_month, "
        "CAST(dayofyear(transaction_date) AS INTEGER) AS day_of_year, CAST(weekofyear(transaction_date) AS INTEGER) AS week_of_year, "
        "CAST(quarter(transaction_date) AS INTEGER) AS quarter FROM flows"
    ),
)
def calendar_parts(spark, sf):
    """Month, weekday (Mon=0), day of month / year, ISO week, quarter."""
    return flows(spark, sf).select(K, D, *CAL.date_part_columns())


def _flag(cond: str, name: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END AS {name}"


@query(
    "calendar_flags",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            [
                _flag("isodow(transaction_date) IN (6, 7)", "is_weekend"),
                _flag("day(transaction_date) = 1", "is_month_start"),
                _flag("transaction_date = last_day(transaction_date)", "is_month_end"),
                _flag("day(transaction_date) = 1 AND month(transaction_date) IN (1, 4, 7, 10)", "is_quarter_start"),
                _flag("transaction_date = last_day(transaction_date) AND month(transaction_date) IN (3, 6, 9, 12)", "is_quarter_end"),
                _flag("day(transaction_date) = 1 AND month(transaction_date) = 1", "is_year_start"),
                _flag("transaction_date = last_day(transaction_date) AND month(transaction_date) = 12", "is_year_end"),
            ]
        )
        + " FROM flows"
    ),
)
def calendar_flags(spark, sf):
    """D2 + D3: weekend and period start / end flags."""
    return flows(spark, sf).select(K, D, *CAL.date_flag_columns())


@query(
    "calendar_cyclic",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"round({fn}(2 * pi() * {x} / {p}), {R}) + 0.0 AS {fn}_{name}"
            for name, x, p in (
                ("month", "month(transaction_date)", "12.0"),
                ("day_of_week", "(isodow(transaction_date) - 1)", "7.0"),
                ("day_of_year", "dayofyear(transaction_date)", "365.0"),
            )
            for fn in ("sin", "cos")
        )
        + " FROM flows"
    ),
)
def calendar_cyclic(spark, sf):
    """Sine / cosine encodings of month, weekday and day of year."""
    return round_floats(flows(spark, sf).select(K, D, *CAL.cyclic_columns()))


@query(
    "holiday_flags",
    with_flows(
        "SELECT fund_code, transaction_date, "
        "CASE WHEN transaction_date IN (SELECT holiday_date FROM hol) THEN 1 ELSE 0 END AS is_holiday, "
        "CASE WHEN transaction_date + INTERVAL 1 DAY IN (SELECT holiday_date FROM hol) THEN 1 ELSE 0 END AS is_before_holiday, "
        "CASE WHEN transaction_date - INTERVAL 1 DAY IN (SELECT holiday_date FROM hol) THEN 1 ELSE 0 END AS is_after_holiday "
        "FROM flows",
        extra_ctes=f"hol AS ({HOLIDAYS_SQL})",
    ),
)
def holiday_flags(spark, sf):
    """Holiday, day-before and day-after flags from a holiday table."""
    f = flows(spark, sf).select(K, D)
    return CAL.add_holiday_flags(f, A.holidays_for(f)).select(K, D, "is_holiday", "is_before_holiday", "is_after_holiday")


@query(
    "month_rank",
    with_flows(
        "SELECT fund_code, transaction_date, "
        "rank() OVER (PARTITION BY fund_code, date_trunc('month', transaction_date) ORDER BY transaction_date) "
        "+ (count(*) OVER (PARTITION BY fund_code, date_trunc('month', transaction_date), transaction_date) - 1) / 2.0 "
        "AS work_days_since_month_start FROM flows"
    ),
)
def month_rank(spark, sf):
    """Average rank of the date inside (fund, month)."""
    return CAL.add_month_rank(flows(spark, sf).select(K, D)).select(K, D, "work_days_since_month_start")
