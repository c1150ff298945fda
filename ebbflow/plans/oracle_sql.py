"""Independent DuckDB SQL for the query catalogue (the correctness oracle).

Each statement reads the raw driver tables (views ``lineitem``, ``part``,
``events`` ...) and rebuilds the flow table with the adapter SQL of the test
fixtures, so the oracle shares no code with the Spark side.
"""

from __future__ import annotations

FLOWS_SQL = {
    "lineitem": """
SELECT lpad(CAST(CAST(substr(p_brand,7) AS INT)*23801 AS VARCHAR),6,'0') AS fund_code,
       CAST(l_shipdate AS DATE) AS transaction_date,
       round(sum(CASE WHEN l_returnflag<>'R' THEN l_extendedprice*(1-l_discount) ELSE 0 END)) AS apply_amt,
       round(sum(CASE WHEN l_returnflag='R'  THEN l_extendedprice*(1-l_discount) ELSE 0 END)) AS redeem_amt,
       count(DISTINCT l_orderkey) AS uv_key_page_1,
       count(DISTINCT l_suppkey)  AS uv_key_page_2,
       count(DISTINCT l_partkey)  AS uv_key_page_3
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "lineitem_week": """
SELECT lpad(CAST(CAST(substr(p_brand,7) AS INT)*23801 AS VARCHAR),6,'0') AS fund_code,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS transaction_date,
       round(sum(CASE WHEN l_returnflag<>'R' THEN l_extendedprice*(1-l_discount) ELSE 0 END)) AS apply_amt,
       round(sum(CASE WHEN l_returnflag='R'  THEN l_extendedprice*(1-l_discount) ELSE 0 END)) AS redeem_amt,
       count(DISTINCT l_orderkey) AS uv_key_page_1,
       count(DISTINCT l_suppkey)  AS uv_key_page_2,
       count(DISTINCT l_partkey)  AS uv_key_page_3
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "events": """
SELECT lpad(CAST((user_id%20)*29003 AS VARCHAR),6,'0') AS fund_code, CAST(ts AS DATE) AS transaction_date,
       round(sum(CASE WHEN event_type IN ('purchase','signup') THEN value ELSE 0 END)) AS apply_amt,
       round(sum(CASE WHEN event_type='error' THEN value ELSE 0 END)) AS redeem_amt,
       sum(CASE WHEN event_type='view'  THEN 1 ELSE 0 END) AS uv_key_page_1,
       sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS uv_key_page_2,
       count(DISTINCT user_id) AS uv_key_page_3
FROM events GROUP BY 1, 2""",
    "supplier": """
SELECT lpad(CAST(l_suppkey AS VARCHAR),6,'0') AS fund_code,
       CAST(l_shipdate AS DATE) AS transaction_date,
       round(sum(CASE WHEN l_returnflag<>'R' THEN l_extendedprice*(1-l_discount) ELSE 0 END)) AS apply_amt,
       round(sum(CASE WHEN l_returnflag='R'  THEN l_extendedprice*(1-l_discount) ELSE 0 END)) AS redeem_amt,
       count(DISTINCT l_orderkey) AS uv_key_page_1,
       count(DISTINCT l_suppkey)  AS uv_key_page_2,
       count(DISTINCT l_partkey)  AS uv_key_page_3
FROM lineitem GROUP BY 1, 2""",
}

# Holiday rule of the fixtures: 1 Jan, 1 May, 1-7 Oct, for every year of the
# flows plus one year either side.
HOLIDAYS_SQL = """
SELECT make_date(y, md[1], md[2]) AS holiday_date
FROM (SELECT unnest(range(year(min(transaction_date)) - 1, year(max(transaction_date)) + 2)) AS y FROM flows) ys,
     (SELECT unnest([[1,1],[5,1],[10,1],[10,2],[10,3],[10,4],[10,5],[10,6],[10,7]]) AS md) mds"""


def with_flows(body: str, adapter: str = "lineitem", extra_ctes: str = "") -> str:
    ctes = f"flows_raw AS ({FLOWS_SQL[adapter]}),\nflows AS (SELECT * FROM flows_raw)"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql
