"""Folders of the test tables and small frames, imported by the tests by name (no conftest is)."""

import datetime as dt

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


def frame(spark, rows, schema="fund_code string, transaction_date date, apply_amt double, redeem_amt double"):
    out = []
    for r in rows:
        r = list(r)
        if isinstance(r[1], str):
            r[1] = dt.date.fromisoformat(r[1])
        out.append(tuple(r))
    return spark.createDataFrame(out, schema)
