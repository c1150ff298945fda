"""The raw tables are aggregated once a query, days of any size are counted alike, and the windows of several keys spread."""

import datetime as dt

import pytest
from frames import SF_SMALL, frame
from pyspark.sql import functions as F

from ebbflow.plans import catalog
from ebbflow.plans import pipeline as PL
from ebbflow.operators import recursion as RE
from ebbflow.schema import D, K
from ebbflow.session import spread
from ebbflow.sources import adapters as A

FLOWS = f"{K} string, {D} date, apply_amt double, redeem_amt double, uv_key_page_1 long, uv_key_page_2 long, uv_key_page_3 long"
NAMED = (
    "recursive_model", "clean_flows", "iqr_bounds", "train_predict", "predict_only", "permutation_importance", "select_report",
    "flagship_features", "boosted_trees", "walk_forward_features", "stacked_forecast", "truncation_test",
)


class Written(Exception):
    pass


@pytest.mark.parametrize("name", NAMED)
def test_flow_table_is_written_before_it_is_read(spark, monkeypatch, name):
    def stop(df):
        assert df.columns == [c.split()[0] for c in FLOWS.split(", ")]
        raise Written

    monkeypatch.setattr(catalog, "cut_lineage", stop)
    with pytest.raises(Written):
        catalog.QUERIES[name](spark, SF_SMALL)


@pytest.mark.parametrize("name", ["iqr_bounds", "clean_flows"])
def test_flow_table_is_made_once(spark, monkeypatch, name):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    day = dt.date(2024, 1, 1)
    rows = [(f"{k:06d}", day + dt.timedelta(days=i), 10.0 * i + k, 5.0 * i, i, i % 3, k) for k in range(3) for i in range(40)]
    monkeypatch.setitem(A.ADAPTERS, "lineitem", lambda s, sf: s.createDataFrame(rows, FLOWS).mapInArrow(counted, FLOWS))
    assert len(catalog.QUERIES[name](spark, SF_SMALL).collect()) == (5 if name == "iqr_bounds" else len(rows))
    assert seen.value == len(rows)


def test_busy_days_and_others_count_alike(spark):
    fields = f"{K} string, {D} date, _apply double, _redeem double, l_orderkey long, l_suppkey long, l_partkey long"
    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    raw = [
        ("a", one, 1.0, 0.0, 1, 7, 3), ("a", one, 2.0, 0.0, 1, 8, 3), ("a", one, 0.0, 4.0, 2, None, 3), ("b", one, 5.0, 0.0, None, None, None),
        ("a", two, 1.0, 0.0, 9, 9, 9), (None, two, 3.0, None, 9, 9, 9), ("a", None, 6.0, 0.0, 1, 1, 1), ("a", None, 6.0, 0.0, 1, 2, 1), ("b", None, None, None, 5, 5, 5),
    ]
    df = spark.createDataFrame(raw, fields)
    want = {
        ("a", one, 3.0, 4.0, 2, 2, 1), ("b", one, 5.0, 0.0, 0, 0, 0), ("a", two, 1.0, 0.0, 1, 1, 1), (None, two, 3.0, None, 1, 1, 1),
        ("a", None, 12.0, 0.0, 1, 2, 1), ("b", None, None, None, 1, 1, 1),
    }
    for most in (0, 2, 3, 100):  # all days are busy, the null day is, none is
        got = [tuple(r) for r in A._flows(df, lambda rows: rows, most).collect()]
        assert len(got) == len(want) and set(got) == want


def test_keys_are_not_merged_into_one_task(spark):
    df = frame(spark, [(k, f"2024-01-{i:02d}", float(i), 1.0) for k in "abc" for i in range(1, 32)])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        assert spread(df, K).rdd.getNumPartitions() == 3
        assert spread(df.limit(0), K).rdd.getNumPartitions() == 1
        assert RE.add_model_features(df).select(K, "apply_amt_rsi_7").rdd.getNumPartitions() == 3
        uv = df.select("*", *[F.lit(1).cast("long").alias(f"uv_key_page_{i}") for i in (1, 2, 3)])
        assert PL.create_features(uv, fill=False).select(K, "apply_amt_rsi_7").rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
