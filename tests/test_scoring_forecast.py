"""Closed-form scoring, thresholds, recursion, parsing and leakage checks."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import frame
from ebbflow.operators import attributes as AT
from ebbflow.operators import forecast as FC
from ebbflow.operators import leakage as LK
from ebbflow.operators import metrics as MT
from ebbflow.operators import stats as S
from ebbflow.operators import windows as W
from ebbflow.schema import D, K

D0 = dt.date(2024, 1, 1)


def days(n, start=D0):
    return [(start + dt.timedelta(days=i)).isoformat() for i in range(n)]


def test_wmape_closed_form(spark):
    y = {"A": [10, 20, 0, 30, 10, 20, 10], "B": [5, 5, 5, 5, 5, 5, 5]}
    p = {"A": [12, 18, 3, 30, 8, 20, 11], "B": [5, 6, 4, 5, 5, 5, 7]}
    rows = []
    for fund in y:
        for i, d in enumerate(days(7)):
            rows.append((fund, dt.date.fromisoformat(d), float(y[fund][i]), float(y[fund][i]), float(p[fund][i]), float(p[fund][i])))
    df = spark.createDataFrame(rows, "fund_code string, transaction_date date, apply_amt double, redeem_amt double, apply_amt_pred double, redeem_amt_pred double")

    def fund_w(a, b):
        tot = sum(a)
        return sum(abs(q - v) / v * (v / tot) for v, q in zip(a, b) if v != 0) if tot else 0.0

    per = {r[K]: r["wmape"] for r in MT.wmape_per_fund(df, "apply_amt", "apply_amt_pred").collect()}
    assert per["A"] == pytest.approx(fund_w(y["A"], p["A"]))
    g = sum(sum(v) for v in y.values())
    want = sum(fund_w(y[f], p[f]) * sum(y[f]) / g for f in y)
    comp = MT.competition_score(df).first()
    assert comp["apply_amt_wmape"] == pytest.approx(want)
    assert comp["final_wmape"] == pytest.approx(want)
    weights = [r["weight"] for r in MT.fund_weights(df, "apply_amt").collect()]
    assert sum(weights) == pytest.approx(1.0)
    glob = MT.wmape_global(df, "apply_amt", "apply_amt_pred").first()["wmape"]
    assert glob == pytest.approx(sum(abs(q - v) for f in y for v, q in zip(y[f], p[f])) / g)


def test_positional_alignment_checks_counts(spark):
    a = frame(spark, [("A", d, 1.0, 1.0) for d in days(3)])
    p = frame(spark, [("A", d, 1.0, 1.0) for d in days(2)]).select(K, D, F.col("apply_amt").alias("apply_amt_pred"))
    with pytest.raises(Exception):
        MT.align_by_position(a, p).collect()


def test_short_fund_thresholds(spark):
    f = frame(spark, [("A", d, float(10 + i), float(5 + (i % 2))) for i, d in enumerate(days(5))])
    risk = S.risk_stats(f).first()
    assert risk["var95"] == 0.0 and risk["sharpe"] == 0.0  # 4 returns: below 5, all zero
    f6 = frame(spark, [("A", d, float(10 + i), float(5 + (i % 2))) for i, d in enumerate(days(6))])
    assert S.risk_stats(f6).first()["sharpe"] != 0.0  # 5 returns: computed
    sig = S.signal_stats(f).first()
    assert sig["momentum"] == 0.0  # <= 10 rows
    fc = FC.forecast(f, dt.date(2024, 1, 6), 3).orderBy("day_idx").collect()
    assert [r["apply_amt"] for r in fc] == [14.0, 14.0, 14.0]  # < 7 rows: carry the last value


def test_recursive_forecast_brute_force(spark):
    rng = np.random.default_rng(11)
    vals = list(np.round(rng.lognormal(6, 0.5, 40)))
    f = frame(spark, [("A", d, float(v), float(v) * 0.5) for d, v in zip(days(40), vals)])
    start = D0 + dt.timedelta(days=40)
    got = [r["apply_amt"] for r in FC.recursive_forecast(f, start, 7).orderBy("day_idx").collect()]
    hist = list(vals)
    want = []
    for k in range(7):
        doy = (start + dt.timedelta(days=k)).timetuple().tm_yday
        h = np.array(hist)
        ma7, ma14, ma30 = h[-7:].mean(), h[-14:].mean(), h[-30:].mean()
        comb = 0.7 * (ma7 - ma14) / (ma14 + 1e-8) + 0.3 * (ma14 - ma30) / (ma30 + 1e-8)
        season = 1 + 0.05 * np.sin(2 * np.pi * doy / 365)
        vol = h[-14:].std(ddof=1) / (ma14 + 1e-8)
        pred = max(100.0, ma7 * (1 + comb * 0.3) * season * max(0.8, min(1.2, 1 - vol * 0.1)))
        want.append(pred)
        hist.append(pred)
    assert got == pytest.approx(want, rel=1e-9)


def test_gini_closed_form(spark):
    f = frame(spark, [("A", d, v, 0.0) for d, v in zip(days(4), [1.0, 2.0, 3.0, 4.0])])
    g = S.gini(f, "apply_amt").first()["concentration"]
    v = np.sort([1.0, 2.0, 3.0, 4.0])
    assert g == pytest.approx(2 * np.sum(np.arange(1, 5) * v) / (4 * v.sum()) - 5 / 4)


RESPONSES = [
    ("clean", '{"risk_level": 4, "fund_style": "价值", "market_beta": 1.5}'),
    ("prose", 'Here you go:\n{"risk_level": "2", "liquidity_rating": 9}\nthanks'),
    ("two", '{"risk_level": 2} and {"risk_level": 3}'),
    ("none", None),
    ("nobrace", "risk level is 3"),
    ("broken", '{"risk_level": 2,,}'),
    ("range", '{"risk_level": 42, "market_beta": 99, "expected_return": -500, "fund_category": 7}'),
    ("bad", '{"risk_level": "high", "unknown_key": 1}'),
]


def test_parse_responses_cases(spark):
    resp = spark.createDataFrame([(c, "fund", r) for c, r in RESPONSES], "fund_code string, kind string, response string")
    funds = spark.createDataFrame([(c, D0) for c, _ in RESPONSES for _ in range(7)], "fund_code string, transaction_date date")
    out = {r[K]: r for r in AT.attributes_from_responses(funds, resp).collect()}
    dflt = {r[K]: r for r in AT.default_attributes(funds).collect()}
    assert out["clean"]["risk_level"] == 4.0 and out["clean"]["fund_style"] == "价值" and out["clean"]["market_beta"] == 1.5
    assert out["prose"]["risk_level"] == 2.0 and out["prose"]["liquidity_rating"] == 5.0  # 'rating' -> [1, 5]
    for case in ("two", "none", "nobrace", "broken"):
        assert out[case]["risk_level"] == dflt[case]["risk_level"]
    assert out["range"]["risk_level"] == 5.0 and out["range"]["market_beta"] == 3.0 and out["range"]["expected_return"] == -100.0
    assert out["range"]["fund_category"] == "7"
    assert out["bad"]["risk_level"] == dflt["bad"]["risk_level"]
    parsed = AT.parse_responses(resp).where("fund_code = 'bad'").first()
    assert parsed["extra"] == {"unknown_key": "1"}


def test_clamp_rules():
    assert AT.clamp_range("liquidity_rating", 6.0) == (1.0, 5.0)
    assert AT.clamp_range("momentum_factor", 0.3) == (0.0, 1.0)
    assert AT.clamp_range("market_beta", 1.0) == (0.1, 3.0)
    assert AT.clamp_range("risk_adjusted_return", 0.5) == (-100.0, 100.0)
    assert AT.clamp_range("management_capability", 7.0) is None
    assert len(AT.ATTRIBUTE_KEYS) == 48


def test_code_inference_rules(spark):
    codes = spark.createDataFrame([("510099",), ("000001",), ("712345",), ("188000",)], "fund_code string")
    got = {r[K]: r for r in codes.select(K, *[v.alias(k) for k, v in AT.code_inference_columns(F.col(K)).items()]).collect()}
    assert got["510099"]["fund_category"] == "混合型" and got["510099"]["fund_style"] == "量化"
    assert got["510099"]["expected_return"] == 7.0
    assert got["000001"]["fund_category"] == "QDII" and got["000001"]["risk_level"] == 4.0
    assert got["712345"]["fund_category"] == "混合型"
    assert got["188000"]["fund_description"] == "债券基金，量化投资策略"


def test_embedding_dims(spark):
    df = spark.createDataFrame([(list(map(float, range(128))),), (list(map(float, range(64))),), (None,)], "e array<float>")
    rows = df.select(*AT.embedding_columns(F.col("e"))).collect()
    assert [rows[0][f"embed_{i}"] for i in range(16)] == [float(d) for d in AT.EMBED_DIMS]
    assert [rows[1][f"embed_{i}"] for i in range(16)] == [float(i) for i in range(16)]
    assert all(rows[2][f"embed_{i}"] == 0.0 for i in range(16))


def test_truncation_test_flags_look_ahead(spark):
    f = frame(spark, [("A", d, float((i * 7) % 11), 1.0) for i, d in enumerate(days(40))])

    def build(df):
        cols = ("apply_amt",)
        return df.select(K, D, "apply_amt", "redeem_amt", *W.lag_columns(cols, (1,)),
                         *W.rolling_inclusive_columns(cols, (7,), centred=True), *W.rolling_columns(cols, (7,)))

    rep = {r["column"]: r for r in LK.truncation_test(f, build, D0 + dt.timedelta(days=30)).collect()}
    assert rep["apply_amt_roll_mean_centred_7"]["n_diff_future"] > 0
    assert rep["apply_amt_lag_1"]["n_diff_future"] == 0 and rep["apply_amt_lag_1"]["n_diff_same_day"] == 0
    assert rep["apply_amt_vs_roll_mean_7"]["n_diff_same_day"] > 0  # reads today's target
    assert rep["apply_amt_roll_mean_7"]["n_diff_same_day"] == 0
    assert LK.is_available("apply_amt_daily_rank") is False
    assert LK.is_available("apply_amt_vs_historical_mean_7") is True
