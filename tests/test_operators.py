"""Golden, property and brute-force tests on hand-made frames (FIXTURES.md section 3)."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import frame
from ebbflow.functions.quantiles import exact_quantiles, quantile_name
from ebbflow.operators import attributes as AT
from ebbflow.operators import clean as C
from ebbflow.operators import forecast as FC
from ebbflow.operators import leakage as LK
from ebbflow.operators import market as M
from ebbflow.operators import metrics as MT
from ebbflow.operators import select as SEL
from ebbflow.operators import stats as S
from ebbflow.operators import technical as TE
from ebbflow.operators import windows as W
from ebbflow.functions.exprs import average_rank
from ebbflow.schema import D, K

D0 = dt.date(2024, 1, 1)


def days(n, start=D0):
    return [(start + dt.timedelta(days=i)).isoformat() for i in range(n)]


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(K, D).collect()]


# ----------------------------------------------------------------- windows
def test_two_funds_windows_do_not_cross(spark):
    a = [("A", d, float(10 + i), 1.0) for i, d in enumerate(days(5))]
    b = [("B", d, float(1000 * (i + 1)), 2.0) for i, d in enumerate(days(5))]
    alone = frame(spark, a).select(K, D, *W.lag_columns(["apply_amt"], (1,)), *W.rolling_columns(["apply_amt"], (7,)))
    both = frame(spark, a + b).select(K, D, *W.lag_columns(["apply_amt"], (1,)), *W.rolling_columns(["apply_amt"], (7,)))
    cols = [c for c in alone.columns]
    assert rows_of(alone, *cols) == rows_of(both.where("fund_code = 'A'"), *cols)
    first_b = both.where("fund_code = 'B'").orderBy(D).first()
    assert first_b["apply_amt_lag_1"] is None and first_b["apply_amt_roll_mean_7"] is None


def test_row_order_invariance(spark):
    rs = [("A", d, float(i % 3), 1.0) for i, d in enumerate(days(8))]
    random.Random(1).shuffle(rs)
    out = frame(spark, rs).select(K, D, *W.diff_columns(["apply_amt"], (1,)))
    vals = [r["apply_amt_diff_1"] for r in out.orderBy(D).collect()]
    assert vals == [None, 1.0, 1.0, -2.0, 1.0, 1.0, -2.0, 1.0]


def test_gap_days_rows_frame(spark):
    f = frame(spark, [("A", "2024-01-01", 1.0, 0.0), ("A", "2024-01-02", 2.0, 0.0), ("A", "2024-01-05", 5.0, 0.0)])
    out = f.select(K, D, *W.lag_columns(["apply_amt"], (1,)))
    assert [r[0] for r in rows_of(out, "apply_amt_lag_1")] == [None, 1.0, 2.0]


def test_zeros_pct_change_and_ratio(spark):
    f = frame(spark, [("A", d, v, 0.0) for d, v in zip(days(4), [0.0, 5.0, 0.0, 0.0])])
    out = f.select(K, D, *W.diff_columns(["apply_amt"], (1,)), *W.rolling_columns(["apply_amt"], (7,)))
    pct = [r[0] for r in rows_of(out, "apply_amt_pct_change_1")]
    assert pct == [None, None, -1.0, None]
    ratio = [r[0] for r in rows_of(out, "apply_amt_vs_roll_mean_7")]
    assert ratio[1] == pytest.approx(5.0 / 1e-8)


# ------------------------------------------------------------- exponential
def test_ewm_and_macd_match_pandas(spark):
    rng = np.random.default_rng(7)
    n = 700  # longer than one block for alpha = 0.5 and 0.3
    vals = np.round(rng.lognormal(8, 1, n))
    f = frame(spark, [("A", d, float(v), float(v) / 2) for d, v in zip(days(n), vals)])
    out = TE.add_technical_features(f).orderBy(D).toPandas()
    s = pd.Series(vals)
    for a in (0.1, 0.2, 0.3, 0.5):
        tag = TE.alpha_tag(a)
        np.testing.assert_allclose(out[f"apply_amt_ewm_{tag}"], s.ewm(alpha=a).mean(), rtol=1e-9)
        np.testing.assert_allclose(out[f"apply_amt_ewm_std_{tag}"][1:], s.ewm(alpha=a).std()[1:], rtol=1e-7)
        assert pd.isna(out[f"apply_amt_ewm_std_{tag}"][0])
    macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(out["apply_amt_macd"], macd, rtol=1e-9, atol=1e-6)
    np.testing.assert_allclose(out["apply_amt_macd_signal"], macd.ewm(span=9, adjust=False).mean(), rtol=1e-9, atol=1e-6)
    d = s.diff()
    g = d.where(d > 0, 0).rolling(14, min_periods=1).mean()
    lo = (-d.where(d < 0, 0)).rolling(14, min_periods=1).mean()
    np.testing.assert_allclose(out["apply_amt_rsi_14"], 100 - 100 / (1 + g / (lo + 1e-8)), rtol=1e-9)


# ---------------------------------------------------------------- X5 / rank
def test_historical_percentile_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for fund in ("A", "B"):
        for i, d in enumerate(days(150)):
            rows.append((fund, d, float(rng.randint(0, 20)), 1.0))
    f = frame(spark, rows)
    out = M.add_historical_percentile(f, ["apply_amt"], (7,)).orderBy(K, D).collect()
    for fund in ("A", "B"):
        xs = [r["apply_amt"] for r in out if r[K] == fund]
        got = [r["apply_amt_historical_percentile_7"] for r in out if r[K] == fund]
        want = [0.5] + [sum(1 for y in xs[:i] if y <= xs[i]) / i for i in range(1, len(xs))]
        assert got == pytest.approx(want)


def test_ties_average_rank(spark):
    f = frame(spark, [("A", "2024-01-01", 1.0, 0.0), ("B", "2024-01-01", 1.0, 0.0), ("C", "2024-01-01", 3.0, 0.0)])
    out = f.select(K, average_rank("apply_amt", [D]).alias("r")).orderBy(K).collect()
    assert [r["r"] for r in out] == [1.5, 1.5, 3.0]
    pct = M.add_daily_features(f, ["apply_amt"]).orderBy(K).collect()
    assert [r["apply_amt_daily_rank"] for r in pct] == pytest.approx([0.5, 0.5, 1.0])


# ------------------------------------------------------------ quantiles etc
@pytest.mark.parametrize("n", [57, 9000])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = rng.integers(0, 500, n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    row = exact_quantiles(df, ["x"], probs).first()
    for p in probs:
        assert row[quantile_name("x", p)] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12)


def test_pairwise_correlations_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)) * [1, 10, 1e6, 3], columns=list("abcd"))
    pdf.loc[::7, "b"] = np.nan
    pdf["d"] = 4.0  # constant: correlation undefined
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))
    got = {(r["col_i"], r["col_j"]): r["corr"] for r in SEL.pairwise_correlations(df, list("abcd")).collect()}
    want = pdf.corr()
    for (i, j), v in got.items():
        if pd.isna(want.loc[i, j]):
            assert v is None
        else:
            assert v == pytest.approx(want.loc[i, j], abs=1e-12)


def test_constant_column_report_and_corr(spark):
    f = frame(spark, [("A", d, 5.0, 5.0) for d in days(6)])
    rep = {r["column"]: r["is_constant"] for r in SEL.constant_report(f, ["apply_amt"]).collect()}
    assert rep == {"apply_amt": True}
    beh = S.behavior_stats(f).first()
    assert beh["correlation"] == 0.0


# ------------------------------------------------------------------- fills
def test_ffill_bfill_and_median_zero_fallback(spark):
    rows = [("A", d, v, 0.0) for d, v in zip(days(5), [None, 2.0, None, 4.0, None])]
    rows += [("Z", d, None, 0.0) for d in days(2)]
    f = frame(spark, rows)
    filled = C.ffill_bfill(f, ["apply_amt"])
    got = {(r[K], r[D].isoformat()): r["apply_amt"] for r in filled.collect()}
    assert [got[("A", d)] for d in days(5)] == [2.0, 2.0, 2.0, 4.0, 4.0]
    assert got[("Z", days(1)[0])] is None
    med = C.median_fill(filled, ["apply_amt"]).where("fund_code = 'Z'").first()
    assert med["apply_amt"] == 2.0  # median of the filled A rows 2, 2, 2, 4, 4
