"""Cases that the oracle tables do not hold: gaps, large levels, long texts, ties, unequal counts."""

import numpy as np
import pandas as pd
import pytest
from frames import frame
from pyspark.sql import functions as F

from ebbflow.functions.quantiles import exact_quantiles, quantile_name
from ebbflow.operators import attributes as AT
from ebbflow.operators import market as M
from ebbflow.operators import metrics as ME
from ebbflow.operators import technical as TE
from ebbflow.schema import D, K
from ebbflow.sources import io as IO


def series(spark, values, key="f"):
    days = pd.date_range("2024-01-01", periods=len(values)).strftime("%Y-%m-%d")
    return frame(spark, [(key, d, None if v is None else float(v), 1.0) for d, v in zip(days, values)])


def technical(spark, values, **how):
    rows = TE.add_technical_features(series(spark, values), ("apply_amt",), (0.1, 0.3, 0.5), **how).orderBy(D)
    return rows.toPandas()


def same(got, want, tol=1e-6):
    got, want = got.astype(float).to_numpy(), want.astype(float).to_numpy()
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


GAPS = [
    [5, None, 7, 9, None, 4, 6],
    [None, None, 3, 8, None, None, None, 2, 7, 7, None, 1],
    [None] * 5,
    [4],
    [1.0] * 200 + [None] * 60 + [2.0, 5.0] * 100,
    [1e8 + v for v in (0.3, 1.1, -0.4, 0.9, -1.2, 0.5, 0.1, -0.7)],
]


@pytest.mark.parametrize("values", GAPS, ids=range(len(GAPS)))
def test_exponential_weights_equal_pandas(spark, values):
    out = technical(spark, values)
    x = pd.Series(values, dtype=float)
    for a in (0.1, 0.3, 0.5):
        tag = TE.alpha_tag(a)
        same(out[f"apply_amt_ewm_{tag}"], x.ewm(alpha=a).mean())
        same(out[f"apply_amt_ewm_std_{tag}"], x.ewm(alpha=a).std(), 1e-5)
    macd = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    same(out["apply_amt_macd"], macd)
    same(out["apply_amt_macd_signal"], macd.ewm(span=9, adjust=False).mean())


def test_market_zscore_keeps_small_noise_on_a_large_level(spark):
    r = np.random.default_rng(3)
    values = {k: 1e9 + r.normal(size=12) for k in "abc"}
    df = series(spark, [0])
    df = df.limit(0)
    for k, v in values.items():
        df = df.unionByName(series(spark, v, k))
    out = M.market_30d(df, ("apply_amt",)).toPandas().sort_values([D, K])
    for day, rows in enumerate(out.groupby(D, sort=True)):
        past = np.concatenate([v[:day] for v in values.values()])
        for _, row in rows[1].iterrows():
            want = (row["apply_amt"] - past.mean()) / past.std(ddof=1) if len(past) > 1 else None
            got = row["apply_amt_market_zscore_30d"]
            assert (got is None or np.isnan(got)) if want is None else abs(got - want) < 1e-3


def test_historical_percentile_of_a_long_history(spark):
    out = M.add_historical_percentile(series(spark, range(700)), ("apply_amt",)).orderBy(D).collect()
    assert [r["apply_amt_historical_percentile_7"] for r in out] == [0.5] + [1.0] * 699


def test_unequal_counts_raise_through_the_score(spark):
    actual = series(spark, [1, 2, 3])
    pred = series(spark, [1, 2]).select(K, D, F.col("apply_amt").alias("apply_amt_pred"), F.col("redeem_amt").alias("redeem_amt_pred"))
    with pytest.raises(Exception, match="row counts differ"):
        ME.competition_score(ME.align_by_position(actual, pred)).collect()
    same_rows = series(spark, [1, 2, 4]).select(K, D, F.col("apply_amt").alias("apply_amt_pred"), F.col("redeem_amt").alias("redeem_amt_pred"))
    score = ME.competition_score(ME.align_by_position(actual, same_rows)).first()
    assert abs(score["apply_amt_wmape"] - 1 / 6) < 1e-12 and score["redeem_amt_wmape"] == 0


def answers(spark, texts):
    rows = [("110000", kind, t) for kind, t in texts]
    return spark.createDataFrame(rows, f"{K} string, kind string, response string")


def test_parser_is_strict_and_takes_long_texts(spark):
    long = '{"momentum_factor": 0.9, "investor_type": "' + 'x\\"' * 50_000 + '"}'
    cases = {
        "long": (long, "0.9"),
        "single quotes": ("{'momentum_factor': 0.9}", None),
        "two objects": ('{"momentum_factor": 0.9} and {"momentum_factor": 0.8}', None),
        "prose": ('Answer:\n{"momentum_factor": 0.9}\nbye', "0.9"),
        "nested": ('{"momentum_factor": 0.9, "more": {"a": [1, 2]}}', "0.9"),
        "none": (None, None),
        "no braces": ("0.9", None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, response string")
    got = {r[0]: r[1] for r in df.select("name", AT.extract_json_map(F.col("response"))["momentum_factor"]).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_defaults_complete_a_kind_before_the_next_one(spark):
    funds = series(spark, range(8), "110000")
    texts = [("behavior", '{"concentration_risk": 0.9, "flow_stability": 0.8}'), ("risk", '{"tail_risk_level": 0.7, "note": "n"}')]
    vectors = spark.createDataFrame([("110000", [float(i) for i in range(64)])], f"{K} string, embedding array<double>")
    row = AT.attributes_from_responses(funds, answers(spark, texts), vectors).first()
    assert (row["concentration_risk"], row["flow_stability"], row["tail_risk_level"]) == (0.3, 0.8, 1.0)  # a level is at least 1
    assert row["extra"] == {"note": "n"} and row["embed_3"] == 3.0
    few = AT.attributes_from_responses(series(spark, range(6), "110000"), answers(spark, texts), vectors).first()
    assert (few["flow_stability"], few["extra"], few["embed_3"]) != (0.8, {"note": "n"}, 3.0) and few["embed_3"] == 0.0


def test_quantiles_with_ties(spark):
    r = np.random.default_rng(0)
    x = np.where(r.random(30_000) < 0.6, 0.0, r.normal(size=30_000))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    row = exact_quantiles(df, ["x"], probs).first()
    for p in probs:
        assert abs(row[quantile_name("x", p)] - np.quantile(x, p)) < 1e-12


def test_cache_computes_missing_keys_only(spark, tmp_path):
    asked = []

    def compute(keys):
        asked.append(sorted(r[0] for r in keys.collect()))
        return keys.withColumn("v", F.lit(1.0))

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], f"{K} string")
    cache = IO.FeatureCache(spark, str(tmp_path / "cache"))
    assert not cache.covers(keys("a"))
    assert cache.get_or_compute(keys("a", "b"), compute).count() == 2
    assert cache.covers(keys("b")) and not cache.covers(keys("b", "c"))
    assert cache.get_or_compute(keys("b", "c"), compute).count() == 2
    assert cache.get_or_compute(keys("a", "c"), compute).count() == 2
    assert asked == [["a", "b"], ["c"]]
    (tmp_path / "cache" / "part-broken.parquet").write_text("broken")
    with pytest.raises(Exception):
        cache.get_or_compute(keys("a", "d"), compute)


def test_sinks_round_trip(spark, tmp_path):
    flows = series(spark, [1, 2, 3], "000123")
    IO.write_enriched(flows, str(tmp_path / "csv"))
    back = IO.load_flows(spark, str(tmp_path / "csv"), "csv").select(flows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flows.collect()))
    fc = flows.select(K, D, F.col("apply_amt").alias("apply_amt_pred"), F.col("redeem_amt").alias("redeem_amt_pred"))
    IO.write_submission(fc, str(tmp_path / "sub"), "date")
    rows = spark.read.option("header", True).csv(str(tmp_path / "sub")).orderBy("date").collect()
    assert [(r["fund_code"], r["date"], float(r["apply_amt_pred"])) for r in rows] == [
        ("000123", f"2024010{k}", float(k)) for k in (1, 2, 3)
    ]
