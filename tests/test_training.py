"""Fits over folds, ensembles, boosted trees, saved bundles and the recursion, against plain numpy and Python."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from frames import frame
from pyspark.sql import functions as F

from ebbflow.operators import boosting as BO
from ebbflow.operators import bundle as BU
from ebbflow.operators import ensemble as EN
from ebbflow.operators import normal_eq as NE
from ebbflow.operators import recursion as RE
from ebbflow.schema import D, K, TARGETS, FlowConfig

START = dt.date(2024, 1, 1)
X = ["a", "b", "flat", "far"]


def flows(spark, n_days=150, funds=("f1", "f2", "f3"), seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for k, f in enumerate(funds):
        level = 1000.0 * (k + 1)
        for n in range(n_days - 11 * k):
            day = START + dt.timedelta(days=n + (3 if n > 60 and k else 0))
            amount = level * (1 + 0.3 * math.sin(n / 7)) + r.normal(0, level / 20)
            rows.append((f, day, float(max(amount, 1)), float(max(amount / 2 + r.normal(0, level / 10), 0))))
    return frame(spark, rows)


def with_x(df):
    n = F.datediff(D, F.lit(START))
    noise = F.pmod(F.xxhash64(K, D), F.lit(1000)) / 1000.0
    return df.select("*", (n % 13 + noise).alias("a"), F.sin(n / 5.0).alias("b"), F.lit(7.0).alias("flat"), (F.lit(1e6) + n).cast("double").alias("far"))


def ridge_by_hand(x, y, l2):
    mean, sd = x.mean(0), x.std(0)
    live = sd > 1e-7 * np.sqrt((x**2).mean(0))
    z = (x[:, live] - mean[live]) / sd[live]
    coef = np.zeros(x.shape[1])
    coef[live] = np.linalg.solve(z.T @ z / len(y) + l2 * np.eye(live.sum()), z.T @ (y - y.mean()) / len(y)) / sd[live]
    return y.mean() - coef @ mean, coef


# ------------------------------------------------------------------------- M3
@pytest.mark.parametrize("window, step", [(90, 7), (28, 7), (20, 9)])
def test_every_fold_equals_its_own_fit(spark, window, step):
    df = with_x(flows(spark))
    got = {r["fold"]: (r["n"], r["wmape"]) for r in NE.walk_forward_scores(df, X, "apply_amt", window, step).collect()}
    p = df.toPandas()
    p["n"] = (pd.to_datetime(p[D]) - pd.Timestamp(START)).dt.days
    want = {}
    for f in itertools.count():
        first = f * step
        if first + window > p["n"].max():
            break
        train = p[(p["n"] >= first) & (p["n"] < first + window)]
        test = p[(p["n"] >= first + window) & (p["n"] < first + window + step)]
        b0, b = ridge_by_hand(train[X].to_numpy(), train["apply_amt"].to_numpy(), NE.RIDGE)
        error = abs(test["apply_amt"] - (b0 + test[X].to_numpy() @ b)).sum() / test["apply_amt"].sum()
        want[f] = (len(test), pytest.approx(error, rel=1e-6))
    assert len(want) >= 5 and got == want


def test_chunks_nulls_and_empty(spark, monkeypatch):
    df = with_x(flows(spark))
    whole = sorted(map(tuple, NE.walk_forward_scores(df, X, "apply_amt").collect()))
    monkeypatch.setattr(NE, "CHUNK_ROWS", 5)
    cut = sorted(map(tuple, NE.walk_forward_scores(df, X, "apply_amt").collect()))
    assert [w[:2] for w in whole] == [c[:2] for c in cut] and np.allclose([w[2] for w in whole], [c[2] for c in cut])
    holes = df.withColumn("a", F.when(F.dayofmonth(D) == 3, F.lit(float("nan"))).when(F.dayofmonth(D) != 4, F.col("a")))
    assert NE.walk_forward_scores(holes, X, "apply_amt").count() == len(whole)
    assert NE.walk_forward_scores(df.limit(0), X, "apply_amt").collect() == []


# ------------------------------------------------------------------------- M5
def test_bagged_predictions_leave_their_fold_out(spark):
    df = with_x(flows(spark))
    models, oof = NE.bagged(df, X, "apply_amt", 4)
    got = oof.select(*X, "apply_amt", "apply_amt_oof", NE.hash_fold(4).alias("fold")).toPandas()
    for f in range(4):
        train, test = got[got["fold"] != f], got[got["fold"] == f]
        b0, b = ridge_by_hand(train[X].to_numpy(), train["apply_amt"].to_numpy(), NE.RIDGE)
        assert np.allclose(test["apply_amt_oof"], b0 + test[X].to_numpy() @ b)
    mean = NE.predicted(df.withColumn("fold", F.lit(0)), NE.mean_model(models), X, "p").select("p").toPandas()["p"]
    each = [NE.predicted(df.withColumn("fold", F.lit(f)), models, X, "p").select("p").toPandas()["p"] for f in range(4)]
    assert np.allclose(np.sort(mean), np.sort(np.mean(each, axis=0)))


def greedy(y, p, rounds):
    picks, best = np.zeros(p.shape[1], int), (None, math.inf)
    for k in range(1, rounds + 1):
        scores = [np.abs(y - (p @ picks + p[:, c]) / k).sum() / np.abs(y).sum() for c in range(p.shape[1])]
        picks[int(np.argmin(scores))] += 1
        if round(min(scores), EN.DIGITS) < round(best[1], EN.DIGITS):
            best = (picks.tolist(), min(scores))
    return best


def test_greedy_selection(spark):
    r = np.random.default_rng(3)
    y = r.uniform(50, 150, 400)
    p = np.stack([y + r.normal(5, 20, 400), y * 0.8 + 10, np.full(400, 100.0), r.uniform(0, 300, 400)], axis=1)
    rows = [(float(a), *map(float, b)) for a, b in zip(y, p)] + [(None, 1.0, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y double, c0 double, c1 double, c2 double, c3 double").repartition(3)
    picks, score = EN.select_ensemble(df, "y", ["c0", "c1", "c2", "c3"], 12)
    want, best = greedy(y, p, 12)
    assert list(picks.values()) == want and score == pytest.approx(best)
    singles = [np.abs(y - p[:, c]).sum() / y.sum() for c in range(4)]
    assert score < min(singles)
    table = EN.selection_table(df, "y", ["c0", "c1", "c2", "c3"], 12).collect()
    assert sum(t["weight"] for t in table) == pytest.approx(1) and [t["picks"] for t in table] == want


def test_second_level_sees_earlier_blocks_only(spark):
    df = with_x(flows(spark))
    block = F.floor(F.datediff(D, F.lit(START)) / 31)
    out, picks = EN.stacked(df, {"ab": ["a", "b"], "far": ["far"]}, "apply_amt", block, k=5, rounds=8)
    got = out.toPandas()
    p = df.withColumn("block", block).toPandas()
    base = {}
    for name, cols in (("ab", ["a", "b"]), ("far", ["far"])):
        for f in range(1, 5):
            train = p[p["block"] < f]
            b0, b = ridge_by_hand(train[cols].to_numpy(), train["apply_amt"].to_numpy(), NE.RIDGE)
            p.loc[p["block"] == f, f"base_{name}"] = b0 + p.loc[p["block"] == f, cols].to_numpy() @ b
    cols = ["base_ab", "base_far"]
    for f in range(2, 5):
        train = p[(p["block"] >= 1) & (p["block"] < f)]
        b0, b = ridge_by_hand(train[cols].to_numpy(), train["apply_amt"].to_numpy(), NE.RIDGE)
        p.loc[p["block"] == f, "level2"] = b0 + p.loc[p["block"] == f, cols].to_numpy() @ b
    both = got.merge(p[p["block"] >= 2], on=[K, D], suffixes=("", "_w"))
    assert len(both) == len(got) == (p["block"].between(2, 4)).sum()
    for c in (*cols, "level2"):
        assert np.allclose(both[c], both[f"{c}_w"])
    names = [*cols, "level2"]
    assert list(picks.values()) == greedy(got["apply_amt"].to_numpy(), got[names].to_numpy(), 8)[0]
    assert np.allclose(got["ensemble"], got[names].to_numpy() @ list(picks.values()) / sum(picks.values()))


# ------------------------------------------------------------------------- M4
def booster_by_hand(x, y, edges, trees, depth, rate, min_rows):
    """Predictions of the training rows, each tree grown by looking at every cut of every feature."""
    b = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(edges[k], x[:, k], side="left")) for k in range(x.shape[1])], 1)
    score = np.full(len(y), y.mean())
    for _ in range(trees):
        rest, add = y - score, np.zeros(len(y))

        def grow(rows, level):
            add[rows] = rest[rows].mean()
            if level == depth:
                return
            best = (1e-12, None)
            for k in range(b.shape[1]):
                for cut in range(max(len(e) for e in edges) + 1):
                    left, right = rows[b[rows, k] <= cut], rows[b[rows, k] > cut]
                    if len(left) >= min_rows and len(right) >= min_rows:
                        gain = sum(rest[s].sum() ** 2 / len(s) for s in (left, right)) - rest[rows].sum() ** 2 / len(rows)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            if best[1]:
                for side in best[1]:
                    grow(side, level + 1)

        grow(np.arange(len(y)), 0)
        score = score + rate * add
    return score


@pytest.mark.parametrize("keep", [2, 100])
def test_boosted_trees(spark, monkeypatch, keep):
    monkeypatch.setattr(BO, "KEEP", keep)
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (600, 3)).round(2)
    x[::17, 1] = np.nan
    y = np.where(x[:, 0] > 0.3, 10.0, 2.0) + np.nan_to_num(x[:, 1]) ** 2 + r.normal(0, 0.1, 600)
    rows = [(float(t), *(None if np.isnan(v) and k % 2 else float(v) for v in a)) for k, (t, a) in enumerate(zip(y, x))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0)], "y double, p double, q double, r double").repartition(4)
    booster = BO.fit_boosted(df, ["p", "q", "r"], "y", trees=5, depth=3, min_rows=10, bins=16)
    got = booster.transform(df.where("y is not null"), "score").toPandas()
    order = np.lexsort((got["r"], got["p"], got["y"]))
    want = booster_by_hand(x, y, [np.array(e) for e in booster.edges], 5, 3, 0.1, 10)
    assert np.allclose(got["score"].to_numpy()[order], want[np.lexsort((x[:, 2], x[:, 0], y))])
    assert len(booster.trees) == 5


def test_boosted_trees_without_rows_or_cuts(spark):
    df = spark.createDataFrame([], "y double, p double")
    booster = BO.fit_boosted(df, ["p"], "y", trees=2)
    assert booster.trees == [] and booster.transform(df, "s").collect() == []
    same = spark.createDataFrame([(3.0, None), (5.0, None)], "y double, p double")
    assert [r["s"] for r in BO.fit_boosted(same, ["p"], "y", trees=2).transform(same, "s").collect()] == [4.0, 4.0]


# ------------------------------------------------------------------------ S10
def feature_table(spark):
    return with_x(flows(spark)).withColumn("kind", F.when(F.col(K) != "f3", F.col(K)))


def test_saved_bundle_predicts_alike(spark, tmp_path):
    df = feature_table(spark)
    model = BU.FlowEstimator("linear").fit(df)
    assert "flat" not in model.names and "a" in model.names
    path = str(tmp_path / "bundle")
    model.write().save(path)
    back = BU.FlowModel.load(path)
    new = df.where(F.dayofmonth(D) < 5).withColumn("a", F.when(F.dayofmonth(D) != 2, F.col("a") * 100)).withColumn("kind", F.lit("unseen"))
    a, b = (m.transform(new).orderBy(K, D).collect() for m in (model, back))
    assert a == b and len(a) > 40 and a[0].asDict().keys() == {*new.columns, *(f"{t}_pred" for t in TARGETS)}
    with pytest.raises(ValueError, match="missing"):
        back.transform(new.drop("a"))


def test_bundle_without_a_target_fails(spark, tmp_path):
    model = BU.FlowEstimator("linear", select=False).fit(feature_table(spark))
    model.regressors.pop("redeem_amt")
    model.write().save(str(tmp_path / "half"))
    with pytest.raises(ValueError, match="redeem_amt"):
        BU.FlowModel.load(str(tmp_path / "half"))


# ------------------------------------------------------------------------ F10
SMALL = FlowConfig(lag_periods=(1, 3), rolling_windows=(7,), diff_periods=(1,), ewm_alphas=(0.3,), rsi_periods=(7,), bollinger_windows=(14,))


def recomputed(df, predict, start, n_days):
    """Every day: all features of the whole history anew, the new rows joined to it."""
    out = []
    for i in range(n_days):
        day = start + dt.timedelta(days=i)
        future = df.select(K).distinct().select(K, F.lit(day).alias(D), *[F.lit(None).cast("double").alias(t) for t in TARGETS])
        x = RE.add_model_features(df.unionByName(future), cfg=SMALL).where(F.col(D) == F.lit(day))
        got = [(r[K], day, *[float(max(r[f"{t}_pred"], 0.0)) for t in TARGETS]) for r in predict(x).collect()]
        out += got
        df = df.sparkSession.createDataFrame([*map(tuple, df.collect()), *got], df.schema)
    return sorted(out)


def test_state_equals_features_of_the_whole_history(spark):
    df = flows(spark, 75, ("f1", "f2")).unionByName(flows(spark, 9, ("short",))).unionByName(flows(spark, 1, ("one",)))
    day = START + dt.timedelta(days=90)
    future = df.select(K).distinct().select(K, F.lit(day).alias(D), *[F.lit(None).cast("double").alias(t) for t in TARGETS])
    want = RE.add_model_features(df.unionByName(future)).where(F.col(D) == F.lit(day)).toPandas().set_index(K).sort_index()
    got = RE.state_features(RE.initial_state(df), day).toPandas().set_index(K).sort_index()
    names = RE.feature_names()
    assert set(names) == set(want.columns) - {D, *TARGETS}
    for c in names:
        a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
        assert np.allclose(a, b, rtol=1e-7, atol=1e-7, equal_nan=True), (c, a, b)


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_recursion_equals_recomputing_every_day(spark, kind):
    df = flows(spark, 80)
    start = START + dt.timedelta(days=83)
    table = RE.add_model_features(df, cfg=SMALL).cache()
    if kind == "linear":
        predict = BU.FlowEstimator("linear", select=False).fit(table).transform
    else:
        names = RE.feature_names(cfg=SMALL)
        boosters = {t: BO.fit_boosted(table, names, t, trees=4, depth=3, min_rows=5) for t in TARGETS}

        def predict(x):
            for t, b in boosters.items():
                x = b.transform(x, f"{t}_pred")
            return x

    got = sorted(map(tuple, RE.recursive_model_forecast(df, predict, start, 3, cfg=SMALL).select(K, D, *TARGETS).collect()))
    want = recomputed(df, predict, start, 3)
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == 9
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-6)


def test_recursion_carries_the_last_value(spark):
    df = flows(spark, 40)
    none = lambda x: x.withColumns({f"{t}_pred": F.lit(None).cast("double") for t in TARGETS})
    out = RE.recursive_model_forecast(df, none, START + dt.timedelta(days=50), 2, cfg=SMALL).collect()
    last = {r[K]: r for r in df.orderBy(K, D).collect()}
    assert len(out) == 6 and all(r["apply_amt"] == last[r[K]]["apply_amt"] for r in out)
