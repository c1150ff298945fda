"""Fits, saves and loads of the models, and the evaluator."""

import math

from frames import frame
from pyspark.sql import functions as F

from ebbflow.operators import models as ML
from ebbflow.schema import D, K


def table(spark):
    days = [f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}" for n in range(84)]
    rows = [(f, d, 100.0 + 10 * math.sin(n) + k, 50.0 + n) for k, f in enumerate("ab") for n, d in enumerate(days)]
    df = frame(spark, rows)
    return df.select("*", F.dayofmonth(D).cast("double").alias("dom"), (F.col("redeem_amt") * 2).alias("twice"), F.col(K).alias("kind"))


def test_saved_models_predict_alike(spark, tmp_path):
    df = table(spark)
    models = {f"{t}_model": ML.fit_target(df, t, kind) for t, kind in (("apply_amt", "gbt"), ("redeem_amt", "linear"))}
    ML.save_models(models, str(tmp_path / "m"))
    back = ML.load_models(str(tmp_path / "m"))
    for t in ("apply_amt", "redeem_amt"):
        a, b = (ML.predict(m[f"{t}_model"], df, t).orderBy(K, D).select(f"{t}_pred").collect() for m in (models, back))
        assert a == b and len(a) == 168
    scored = ML.predict(back["redeem_amt_model"], df, "redeem_amt")
    judge = ML.WmapeEvaluator("redeem_amt", "redeem_amt_pred")
    assert judge.isLargerBetter() and judge.evaluate(scored) > 0.95


def test_walk_forward_scores(spark):
    rows = ML.walk_forward_scores(table(spark), "redeem_amt", window=40, step=7, folds=(0, 2)).orderBy("fold").collect()
    assert [r["fold"] for r in rows] == [0, 2] and all(0 < r["n"] <= 14 and r["wmape"] >= 0 for r in rows)  # the calendar has gaps
