"""Regression models per target (M4-M6, S10) on MLlib.

The AutoML stack of the reference is re-aimed to MLlib estimators that
train distributed: gradient-boosted trees, random forest and linear
regression behind one ``Pipeline`` (string indexing + vector assembly).
M5's stacking becomes out-of-fold predictions over time blocks (no look
ahead) and a non-negative blend weight grid scored by WMAPE.
"""

from __future__ import annotations

import itertools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.operators.metrics import wmape_global_expr
from ebbflow.operators.split import walk_forward_folds
from ebbflow.schema import D, K, TARGETS


def _features(df: DataFrame, target: str, targets=TARGETS):
    drop = {K, D, *targets}
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)):
            num.append(f.name)
    return num, cat


def make_estimator(kind: str, label: str, seed: int = 42):
    if kind == "gbt":
        return GBTRegressor(labelCol=label, featuresCol="features", maxIter=40, maxDepth=5, seed=seed)
    if kind == "gbt_abs":  # absolute error and row sampling: the second boosted variant
        return GBTRegressor(
            labelCol=label, featuresCol="features", lossType="absolute", maxIter=40, maxDepth=5, subsamplingRate=0.8, seed=seed
        )
    if kind == "rf":
        return RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=300, maxDepth=8, seed=seed)
    if kind == "linear":
        return LinearRegression(labelCol=label, featuresCol="features", regParam=0.1, elasticNetParam=0.0)
    raise ValueError(kind)


def build_pipeline(df: DataFrame, target: str, kind: str = "gbt", targets=TARGETS) -> Pipeline:
    num, cat = _features(df, target, targets)
    stages = [
        StringIndexer(inputCol=c, outputCol=f"__idx_{c}", handleInvalid="keep") for c in cat
    ]
    stages.append(
        VectorAssembler(inputCols=num + [f"__idx_{c}" for c in cat], outputCol="features", handleInvalid="keep")
    )
    stages.append(make_estimator(kind, target).setPredictionCol(f"{target}_pred"))
    return Pipeline(stages=stages)


def fit_target(train: DataFrame, target: str, kind: str = "gbt", targets=TARGETS) -> PipelineModel:
    """M4: one fitted pipeline per target."""
    return build_pipeline(train, target, kind, targets).fit(train)


def predict(model: PipelineModel, df: DataFrame, target: str) -> DataFrame:
    """M6: batch prediction; keeps the key, date and every input column."""
    out = model.transform(df)
    keep = [c for c in df.columns] + [f"{target}_pred"]
    return out.select(*keep)


class WmapeEvaluator(Evaluator):
    """1 - WMAPE over all rows; larger is better, so it fits Spark's tuning classes."""

    def __init__(self, label: str, prediction: str):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        wmape = dataset.agg(wmape_global_expr(self.label, self.prediction).alias("w")).first()["w"]
        return 1.0 - wmape

    def isLargerBetter(self) -> bool:
        return True


def walk_forward_scores(df: DataFrame, target: str, kind: str = "linear", window: int = 90, step: int = 7,
                        folds: tuple[int, ...] | None = None, targets=TARGETS) -> DataFrame:
    """M3: (fold, n, wmape) of a model trained on each fold's window and scored on the days after it.

    ``folds`` names the folds to fit; by default every one, each a fit of its own.
    """
    rows = walk_forward_folds(df, window, step)
    if folds is None:
        last = rows.agg(F.max("fold")).first()[0]
        folds = tuple(range(0 if last is None else last + 1))
    parts = []
    for f in folds:
        fold = rows.where(F.col("fold") == F.lit(f))
        train = fold.where(F.col("role") == "train").drop("fold", "role")
        test = fold.where(F.col("role") == "test").drop("fold", "role")
        if test.isEmpty() or train.isEmpty():
            continue
        scored = fit_target(train, target, kind, targets).transform(test)
        parts.append(
            scored.agg(F.lit(f).alias("fold"), F.count(F.lit(1)).alias("n"), wmape_global_expr(target, f"{target}_pred").alias("wmape"))
        )
    out = df.sparkSession.createDataFrame([], "fold int, n long, wmape double")
    for p in parts:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------------ M5
def time_block_folds(df: DataFrame, k: int = 5, date: str = D) -> DataFrame:
    """Fold id by date blocks of equal day span (no look-ahead inside a block)."""
    span = df.agg(F.min(date).alias("__d0"), F.max(date).alias("__d1"))
    days = F.datediff(F.col("__d1"), F.col("__d0")) + F.lit(1)
    fold = F.least(F.floor(F.datediff(F.col(date), F.col("__d0")) * F.lit(k) / days), F.lit(k - 1)).cast("int")
    return df.crossJoin(F.broadcast(span)).withColumn("fold", fold).drop("__d0", "__d1")


def out_of_fold(df: DataFrame, target: str, kinds=("gbt", "rf", "linear"), k: int = 5) -> DataFrame:
    """Out-of-fold predictions of each model kind for fold f, trained on earlier folds only.

    Fold 0 has no earlier data and gets no prediction.
    """
    folded = time_block_folds(df, k)
    parts = []
    for f in range(1, k):
        train = folded.where(F.col("fold") < F.lit(f)).drop("fold")
        test = folded.where(F.col("fold") == F.lit(f)).drop("fold")
        preds = test.select(K, D, target)
        for kind in kinds:
            m = fit_target(train, target, kind)
            p = m.transform(test).select(K, D, F.col(f"{target}_pred").alias(f"pred_{kind}"))
            preds = preds.join(p, [K, D])
        parts.append(preds)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blend_weights(oof: DataFrame, target: str, kinds=("gbt", "rf", "linear"), step: float = 0.1) -> DataFrame:
    """Non-negative weights summing to 1 on a grid, scored by WMAPE on out-of-fold rows (one aggregate)."""
    n = int(round(1 / step))
    grid = [w for w in itertools.product(range(n + 1), repeat=len(kinds)) if sum(w) == n]
    # evaluate every grid point in one pass: stack the blends
    rows = []
    for g in grid:
        blend = sum((F.lit(wi / n) * F.col(f"pred_{k}") for wi, k in zip(g, kinds)), F.lit(0.0))
        rows.append(F.struct(*[F.lit(wi / n).alias(f"w_{k}") for wi, k in zip(g, kinds)], blend.alias("__b")))
    long = oof.select(target, F.explode(F.array(*rows)).alias("r")).select(target, "r.*")
    scored = long.groupBy(*[f"w_{k}" for k in kinds]).agg(wmape_global_expr(target, "__b").alias("wmape"))
    return scored.orderBy("wmape", *[F.desc(f"w_{k}") for k in kinds]).limit(1)


# ------------------------------------------------------------------------ S10
def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for name, m in models.items():
        m.write().overwrite().save(f"{path.rstrip('/')}/{name}")


def load_models(path: str, targets=TARGETS) -> dict[str, PipelineModel]:
    """Load one model per target; fail when one is missing."""
    out = {}
    for t in targets:
        out[f"{t}_model"] = PipelineModel.load(f"{path.rstrip('/')}/{t}_model")
    return out
