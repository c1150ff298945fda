"""One saved object for a predict-only run (S10, E2): preparation and a regressor per target.

``FlowEstimator.fit`` learns what the training run decides from its data: which columns are
kept (V1-V5), clip bounds and medians of numbers, modes and seen values of text columns
(C8-C11), and a regressor per target.  ``FlowModel`` holds all of it, so a later run on new
rows builds the same inputs whatever these rows look like, and survives
``write().save`` / ``FlowModel.load``.  Loading fails if the regressor of a target is missing.

Statistics are one row for each column; seen values are kept as a table and joined, as there may
be many.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.functions.exprs import finite_or_null
from ebbflow.functions.quantiles import exact_quantiles, quantile_name
from ebbflow.operators import clean as C
from ebbflow.operators import models as ML
from ebbflow.operators import select as SEL
from ebbflow.schema import FlowConfig
from ebbflow.session import cut_lineage

LOW, MID, HIGH = 0.01, 0.5, 0.99
UNKNOWN = "unknown"
STATS = "name string, kind string, low double, mid double, high double, mode string"
SEEN = "name string, value string"


class FlowEstimator(Estimator):
    """Fits the preparation and a regressor of ``kind`` per target on a feature table, which is read several times: a written one."""

    def __init__(self, kind: str = "gbt", cfg: FlowConfig = FlowConfig(), select: bool = True):
        super().__init__()
        self.kind, self.cfg, self.select = kind, cfg, select

    def _fit(self, dataset: DataFrame) -> FlowModel:
        cfg = self.cfg
        train = dataset
        if self.select:
            train, _ = SEL.validate_and_select(
                dataset, cfg.max_correlation, cfg.max_missing_ratio, cfg.min_variance, cfg.max_feature_count, cfg.targets
            )
        stats, seen = preparation(train, cfg.targets)
        names = [r["name"] for r in stats.collect()]  # one for each feature column
        model = FlowModel(names, list(cfg.targets), stats, seen, {})
        ready = cut_lineage(model.prepared(train, keep=cfg.targets))  # every pass of the fits reads it
        for t in cfg.targets:
            model.regressors[t] = ML.fit_target(C.floor_target_drop_nulls(ready.select(*names, t), t), t, self.kind, cfg.targets)
        return model


def preparation(train: DataFrame, targets) -> tuple[DataFrame, DataFrame]:
    """(STATS of every feature column in order, SEEN values of the text columns)."""
    spark = train.sparkSession
    names = C.feature_columns(train, targets)
    floats, numbers = set(C.float_columns(train)), set(C.numeric_columns(train))
    texts = [c for c in names if c in set(C.string_columns(train))]
    nums = [c for c in names if c in numbers]
    finite = C.nulls_for_nonfinite(train.select(*nums), [c for c in nums if c in floats]) if nums else None
    q = exact_quantiles(finite, nums, [LOW, MID, HIGH]).first() if nums else {}
    modes = C.train_modes(train, texts).first() if texts else {}
    rows = []
    for c in names:
        if c in texts:
            rows.append((c, "text", None, None, None, modes[c] if modes[c] is not None else UNKNOWN))
        elif c in numbers:
            low, high = (q[quantile_name(c, p)] if c in floats else None for p in (LOW, HIGH))
            rows.append((c, "number", low, q[quantile_name(c, MID)] or 0.0, high, None))
    parts = [train.select(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")).where("value IS NOT NULL").distinct() for c in texts]
    seen = spark.createDataFrame([], SEEN)
    for p in parts:
        seen = seen.unionByName(p)
    return spark.createDataFrame(rows, STATS), cut_lineage(seen)


class FlowModel(Model, MLWritable, MLReadable):
    """The fitted preparation and regressors; ``transform`` adds ``{target}_pred`` to rows with the kept columns."""

    def __init__(self, names: list[str], targets: list[str], stats: DataFrame, seen: DataFrame, regressors: dict[str, PipelineModel]):
        super().__init__()
        self.names, self.targets, self.seen, self.regressors = names, targets, seen, regressors
        self.stats = {r["name"]: r for r in stats.collect()}  # one row for each feature column

    def prepared(self, df: DataFrame, keep=()) -> DataFrame:
        """The kept columns, clipped and filled, beside the columns ``keep``; a kept column that is absent is an error."""
        missing = [c for c in self.names if c not in df.columns]
        if missing:
            raise ValueError(f"columns that the model was fitted on are missing: {missing[:5]}")
        out, texts = [], []
        for c in self.names:
            s, x = self.stats[c], F.col(f"`{c}`")
            if s["kind"] == "text":
                texts.append(c)
            else:
                if s["low"] is not None:
                    x = finite_or_null(x)
                    x = F.when(x < s["low"], F.lit(s["low"])).when(x > s["high"], F.lit(s["high"])).otherwise(x)
                x = F.coalesce(x.cast("double"), F.lit(s["mid"]))
            out.append(x.alias(c))
        rows = df.select(*[F.col(f"`{c}`") for c in keep if c not in self.names], *out)
        for c in texts:
            known = self.seen.where(F.col("name") == c).select(F.col("value").alias(c), F.lit(True).alias("__known"))
            rows = rows.join(known, c, "left")
            rows = rows.withColumn(c, F.when(F.col("__known"), F.col(c)).otherwise(F.lit(self.stats[c]["mode"]))).drop("__known")
        return rows

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """All columns as they came, and a prediction per target (made from the prepared columns)."""
        rows = dataset.select(F.struct("*").alias("__row"), *dataset.columns)
        rows = self.prepared(rows, keep=["__row"])
        for t in self.targets:
            rows = self.regressors[t].transform(rows).select(*rows.columns, f"{t}_pred")
        given = [F.col(f"__row.`{c}`").alias(c) for c in dataset.columns if c not in {f"{t}_pred" for t in self.targets}]
        return rows.select(*given, *[f"{t}_pred" for t in self.targets])

    def write(self) -> MLWriter:
        return FlowModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return FlowModelReader()


class FlowModelWriter(MLWriter):
    def __init__(self, model: FlowModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, SparkSession.active()
        path = path.rstrip("/")
        about = json.dumps({"names": m.names, "targets": m.targets})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{path}/about")
        spark.createDataFrame([tuple(m.stats[c]) for c in m.names], STATS).coalesce(1).write.parquet(f"{path}/stats")
        m.seen.write.parquet(f"{path}/seen")
        for t, regressor in m.regressors.items():
            regressor.write().save(f"{path}/{t}_model")


class FlowModelReader(MLReader):
    def load(self, path: str) -> FlowModel:
        spark, path = SparkSession.active(), path.rstrip("/")
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        regressors = {}
        for t in about["targets"]:
            try:
                regressors[t] = PipelineModel.load(f"{path}/{t}_model")
            except Exception as e:  # the reader's errors differ by file system
                raise ValueError(f"{path} holds no usable model of target {t}") from e
        stats, seen = spark.read.schema(STATS).parquet(f"{path}/stats"), spark.read.schema(SEEN).parquet(f"{path}/seen")
        return FlowModel(about["names"], about["targets"], stats, seen, regressors)
