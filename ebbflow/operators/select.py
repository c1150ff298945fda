"""Feature validation and selection (V1-V8).

Every statistic is one distributed aggregate over the wide table; only the
per-column report (a few numbers per column) reaches the driver, because the
*set of columns* of the next plan depends on it.

V2 needs pairwise-complete Pearson correlations for every column pair.
Columns are first shifted by their global mean (one aggregate, broadcast),
then each partition reduces its rows to Gram-style moment matrices
(n, sum x, sum y, sum x^2, sum y^2, sum xy per pair, NULL-aware) with numpy
inside ``mapInPandas``; a ``groupBy(i, j).sum`` merges them.  The shuffle
carries p^2/2 rows per partition, independent of the row count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.functions.exprs import sample_corr
from ebbflow.operators.clean import numeric_columns
from ebbflow.schema import D, K, TARGETS

CORE = (K, D)


def candidate_columns(df: DataFrame, targets=TARGETS) -> list[str]:
    return numeric_columns(df, exclude=(K, D, *targets))


def _long(wide: DataFrame, cols, fields) -> DataFrame:
    """One-row ``{c}__{field}`` frame -> long (column, field...) frame."""
    structs = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields]) for c in cols
    ]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# ------------------------------------------------------------------------- V1
def constant_report(df: DataFrame, cols=None) -> DataFrame:
    """(column, is_constant): at most one distinct non-null value (min = max or all NULL)."""
    cols = list(cols or candidate_columns(df))
    wide = df.agg(
        *[
            F.coalesce(F.min(F.col(f"`{c}`")) == F.max(F.col(f"`{c}`")), F.lit(True)).alias(f"{c}__is_constant")
            for c in cols
        ]
    )
    return _long(wide, cols, ["is_constant"])


# ------------------------------------------------------------------------- V3
def missing_report(df: DataFrame, cols=None) -> DataFrame:
    cols = list(cols or candidate_columns(df))
    wide = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"{c}__missing_ratio") for c in cols])
    return _long(wide, cols, ["missing_ratio"])


# ------------------------------------------------------------------------- V4
def variance_report(df: DataFrame, cols=None) -> DataFrame:
    cols = list(cols or candidate_columns(df))
    wide = df.agg(*[F.var_samp(F.col(f"`{c}`")).alias(f"{c}__variance") for c in cols])
    return _long(wide, cols, ["variance"])


# ------------------------------------------------------------------------- V2
MOMENT_SCHEMA = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("n", T.DoubleType()),
        T.StructField("sx", T.DoubleType()),
        T.StructField("sy", T.DoubleType()),
        T.StructField("sxx", T.DoubleType()),
        T.StructField("syy", T.DoubleType()),
        T.StructField("sxy", T.DoubleType()),
    ]
)


def _moments_fn(p: int):
    iu, ju = np.triu_indices(p, k=1)

    def run(batches):
        acc = None
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64", na_value=np.nan)
            m = (~np.isnan(x)).astype("float64")
            x0 = np.where(m > 0, x, 0.0)
            parts = (m.T @ m, x0.T @ m, m.T @ x0, (x0 * x0).T @ m, m.T @ (x0 * x0), x0.T @ x0)
            acc = parts if acc is None else tuple(a + b for a, b in zip(acc, parts))
        if acc is None:
            return
        n, sx, sy, sxx, syy, sxy = acc
        yield pd.DataFrame(
            {
                "i": iu.astype("int32"),
                "j": ju.astype("int32"),
                "n": n[iu, ju],
                "sx": sx[iu, ju],
                "sy": sy[iu, ju],
                "sxx": sxx[iu, ju],
                "syy": syy[iu, ju],
                "sxy": sxy[iu, ju],
            }
        )

    return run


def pairwise_correlations(df: DataFrame, cols) -> DataFrame:
    """(col_i, col_j, n, corr) for i < j, pairwise-complete, NULL when undefined."""
    cols = list(cols)
    p = len(cols)
    if p < 2:
        return df.sparkSession.createDataFrame([], "col_i string, col_j string, n double, corr double")
    means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{k}") for k, c in enumerate(cols)])
    shifted = df.crossJoin(F.broadcast(means)).select(
        *[(F.col(f"`{c}`").cast("double") - F.coalesce(F.col(f"m{k}"), F.lit(0.0))).alias(f"c{k}") for k, c in enumerate(cols)]
    )
    mom = shifted.mapInPandas(_moments_fn(p), MOMENT_SCHEMA).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    corr = F.when((n > F.lit(1)) & (vx > F.lit(0)) & (vy > F.lit(0)), cov / F.sqrt(vx * vy))
    names = F.array(*[F.lit(c) for c in cols])
    return mom.select(
        F.element_at(names, F.col("i") + 1).alias("col_i"),
        F.element_at(names, F.col("j") + 1).alias("col_j"),
        n.alias("n"),
        # greatest/least skip NULL, so clamp only defined correlations
        F.when(corr.isNotNull(), F.least(F.greatest(corr, F.lit(-1.0)), F.lit(1.0))).alias("corr"),
    )


def correlated_columns(df: DataFrame, cols, threshold: float = 0.95) -> DataFrame:
    """(column): j is dropped if some earlier column i has |corr(i, j)| > threshold.

    Not greedy, as the reference: i may itself be dropped.
    """
    pc = pairwise_correlations(df, cols)
    return pc.where(F.abs("corr") > F.lit(threshold)).select(F.col("col_j").alias("column")).distinct()


# ------------------------------------------------------------------------- V6
def feature_scores(df: DataFrame, cols=None, targets=TARGETS) -> DataFrame:
    """(column, score): variance x (1 + max |corr with a target|), NaN corr as 0."""
    cols = list(cols or candidate_columns(df, targets))
    aggs = []
    for c in cols:
        aggs.append(F.var_samp(F.col(f"`{c}`")).alias(f"{c}__var"))
        for t in targets:
            aggs.append(F.abs(sample_corr(F.col(f"`{c}`"), F.col(t))).alias(f"{c}__c_{t}"))
    wide = df.agg(*aggs)
    fields = ["var"] + [f"c_{t}" for t in targets]
    long = _long(wide, cols, fields)
    best = F.greatest(*[F.coalesce(F.col(f"c_{t}"), F.lit(0.0)) for t in targets], F.lit(0.0))
    return long.select("column", (F.col("var") * (F.lit(1.0) + best)).alias("score"))


def top_k_features(df: DataFrame, k: int = 200, targets=TARGETS) -> DataFrame:
    """V6: keep key, date, targets and the k best-scored numeric features."""
    scores = feature_scores(df, targets=targets)
    best = [r["column"] for r in scores.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "column").limit(k).collect()]
    keep = [c for c in CORE + tuple(targets) if c in df.columns] + best
    return df.select(*[F.col(f"`{c}`") for c in keep])


# ------------------------------------------------------------------------- V7
def stage_report(before: DataFrame | list[str], after: DataFrame) -> DataFrame:
    """(column, null_ratio, inf_count, is_constant, flagged) for columns a stage added."""
    old = set(before if isinstance(before, list) else before.columns)
    new = [c for c in numeric_columns(after) if c not in old]
    if not new:
        return after.sparkSession.createDataFrame(
            [], "column string, null_ratio double, inf_count bigint, is_constant boolean, flagged boolean"
        )
    aggs = []
    for c in new:
        x = F.col(f"`{c}`").cast("double")
        aggs += [
            F.avg(x.isNull().cast("double")).alias(f"{c}__null_ratio"),
            F.sum((F.abs(x) == F.lit(float("inf"))).cast("bigint")).alias(f"{c}__inf_count"),
            F.coalesce(F.min(x) == F.max(x), F.lit(True)).alias(f"{c}__is_constant"),
        ]
    long = _long(after.agg(*aggs), new, ["null_ratio", "inf_count", "is_constant"])
    return long.withColumn("flagged", F.col("null_ratio") > F.lit(0.5))


# ------------------------------------------------------------------- V1-V5
def validate_and_select(df: DataFrame, threshold: float = 0.95, max_missing: float = 0.8,
                        min_variance: float = 1e-8, max_features: int = 500, targets=TARGETS):
    """V1-V5 in the reference order; returns (selected frame, report rows as dicts)."""
    report = []
    cols = candidate_columns(df, targets)
    if cols:
        # the per-column statistics do not depend on which other columns stay: one aggregate has them all
        x = {c: F.col(f"`{c}`") for c in cols}
        stats = df.agg(
            F.array(*[F.coalesce(F.min(x[c]) == F.max(x[c]), F.lit(True)) for c in cols]).alias("constant"),
            F.array(*[F.avg(x[c].isNull().cast("double")) for c in cols]).alias("missing"),
            F.array(*[F.var_samp(x[c]) for c in cols]).alias("variance"),
        ).first()
        const = [c for c, flag in zip(cols, stats["constant"]) if flag]
        left = [c for c in cols if c not in set(const)]
        corr = {r["column"] for r in correlated_columns(df, left, threshold).collect()} if len(left) > 1 else set()
        miss = {c for c, m in zip(cols, stats["missing"]) if m is not None and m > max_missing}
        low = {c for c, v in zip(cols, stats["variance"]) if v is not None and v < min_variance}
        report += [{"column": c, "reason": "constant"} for c in const]
        report += [{"column": c, "reason": "correlated"} for c in sorted(corr)]
        left = [c for c in left if c not in corr]
        report += [{"column": c, "reason": "missing"} for c in left if c in miss]
        left = [c for c in left if c not in miss]
        report += [{"column": c, "reason": "low_variance"} for c in left if c in low]
        df = df.drop(*[r["column"] for r in report])
    final = candidate_columns(df, targets)
    if len(final) > max_features:
        report.append({"column": "*", "reason": f"warning: {len(final)} features > {max_features}"})
    return df, report


# ------------------------------------------------------------------------- V8
class TrainScaler:
    """V8: standard scaling fitted on training rows (population std, as sklearn)."""

    def __init__(self):
        self.stats: DataFrame | None = None
        self.cols: list[str] = []

    def fit(self, train: DataFrame, cols) -> "TrainScaler":
        self.cols = list(cols)
        self.stats = train.agg(
            *[
                F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(f"__s_{c}")
                for c in self.cols
            ]
        )
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        j = df.crossJoin(F.broadcast(self.stats))
        cs = set(self.cols)
        out = []
        for c in df.columns:
            if c in cs:
                m, s = F.col(f"__s_{c}.mean"), F.col(f"__s_{c}.std")
                scale = F.when(s > F.lit(0), s).otherwise(F.lit(1.0))
                out.append(((F.col(c) - m) / scale).alias(c))
            else:
                out.append(F.col(c))
        return j.select(*out)

