"""Linear models for many overlapping training sets from one pass over the rows (M3, M5).

Rows are dealt into parts (a run of days, a hash fold).  A part's moments, the products of
(1, features, target) summed over its rows, are all that ridge regression needs, and the
moments of a union of parts are their sum.  So the table is shuffled once, by part; every
fold then sums the matrices of the parts it trains on and is solved in a task of its
own.  A part with many rows is cut into ``CHUNK_ROWS`` chunks whose moments are summed
alike, so no task holds a part.

The fit is ridge regression on features standardised within the fold (the intercept is
free).  Columns are shifted by their means over the table first, so that the products
stay exact enough; a feature that is constant in a fold gets the coefficient 0.
Rows with a NULL or non-finite feature or target are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.operators.metrics import wmape_global_expr
from ebbflow.schema import D, K

CHUNK_ROWS = 20_000
RIDGE = 0.01
MODEL = "fold long, n_train long, intercept double, coef array<double>"


def _finite(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def _means(df: DataFrame, cols) -> list[float]:
    row = df.agg(*[F.avg(_finite(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [float(x or 0.0) for x in row]


def moments(df: DataFrame, features: list[str], target: str, part: Column, shift: list[float]) -> DataFrame:
    """part, sums (float64 bytes): the summed products of (1, features, target) of each part's chunks."""
    width = len(features) + 2
    values = F.array(*[_finite(c) for c in (*features, target)])
    rows = df.select(part.cast("long").alias("part"), values.alias("v"), F.xxhash64(K, D).alias("h"))
    rows = rows.where(F.col("part").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    most = rows.groupBy("part").count().agg(F.max("count")).first()[0] or 1
    chunks = -(-most // CHUNK_ROWS)

    def run(chunk: pa.Table) -> pa.Table:
        z = np.ones((chunk.num_rows, width))
        flat = chunk.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        z[:, 1:] = flat.reshape(chunk.num_rows, width - 1) - np.array(shift)
        return pa.table({"part": chunk.column("part")[:1], "sums": pa.array([(z.T @ z).tobytes()], pa.binary())})

    dealt = rows.withColumn("chunk", F.pmod("h", F.lit(chunks))).drop("h")
    return dealt.groupBy("part", "chunk").applyInArrow(run, "part long, sums binary")


def solved(used: DataFrame, n_features: int, shift: list[float], l2: float) -> DataFrame:
    """A model (MODEL) for each fold of (fold, sums)."""

    def run(parts: pa.Table) -> pa.Table:
        g = np.zeros((n_features + 2) ** 2)
        for blob in parts.column("sums"):
            g += np.frombuffer(blob.as_py())
        n, intercept, coef = ridge(g.reshape(n_features + 2, -1), np.array(shift), l2)
        row = {"fold": parts.column("fold")[:1], "n_train": pa.array([n]), "intercept": pa.array([intercept])}
        return pa.table(row | {"coef": pa.array([coef.tolist()], pa.list_(pa.float64()))})

    return used.select("fold", "sums").groupBy("fold").applyInArrow(run, MODEL)


def ridge(g: np.ndarray, shift: np.ndarray, l2: float) -> tuple[int, float, np.ndarray]:
    """(rows, intercept, coefficients) from summed products of (1, features, target), each less its shift."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.sqrt(np.maximum(np.diag(g)[1:] / n, 0))
    live = np.flatnonzero(spread[:-1] > 1e-7 * scale[:-1])
    coef = np.zeros(len(mean) - 1)
    if len(live):
        a = cov[np.ix_(live, live)] / np.outer(spread[live], spread[live]) + l2 * np.eye(len(live))
        b = cov[live, -1] / spread[live]
        coef[live] = np.linalg.lstsq(a, b, rcond=1e-12)[0] / spread[live]
    real = mean + shift
    return round(n), float(real[-1] - coef @ real[:-1]), coef


def fit_parts(df: DataFrame, features: list[str], target: str, part: Column, folds: Column, l2: float = RIDGE) -> DataFrame:
    """A model for every fold; ``folds`` is the array of folds that train on a part (column ``part``)."""
    shift = _means(df, [*features, target])
    sums = moments(df, features, target, part, shift)
    return solved(sums.select(F.explode(folds).alias("fold"), "sums"), len(features), shift, l2)


def predicted(df: DataFrame, models: DataFrame, features: list[str], out: str, fold: str = "fold") -> DataFrame:
    """The rows of folds that have a model, with its prediction; NULL features count as 0."""
    x = F.array(*[F.coalesce(_finite(c), F.lit(0.0)) for c in features])
    dot = F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    m = models.select(F.col("fold").alias(fold), "intercept", "coef")
    return df.join(m, fold).withColumn(out, F.col("intercept") + dot).drop("intercept", "coef")


# ------------------------------------------------------------------------- M3
def fold_parts(window: int, step: int, last_fold: int) -> tuple[Column, Column, Column]:
    """(part of a day number, folds that train on a part, fold that tests on a day number).

    Fold f trains on the days from f * step on, ``window`` of them: whole blocks of ``step`` days
    and the head of the next one.  So each block makes two parts, 2 * block for its head and
    2 * block + 1 for the rest.
    """
    whole, head = divmod(window, step)
    day = F.col("__day")
    block = F.floor(day / F.lit(step))
    part = block * 2 + F.when(day % F.lit(step) < F.lit(head), F.lit(0)).otherwise(F.lit(1))
    own = F.floor(F.col("part") / F.lit(2))
    first = own - whole + F.when(F.col("part") % 2 == 0, F.lit(0)).otherwise(F.lit(1))
    first, last = F.greatest(first, F.lit(0)), F.least(own, F.lit(last_fold))
    folds = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))
    test = F.floor((day - F.lit(window)) / F.lit(step))
    return part, folds, F.when((day >= F.lit(window)) & (test <= F.lit(last_fold)), test).cast("long")


def walk_forward(df: DataFrame, features: list[str], target: str, window: int = 90, step: int = 7, l2: float = RIDGE,
                 date: str = D) -> tuple[DataFrame, DataFrame]:
    """M3: (models, scored rows) of every fold; a scored row is tested by the model of the ``window`` days before its fold."""
    span = df.agg(F.min(date).alias("d0"), F.max(date).alias("d1")).first()
    d0 = span["d0"]
    last_fold = -1 if d0 is None else ((span["d1"] - d0).days - window) // step
    days = df.withColumn("__day", F.datediff(F.col(date), F.lit(d0).cast("date")))
    part, folds, test = fold_parts(window, step, last_fold)
    models = fit_parts(days, features, target, part, folds, l2)
    tested = days.withColumn("fold", test).where("fold IS NOT NULL").drop("__day")
    return models, predicted(tested, models, features, f"{target}_pred")


def walk_forward_scores(df: DataFrame, features: list[str], target: str, window: int = 90, step: int = 7, l2: float = RIDGE,
                        date: str = D) -> DataFrame:
    """M3: fold, n, wmape of every fold."""
    _, scored = walk_forward(df, features, target, window, step, l2, date)
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), wmape_global_expr(target, f"{target}_pred").alias("wmape"))


# ------------------------------------------------------------------------- M5
def hash_fold(k: int) -> Column:
    return F.pmod(F.xxhash64(K, D), F.lit(k))


def all_but(part: Column, k: int) -> Column:
    return F.filter(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda f: f != part)


def bagged(df: DataFrame, features: list[str], target: str, k: int = 5, l2: float = RIDGE) -> tuple[DataFrame, DataFrame]:
    """M5: (k models, each of all rows but one hash fold; the rows with the prediction of the model that left them out)."""
    models = fit_parts(df, features, target, hash_fold(k), all_but(F.col("part"), k), l2)
    return models, predicted(df.withColumn("fold", hash_fold(k)), models, features, f"{target}_oof").drop("fold")


def mean_model(models: DataFrame) -> DataFrame:
    """The model whose prediction is the mean of the models' (one row, fold 0)."""
    at = models.select("n_train", "intercept", F.posexplode("coef").alias("i", "c"))
    coef = at.groupBy("i").agg(F.avg("c").alias("c")).agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("s"))
    head = models.agg(F.max("n_train").alias("n_train"), F.avg("intercept").alias("intercept"))
    coef = coef.select(F.transform("s", lambda x: x["c"]).alias("coef"))
    return head.crossJoin(coef).select(F.lit(0).cast("long").alias("fold"), "n_train", "intercept", "coef")


def time_blocked(df: DataFrame, features: list[str], target: str, block: Column, k: int, l2: float = RIDGE, out: str | None = None) -> DataFrame:
    """The rows of blocks 1 to k - 1, each predicted by a model of the earlier blocks only (no look-ahead)."""
    later = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(k - 1).cast("long")), lambda f: f > F.col("part"))
    models = fit_parts(df, features, target, block, later, l2)
    return predicted(df.withColumn("__fold", block.cast("long")), models, features, out or f"{target}_oof", "__fold").drop("__fold")
