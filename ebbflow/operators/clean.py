"""Cleaning, filters and imputation.

Global statistics (quantiles, medians, modes) are computed in one aggregate
per step and broadcast back as a one-row frame; per-row rewriting is plain
column arithmetic, so a step costs at most one extra scan and no shuffle of
the wide table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.functions.exprs import finite_or_null
from ebbflow.functions.quantiles import exact_quantiles, quantile_name
from ebbflow.schema import D, K, TARGETS, UV_COLS
from ebbflow.session import cut_lineage

CLEAN_COLS = TARGETS + UV_COLS
NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def float_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in ex]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ex]


def _present(df: DataFrame, cols) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


# ---------------------------------------------------------------- C1 / C2 / C3
def iqr_bounds(df: DataFrame, cols=None, factor: float = 3.0) -> DataFrame:
    """One row per column: q1, q3, iqr, lower, upper (exact, linear interpolation)."""
    cols = _present(df, cols or CLEAN_COLS)
    q = exact_quantiles(df, cols, [0.25, 0.75])
    rows = []
    for c in cols:
        q1 = F.col(quantile_name(c, 0.25))
        q3 = F.col(quantile_name(c, 0.75))
        iqr = q3 - q1
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                q1.alias("q1"),
                q3.alias("q3"),
                iqr.alias("iqr"),
                (q1 - F.lit(factor) * iqr).alias("lower"),
                (q3 + F.lit(factor) * iqr).alias("upper"),
            )
        )
    return q.select(F.explode(F.array(*rows)).alias("b")).select("b.*")


def outlier_counts(df: DataFrame, cols=None, factor: float = 3.0) -> DataFrame:
    """Per column the bounds and the number of values outside them."""
    cols = _present(df, cols or CLEAN_COLS)
    bounds = iqr_bounds(df, cols, factor)
    wide = bounds.groupBy().pivot("column", cols).agg(F.first(F.struct("lower", "upper")))
    wide = wide.select(*[F.col(f"`{c}`").alias(f"__b_{c}") for c in cols])
    counts = df.crossJoin(F.broadcast(wide)).agg(
        *[
            F.sum(
                F.when((F.col(c) < F.col(f"__b_{c}.lower")) | (F.col(c) > F.col(f"__b_{c}.upper")), 1).otherwise(0)
            )
            .cast("bigint")
            .alias(c)
            for c in cols
        ]
    )
    long = counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in cols])).alias("o")
    ).select("o.*")
    return bounds.join(F.broadcast(long), "column")


def _bounds_row(bounds: DataFrame, cols) -> DataFrame:
    return bounds.groupBy().pivot("column", list(cols)).agg(F.first(F.struct("lower", "upper")))


def winsorise(df: DataFrame, cols=None, factor: float = 3.0) -> DataFrame:
    """Clip each column to its [Q1-3IQR, Q3+3IQR] bounds (NULL stays NULL)."""
    cols = _present(df, cols or CLEAN_COLS)
    if not cols:
        return df
    b = _bounds_row(iqr_bounds(df, cols, factor), cols)
    renamed = b.select(*[F.col(f"`{c}`").alias(f"__b_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(renamed))
    out = []
    for c in df.columns:
        if c in cols:
            x = F.col(c).cast("double")
            lo, hi = F.col(f"__b_{c}.lower"), F.col(f"__b_{c}.upper")
            out.append(F.when(x < lo, lo).when(x > hi, hi).otherwise(x).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def clip_non_negative(df: DataFrame, cols=None) -> DataFrame:
    """Values below 0 become 0; NULL stays NULL."""
    cols = set(_present(df, cols or CLEAN_COLS))
    return df.select(
        *[
            (F.when(F.col(c) < F.lit(0), F.lit(0.0)).otherwise(F.col(c).cast("double")).alias(c) if c in cols else F.col(c))
            for c in df.columns
        ]
    )


# ------------------------------------------------------------------------- C4
def min_history(df: DataFrame, min_rows: int = 30, key: str = K) -> DataFrame:
    """Keep keys with at least ``min_rows`` rows (count then semi join)."""
    keep = df.groupBy(key).count().filter(F.col("count") >= F.lit(min_rows)).select(key)
    return df.join(keep, key, "left_semi")


def clean_flows(df: DataFrame, factor: float = 3.0, min_rows: int = 30) -> DataFrame:
    """C1-C4 in the reference order: winsorise, clip at 0, drop short funds."""
    return min_history(clip_non_negative(winsorise(df, factor=factor)), min_rows)


# ------------------------------------------------------------------- C5 / C6
def nulls_for_nonfinite(df: DataFrame, cols=None) -> DataFrame:
    """NaN and +-inf become NULL in every float column."""
    cols = set(cols or float_columns(df))
    return df.select(*[(finite_or_null(c).alias(c) if c in cols else F.col(c)) for c in df.columns])


def ffill_bfill(df: DataFrame, cols=None, key: str = K, date: str = D, backfill: bool = True) -> DataFrame:
    """Forward fill, then back fill, within each key in date order."""
    cols = set(cols or numeric_columns(df, exclude=(key, date)))
    # Both fills are running frames (incremental, O(1) per row): the back fill
    # is a forward fill over the reversed date order, not an unbounded-following
    # frame, which Spark would recompute for every row.
    w_past = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    w_rev = Window.partitionBy(key).orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, 0)
    fwd = df.select(
        *[(F.last(F.col(f"`{c}`"), ignorenulls=True).over(w_past).alias(c) if c in cols else F.col(f"`{c}`")) for c in df.columns]
    )
    if not backfill:
        return fwd
    return fwd.select(
        *[
            (F.coalesce(F.col(f"`{c}`"), F.last(F.col(f"`{c}`"), ignorenulls=True).over(w_rev)).alias(c) if c in cols else F.col(f"`{c}`"))
            for c in df.columns
        ]
    )


# ------------------------------------------------------------------------- C7
def global_medians(df: DataFrame, cols) -> DataFrame:
    """One row: exact median per column (NULL when the column has no value)."""
    q = exact_quantiles(df, list(cols), [0.5])
    return q.select(*[F.col(quantile_name(c, 0.5)).alias(c) for c in cols])


def columns_with_nulls(df: DataFrame, cols) -> list[str]:
    """Columns holding at least one NULL (one aggregate of counters; the list drives the plan)."""
    cols = list(cols)
    if not cols:
        return []
    row = df.agg(*[F.max(F.col(f"`{c}`").isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"n{i}"]]


def median_fill(df: DataFrame, cols=None, exclude=(K, D), only_if_null: bool = False) -> DataFrame:
    """Remaining NULLs take the column's global median, then 0.

    ``only_if_null`` first finds the columns that still hold NULLs (as the
    reference, which takes the median only of such columns) and computes
    medians for those alone.
    """
    cols = list(cols or numeric_columns(df, exclude=exclude))
    if only_if_null:
        cols = columns_with_nulls(df, cols)
    if not cols:
        return df
    med = global_medians(df, cols).select(*[F.col(c).alias(f"__m_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(med))
    cs = set(cols)
    return j.select(
        *[
            (F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}"), F.lit(0.0)).alias(c) if c in cs else F.col(c))
            for c in df.columns
        ]
    )


def smart_fill(df: DataFrame, key: str = K, date: str = D, backfill: bool = True) -> DataFrame:
    """C5 + C6 + C7 as in the reference fill step; numeric NULLs end as 0, text as '0'."""
    num = numeric_columns(df, exclude=(key, date))
    # written once: which columns still hold NULLs, their medians and every later use read the fills
    filled = cut_lineage(ffill_bfill(nulls_for_nonfinite(df), num, key, date, backfill))
    out = median_fill(filled, num, only_if_null=True)
    text = string_columns(out, exclude=(key,))
    return out.fillna("0", subset=text) if text else out


# ------------------------------------------------------------------------- C8
class TrainClipper:
    """1 % / 99 % bounds fitted on the training rows, applied to any frame."""

    def __init__(self, lower: float = 0.01, upper: float = 0.99):
        self.lower, self.upper = lower, upper
        self.bounds: DataFrame | None = None
        self.cols: list[str] = []

    def fit(self, train: DataFrame, cols=None) -> "TrainClipper":
        self.cols = list(cols or float_columns(train))
        clean = nulls_for_nonfinite(train.select(*self.cols))
        q = exact_quantiles(clean, self.cols, [self.lower, self.upper])
        self.bounds = q.select(
            *[
                F.struct(
                    F.col(quantile_name(c, self.lower)).alias("lo"), F.col(quantile_name(c, self.upper)).alias("hi")
                ).alias(f"__c_{c}")
                for c in self.cols
            ]
        )
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        assert self.bounds is not None, "fit first"
        cs = set(self.cols)
        j = nulls_for_nonfinite(df, [c for c in self.cols if c in df.columns]).crossJoin(F.broadcast(self.bounds))
        out = []
        for c in df.columns:
            if c in cs:
                lo, hi = F.col(f"__c_{c}.lo"), F.col(f"__c_{c}.hi")
                x = F.col(c)
                ok = lo.isNotNull() & hi.isNotNull()
                out.append(F.when(ok, F.least(F.greatest(x, lo), hi)).otherwise(x).alias(c))
            else:
                out.append(F.col(c))
        return j.select(*out)


# ------------------------------------------------------------------ C9 / C11
def train_modes(train: DataFrame, cols) -> DataFrame:
    """One row: most frequent value per column, smallest value on ties, NULLs ignored."""
    return train.agg(*[F.mode(c, deterministic=True).alias(c) for c in cols])


def unseen_to_mode(train: DataFrame, other: DataFrame, cols=None) -> DataFrame:
    """Values of ``other`` never seen in ``train`` (and NULLs) take the train mode.

    The set of seen values is joined (not collected), so it may be large.
    """
    cols = list(cols or string_columns(train, exclude=(K,)))
    if not cols:
        return other
    modes = train_modes(train, cols).select(
        *[F.coalesce(F.col(c), F.lit("unknown")).alias(f"__mode_{c}") for c in cols]
    )
    out = other.crossJoin(F.broadcast(modes))
    for c in cols:
        seen = train.select(F.col(c).alias(f"__seen_{c}")).where(F.col(f"__seen_{c}").isNotNull()).distinct()
        out = out.join(seen, out[c] == seen[f"__seen_{c}"], "left")
        out = out.withColumn(
            c, F.when(F.col(f"__seen_{c}").isNotNull(), F.col(c)).otherwise(F.col(f"__mode_{c}"))
        ).drop(f"__seen_{c}")
    return out.drop(*[f"__mode_{c}" for c in cols])


def mode_fill(train: DataFrame, df: DataFrame, cols=None) -> DataFrame:
    """C11: NULL categories take the train mode, 'unknown' when there is none."""
    cols = list(cols or string_columns(train, exclude=(K,)))
    if not cols:
        return df
    modes = train_modes(train, cols).select(*[F.col(c).alias(f"__mode_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(modes))
    cs = set(cols)
    return j.select(
        *[
            (F.coalesce(F.col(c), F.col(f"__mode_{c}"), F.lit("unknown")).alias(c) if c in cs else F.col(c))
            for c in df.columns
        ]
    )


# ------------------------------------------------------------------------ C10
def train_median_fill(train: DataFrame, df: DataFrame, cols=None) -> DataFrame:
    """NULL numerics take the train median, 0 when the median is NULL."""
    cols = list(cols or numeric_columns(train, exclude=(K, D)))
    if not cols:
        return df
    med = global_medians(train, cols).select(*[F.col(c).alias(f"__m_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(med))
    cs = set(cols)
    return j.select(
        *[
            (F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}"), F.lit(0.0)).alias(c) if c in cs else F.col(c))
            for c in df.columns
        ]
    )


# ------------------------------------------------------------------ C12 - C15
def floor_target_drop_nulls(df: DataFrame, target: str, floor: float = 0.1) -> DataFrame:
    """Target floored at 0.1, then rows with any NULL dropped."""
    t = F.col(target)
    # a NULL target stays NULL (greatest would skip it) and the row is dropped
    return df.withColumn(target, F.when(t.isNotNull(), F.greatest(t, F.lit(floor)))).na.drop("any")


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows that are NULL in every column."""
    return df.na.drop("all")


def feature_columns(df: DataFrame, targets=TARGETS, key: str = K, date: str = D) -> list[str]:
    """C14: every column but key, date and the targets."""
    drop = {key, date, *targets}
    return [c for c in df.columns if c not in drop]


def prepare_frames(train: DataFrame, valid: DataFrame, targets=TARGETS):
    """C8-C11 on both frames at once, for every target: one set of statistics from the training rows.

    Clipping is monotone and the median lies between the bounds, so the median of a
    clipped column is the column's own: one pass over the training rows gives bounds and
    medians.  They are one number for each column and probability, held as literals.
    """
    feats = feature_columns(train, targets)
    floats = [c for c in float_columns(train) if c in set(feats)]
    nums = [c for c in numeric_columns(train) if c in set(feats)]
    cats = [c for c in string_columns(train) if c in set(feats)]
    low, mid, high = 0.01, 0.5, 0.99
    stats = exact_quantiles(nulls_for_nonfinite(train.select(*nums), floats), nums, [low, mid, high]).first() if nums else {}

    def prepared(df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            x = F.col(f"`{c}`")
            if c in floats:
                lo, hi = stats[quantile_name(c, low)], stats[quantile_name(c, high)]
                x = finite_or_null(c)
                x = x if lo is None else F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)
            if c in nums:
                x = F.coalesce(x.cast("double"), F.lit(stats[quantile_name(c, mid)] or 0.0))
            out.append(x.alias(c))
        return df.select(*out)

    tr, va = prepared(train), prepared(valid)
    return mode_fill(tr, tr, cats), mode_fill(tr, unseen_to_mode(tr, va, cats), cats)


def prepare_train_valid(train: DataFrame, valid: DataFrame, target: str, targets=TARGETS):
    """C8-C14 composed: the reference's model-input preparation for one target."""
    keep = [*feature_columns(train, targets), target]
    tr, va = prepare_frames(train.select(*keep), valid.select(*keep), targets)
    return floor_target_drop_nulls(tr, target), floor_target_drop_nulls(va, target)
