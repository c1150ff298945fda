"""Technical indicators per key.

Exponential weights (T1, T2, T6) use the exact infinite-horizon sums that pandas
computes, NULLs included, with O(1) work per row and no arrays: every row has a number
of steps e that never falls within its key, and a term weighs base^(e_i - e_j) at row
i.  Rows are cut into blocks of so many steps that a whole one weighs below 1e-30; inside
a block a running sum of base^-offset x gives the sums up to the block start, and the end
value of the block before it is carried by a ``last`` window.  Terms further back weigh
below 1e-30 of the newest and are dropped.  Each alpha needs one extra sort on
(key, block); no shuffle is added because the data is already partitioned by key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions.exprs import eps_ratio, fund_window
from ebbflow.schema import D, EPS, K, TARGETS

MACD_SPANS = (12, 26, 9)  # fixed values: fast, slow and signal spans
BLOCK_TOL = 1e-30


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def alpha_tag(a: float) -> str:
    """'0.1' -> '0_1': Spark reads a dot in a column name as a struct path."""
    return str(a).replace(".", "_")


# ------------------------------------------------------------- shared sums
def add_row_numbers(df: DataFrame, key: str = K, date: str = D) -> DataFrame:
    return df if "__rn" in df.columns else df.withColumn("__rn", F.row_number().over(fund_window(key, date)))


def block_steps(base: float) -> int:
    return math.ceil(math.log(BLOCK_TOL) / math.log(base))


def add_decayed_sums(df: DataFrame, specs, key: str = K, date: str = D) -> DataFrame:
    """For each spec (name, steps column, base, {out: (value, power)}) add ``out``, the sum over
    earlier-or-current rows j of base^(power (e_i - e_j)) value_j; a NULL value adds nothing.
    """
    w = fund_window(key, date)
    df = df.select(
        "*", *[F.floor(F.col(e) / F.lit(block_steps(base))).alias(f"{name}_blk") for name, e, base, _ in specs]
    )

    def weight(name, e, base, power):
        off = F.col(e) - F.col(f"{name}_blk") * F.lit(block_steps(base))
        return F.pow(F.lit(base**abs(power)), off if power > 0 else -off)

    first = []
    for name, e, base, outs in specs:
        wb = Window.partitionBy(key, f"{name}_blk").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
        for out, (value, power) in outs.items():
            first.append(F.sum(weight(name, e, base, -power) * value).over(wb).alias(f"{out}_q"))
    df = df.select("*", *first)
    df = df.select(
        "*", *[(F.lead(f"{name}_blk").over(w) != F.col(f"{name}_blk")).alias(f"{name}_end") for name, *_ in specs]
    )
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    second, drop = [], []
    for name, e, base, outs in specs:
        blk = F.col(f"{name}_blk")
        last_blk = F.last(F.when(F.col(f"{name}_end"), blk), ignorenulls=True).over(prev)
        for out, (_, power) in outs.items():
            end = F.last(F.when(F.col(f"{name}_end"), F.struct(F.col(f"{out}_q").alias("q"))), ignorenulls=True).over(prev)
            carry = F.when(last_blk == blk - F.lit(1), end["q"] * F.lit(base ** (power * block_steps(base))))
            total = F.coalesce(F.col(f"{out}_q"), F.lit(0.0)) + F.coalesce(carry, F.lit(0.0))
            second.append((weight(name, e, base, power) * total).alias(out))
            drop.append(f"{out}_q")
        drop += [f"{name}_blk", f"{name}_end"]
    return df.select("*", *second).drop(*drop)


# ------------------------------------------------------------------ T1 / T2
def ewm_spec(name: str, t: str, alpha: float):
    """Sums of adjusted weights over the rows that hold a value; squares are taken about the key's first value."""
    x, seen = F.col(t).cast("double") - F.col(f"__{t}_x1"), F.col(t).isNotNull()
    one = F.when(seen, F.lit(1.0))
    sums = {f"{name}_w": (one, 1), f"{name}_w2": (one, 2), f"{name}_s1": (x, 1), f"{name}_s2": (x * x, 1)}
    return (name, "__rn", 1.0 - alpha, sums)


def ewm_mean_col(name: str, t: str) -> Column:
    return F.col(f"__{t}_x1") + F.try_divide(F.col(f"{name}_s1"), F.col(f"{name}_w"))


def ewm_std_col(name: str) -> Column:
    """Bias-corrected adjusted EWM std: sqrt((S2/W - m^2) * W^2 / (W^2 - W2)); NULL for one value,
    or where the others weigh nothing beside it in double precision."""
    w = F.col(f"{name}_w")
    m = F.try_divide(F.col(f"{name}_s1"), w)
    var = F.try_divide(F.col(f"{name}_s2"), w) - m * m
    den = w * w - F.col(f"{name}_w2")
    return F.when(den > F.lit(1e-15) * w * w, F.sqrt(F.greatest(var, F.lit(0.0)) * w * w / den))


# ------------------------------------------------------------------ T3 / T4
def cumulative_columns(t: str, key=K, date=D) -> list[Column]:
    w = fund_window(key, date).rowsBetween(Window.unboundedPreceding, 0)
    return [
        F.sum(t).over(w).alias(f"{t}_cumsum"),
        F.max(t).over(w).alias(f"{t}_cummax"),
        F.min(t).over(w).alias(f"{t}_cummin"),
        F.sum(F.log1p(t)).over(w).alias(f"{t}_cumprod_log"),
    ]


# ------------------------------------------------------------------------- T5
def gain_loss_columns(t: str, key=K, date=D) -> list[Column]:
    """First difference split in gain / loss; the first row's difference counts as 0."""
    delta = F.col(t) - F.lag(t, 1).over(fund_window(key, date))
    gain = F.when(delta > F.lit(0), delta).otherwise(F.lit(0.0))
    loss = F.when(delta < F.lit(0), -delta).otherwise(F.lit(0.0))
    return [gain.alias(f"__{t}_gain"), loss.alias(f"__{t}_loss")]


def rsi_from_gains(t: str, periods=(7, 14, 21), key=K, date=D) -> list[Column]:
    """Simple-mean RSI over the last p rows including today."""
    base = fund_window(key, date)
    out = []
    for p in periods:
        w = base.rowsBetween(-(p - 1), 0)
        g = F.avg(f"__{t}_gain").over(w)
        lo = F.avg(f"__{t}_loss").over(w)
        rs = F.try_divide(g, lo + F.lit(EPS))
        out.append((F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + rs)).alias(f"{t}_rsi_{p}"))
    return out


# ------------------------------------------------------------------------- T6
def add_emas(df: DataFrame, specs, key: str = K, date: str = D) -> DataFrame:
    """For each (name, column, alpha) add ``name``, the unadjusted EMA seeded by the first value.

    y_k = a y_(k-1) + (1 - a) x_k with a = b^g / (b^g + alpha), b = 1 - alpha and g the rows
    since the value before; a row without a value repeats y.
    """
    w = fund_window(key, date)
    df = add_row_numbers(df, key, date)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    for c in dict.fromkeys(c for _, c, _ in specs):
        gap = F.col("__rn") - F.last(F.when(F.col(c).isNotNull(), F.col("__rn")), ignorenulls=True).over(before)
        df = df.withColumn(f"__{c}_gap", gap)
    steps, exps, sums = [], [], []
    for name, c, alpha in specs:
        old = F.pow(F.lit(1.0 - alpha), F.col(f"__{c}_gap"))
        keep = old / (old + F.lit(alpha))  # NULL on the first value
        seen = F.col(c).isNotNull()
        # in steps of one row: exactly 1 where no row is missing
        step = F.log(keep) / F.log(F.lit(1.0 - alpha))
        steps.append(F.when(seen & keep.isNotNull(), step).otherwise(F.lit(0.0)).alias(f"{name}_step"))
        new = F.when(seen, (F.lit(1.0) - F.coalesce(keep, F.lit(0.0))) * F.col(c))
        exps.append(F.sum(f"{name}_step").over(running).alias(f"{name}_e"))
        sums.append((name, f"{name}_e", 1.0 - alpha, {f"{name}_y": (F.col(f"{name}_x"), 1)}))
        steps.append(new.alias(f"{name}_x"))
        steps.append(F.max(seen.cast("int")).over(running).alias(f"{name}_on"))
    df = add_decayed_sums(df.select("*", *steps).select("*", *exps), sums, key, date)
    out = [F.when(F.col(f"{name}_on") == F.lit(1), F.col(f"{name}_y")).alias(name) for name, _, _ in specs]
    drop = [f"{name}_{k}" for name, _, _ in specs for k in ("step", "x", "on", "e", "y")]
    return df.select("*", *out).drop(*drop, *[f"__{c}_gap" for _, c, _ in specs])


# ------------------------------------------------------------------------- T7
def bollinger_columns(t: str, windows=(14, 21), key=K, date=D) -> list[Column]:
    out = []
    base = fund_window(key, date)
    for n in windows:
        w = base.rowsBetween(-(n - 1), 0)
        sma = F.avg(t).over(w)
        std = F.stddev_samp(t).over(w)
        up = sma + F.lit(2.0) * std
        lo = sma - F.lit(2.0) * std
        out += [
            up.alias(f"{t}_bb_upper_{n}"),
            lo.alias(f"{t}_bb_lower_{n}"),
            eps_ratio(up - lo, sma).alias(f"{t}_bb_width_{n}"),
            eps_ratio(F.col(t) - lo, up - lo).alias(f"{t}_bb_position_{n}"),
        ]
    return out


def add_technical_features(df: DataFrame, targets=TARGETS, alphas=(0.1, 0.2, 0.3, 0.5), key=K, date=D,
                           rsi_periods=(7, 14, 21), bb_windows=(14, 21)) -> DataFrame:
    """T1-T7 for each target, in the reference column order."""
    fast, slow, sig = MACD_SPANS
    w_all = fund_window(key, date).rowsBetween(Window.unboundedPreceding, 0)
    named = [(f"__{t}_e{alpha_tag(a)}", t, a) for t in targets for a in alphas]
    s = add_row_numbers(df, key, date)
    s = s.select("*", *[F.first(F.col(t).cast("double"), ignorenulls=True).over(w_all).alias(f"__{t}_x1") for t in targets])
    s = add_decayed_sums(s, [ewm_spec(n, t, a) for n, t, a in named], key, date)
    cols = []
    for n, t, a in named:
        cols += [ewm_mean_col(n, t).alias(f"{t}_ewm_{alpha_tag(a)}"), ewm_std_col(n).alias(f"{t}_ewm_std_{alpha_tag(a)}")]
    for t in targets:
        cols += cumulative_columns(t, key, date)
        cols += gain_loss_columns(t, key, date)
        cols += bollinger_columns(t, bb_windows, key, date)
    s = s.select("*", *cols)
    s = add_emas(s, [x for t in targets for x in ((f"__{t}_f", t, span_alpha(fast)), (f"__{t}_s", t, span_alpha(slow)))], key, date)
    s = s.select("*", *[(F.col(f"__{t}_f") - F.col(f"__{t}_s")).alias(f"{t}_macd") for t in targets])
    s = add_emas(s, [(f"{t}_macd_signal", f"{t}_macd", span_alpha(sig)) for t in targets], key, date)
    last = []
    for t in targets:
        last.append((F.col(f"{t}_macd") - F.col(f"{t}_macd_signal")).alias(f"{t}_macd_histogram"))
        last += rsi_from_gains(t, rsi_periods, key, date)
    s4 = s.select("*", *last)
    order = []
    for t in targets:
        for a in alphas:
            order += [f"{t}_ewm_{alpha_tag(a)}", f"{t}_ewm_std_{alpha_tag(a)}"]
        order += [f"{t}_cumsum", f"{t}_cummax", f"{t}_cummin", f"{t}_cumprod_log"]
        order += [f"{t}_rsi_{p}" for p in rsi_periods]
        order += [f"{t}_macd", f"{t}_macd_signal", f"{t}_macd_histogram"]
        for n in bb_windows:
            order += [f"{t}_bb_upper_{n}", f"{t}_bb_lower_{n}", f"{t}_bb_width_{n}", f"{t}_bb_position_{n}"]
    return s4.select(*df.columns, *order)
