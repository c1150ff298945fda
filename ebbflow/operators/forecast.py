"""Forecast (F1-F10, J6).

F1-F7 (the reference's day loop) collapse into one plan: each (fund, target)
has one baseline and at most one model value, and only the blend weight
changes with the day index, so the future frame is the latest row per fund
cross-joined with the N future dates (N is a small parameter, the dates a
``sequence``).  F8/F9 are one-step heuristics as conditional aggregates over
row numbers.  F10 is the true recursion: per fund the last 30 values are an
array, and a higher-order ``aggregate`` over the day indices appends each
day's forecast before computing the next; no driver loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.schema import D, EPS, K, TARGETS, present_uv

TWO_PI = 2.0 * math.pi
# Fixed values of the reference forecast: floor 100 for amounts, model
# weight max(0.1, 0.8 - 0.1 * day), recalibration every 3 days, seasonal
# amplitudes 0.1 (baseline), 0.05 (amount heuristic) and 0.1 (UV heuristic),
# weekend factor 0.8 for UV.
FLOOR = 100.0
CALIBRATION_INTERVAL = 3


def _lit_date(d) -> Column:
    return F.to_date(F.lit(str(d)))


def future_dates(start, n_days: int) -> Column:
    return F.sequence(_lit_date(start), F.date_add(_lit_date(start), n_days - 1))


# ------------------------------------------------------------------ F1 / J6
def latest_rows(df: DataFrame, key: str = K, date: str = D) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == F.lit(1)).drop("__rn")


def future_frame(df: DataFrame, start, n_days: int = 7, key: str = K, date: str = D) -> DataFrame:
    """Funds x next N dates; other columns copied from each fund's latest row; ``day_idx`` from 0."""
    last = latest_rows(df, key, date)
    days = F.posexplode(future_dates(start, n_days))
    out = last.select("*", days.alias("day_idx", "__fdate"))
    return out.drop(date).withColumnRenamed("__fdate", date).select(*df.columns, "day_idx")


# ----------------------------------------------------------------------- F2
def baselines(df: DataFrame, start, as_of_date=None, targets=TARGETS, key: str = K, date: str = D) -> DataFrame:
    """Per fund and target, on rows before ``start``: ma7, ma14, trend, seasonal and their ensemble.

    ``as_of_date`` replaces the reference's run-date for the seasonal term.
    """
    as_of = _lit_date(as_of_date or start)
    real = df.where(F.col(date) < _lit_date(start))
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    r = real.select(key, *targets, F.row_number().over(w).alias("__rn"))
    aggs = [F.count(F.lit(1)).alias("n_real")]
    season = F.lit(1.0) + F.lit(0.1) * F.sin(F.lit(TWO_PI) * F.dayofyear(as_of) / F.lit(365.0))
    for t in targets:
        x, rn = F.col(t), F.col("__rn")
        ma7 = F.avg(F.when(rn <= F.lit(7), x))
        ma14 = F.avg(F.when(rn <= F.lit(14), x))
        x_last = F.max(F.when(rn == F.lit(1), x))
        x_7th = F.max(F.when(rn == F.lit(7), x))
        trend = F.when(F.count(F.lit(1)) >= F.lit(7), ma7 + (x_last - x_7th) / F.lit(7.0)).otherwise(F.avg(x))
        aggs += [
            ma7.alias(f"{t}_ma7"),
            ma14.alias(f"{t}_ma14"),
            trend.alias(f"{t}_trend"),
            (ma7 * season).alias(f"{t}_seasonal"),
        ]
    b = r.groupBy(key).agg(*aggs)
    ens = []
    for t in targets:
        arr = F.array(*[F.col(f"{t}_{n}") for n in ("ma7", "ma14", "trend", "seasonal")])
        ok = F.filter(arr, lambda v: v.isNotNull() & (v > F.lit(0)) & ~F.isnan(v))
        mean = F.when(F.size(ok) > F.lit(0), F.aggregate(ok, F.lit(0.0), lambda a, v: a + v) / F.size(ok))
        ens.append(mean.alias(f"{t}_baseline"))
    return b.select("*", *ens)


# ------------------------------------------------------------ F4 / F5 / F6
def blend(day_idx: Column, base: Column, model: Column | None, carry: Column, n_real: Column) -> Column:
    """One day's value: model blend on recalibration days, floor 100, carry-last when no baseline."""
    weight = F.greatest(F.lit(0.1), F.lit(0.8) - F.lit(0.1) * day_idx)
    floored_base = F.greatest(F.lit(FLOOR), base)
    if model is not None:
        calib = (day_idx % F.lit(CALIBRATION_INTERVAL)) == F.lit(0)
        with_model = F.when(
            calib & model.isNotNull() & (model > F.lit(0)),
            F.greatest(F.lit(FLOOR), weight * model + (F.lit(1.0) - weight) * base),
        ).otherwise(floored_base)
    else:
        with_model = floored_base
    return F.when((n_real >= F.lit(7)) & base.isNotNull(), with_model).otherwise(carry)


def forecast(df: DataFrame, start, n_days: int = 7, model_preds: DataFrame | None = None, as_of_date=None,
             targets=TARGETS, key: str = K, date: str = D) -> DataFrame:
    """F1-F6 as one plan: future rows with targets forecast and other columns from the latest row.

    ``model_preds``: optional (key, ``{t}_model``) frame, the model's value
    for the latest row of each fund.
    """
    fut = future_frame(df, start, n_days, key, date)
    base = baselines(df, start, as_of_date, targets, key, date).select(
        key, "n_real", *[f"{t}_baseline" for t in targets]
    )
    j = fut.join(base, key, "left")
    if model_preds is not None:
        j = j.join(model_preds, key, "left")
    out = []
    for t in targets:
        model = F.col(f"{t}_model") if model_preds is not None and f"{t}_model" in model_preds.columns else None
        v = blend(F.col("day_idx"), F.col(f"{t}_baseline"), model, F.col(t), F.coalesce(F.col("n_real"), F.lit(0)))
        out.append(v.alias(t))
    keep = [c for c in df.columns if c not in targets]
    return j.select(*keep, *out, "day_idx").select(*df.columns, "day_idx")


# ----------------------------------------------------------------------- F7
def append_forecast(history: DataFrame, fc: DataFrame, key: str = K, date: str = D) -> DataFrame:
    return history.unionByName(fc.drop("day_idx"), allowMissingColumns=True).orderBy(key, date)


def forecast_part(df: DataFrame, start, date: str = D) -> DataFrame:
    return df.where(F.col(date) >= _lit_date(start))


# ---------------------------------------------------------------- F8 / F9
def heuristic_day(df: DataFrame, day, targets=TARGETS, key: str = K, date: str = D) -> DataFrame:
    """F8 + F9: one-step heuristic forecast per fund for the date ``day`` (one groupBy)."""
    day_c = _lit_date(day)
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    uvs = present_uv(df.columns)
    wa = Window.partitionBy(key).orderBy(date)
    pcts = [(F.try_divide(F.col(u), F.lag(u).over(wa)) - F.lit(1.0)).alias(f"__pct_{u}") for u in uvs]
    r = df.select(key, date, *targets, *uvs, *pcts, F.row_number().over(w).alias("__rn"))
    rn = F.col("__rn")
    n = F.count(F.lit(1))
    aggs = [n.alias("n_rows")]
    doy = F.dayofyear(day_c)
    for t in targets:
        x = F.col(t)
        ma7 = F.avg(F.when(rn <= F.lit(7), x))
        ma14 = F.avg(F.when(rn <= F.lit(14), x))
        ma30 = F.avg(F.when(rn <= F.lit(30), x))
        std14 = F.stddev_samp(F.when(rn <= F.lit(14), x))
        pred = _amount_formula(ma7, ma14, ma30, std14, doy)
        aggs.append(
            F.when(n >= F.lit(14), F.greatest(F.lit(FLOOR), pred)).otherwise(F.greatest(F.lit(FLOOR), F.avg(x))).alias(t)
        )
    for u in uvs:
        x = F.col(u)
        uv_ma = F.avg(F.when(rn <= F.lit(7), x))
        uv_trend = F.avg(F.when(rn <= F.lit(7), F.col(f"__pct_{u}")))
        pred = _uv_formula(uv_ma, uv_trend, doy, F.weekday(day_c))
        aggs.append(F.when(n >= F.lit(7), F.greatest(F.lit(0.0), pred)).otherwise(F.max(F.when(rn == F.lit(1), x))).alias(u))
    return r.groupBy(key).agg(*aggs).select(key, day_c.alias(date), *targets, *uvs, "n_rows")


def _amount_formula(ma7, ma14, ma30, std14, doy) -> Column:
    trend_short = (ma7 - ma14) / (ma14 + F.lit(EPS))
    trend_long = (ma14 - ma30) / (ma30 + F.lit(EPS))
    combined = F.lit(0.7) * trend_short + F.lit(0.3) * trend_long
    seasonal = F.lit(1.0) + F.lit(0.05) * F.sin(F.lit(TWO_PI) * doy / F.lit(365.0))
    vol = std14 / (ma14 + F.lit(EPS))
    vol_adj = F.greatest(F.lit(0.8), F.least(F.lit(1.2), F.lit(1.0) - vol * F.lit(0.1)))
    return ma7 * (F.lit(1.0) + combined * F.lit(0.3)) * seasonal * vol_adj


def _uv_formula(uv_ma, uv_trend, doy, weekday) -> Column:
    seasonal = F.lit(1.0) + F.lit(0.1) * F.sin(F.lit(TWO_PI) * doy / F.lit(365.0))
    wf = F.when(weekday >= F.lit(5), F.lit(0.8)).otherwise(F.lit(1.0))
    return uv_ma * (F.lit(1.0) + uv_trend * F.lit(0.2)) * seasonal * wf


# ---------------------------------------------------------------------- F10
HIST = 30


def _tail(arr: Column, k: int) -> Column:
    size = F.size(arr)
    return F.slice(arr, F.greatest(size - F.lit(k - 1), F.lit(1)), F.lit(k))


def _mean(arr: Column) -> Column:
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, v: a + v), F.size(arr).cast("double"))


def _std(arr: Column) -> Column:
    m = _mean(arr)
    ss = F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return F.when(F.size(arr) > F.lit(1), F.sqrt(ss / (F.size(arr) - F.lit(1)).cast("double")))


def _step_amount(arr: Column, n: Column, doy: Column) -> Column:
    pred = _amount_formula(_mean(_tail(arr, 7)), _mean(_tail(arr, 14)), _mean(_tail(arr, 30)), _std(_tail(arr, 14)), doy)
    return F.when(n >= F.lit(14), F.greatest(F.lit(FLOOR), pred)).otherwise(F.greatest(F.lit(FLOOR), _mean(arr)))


def _step_uv(arr: Column, n: Column, doy: Column, weekday: Column) -> Column:
    last8 = _tail(arr, 8)
    pairs = F.zip_with(F.slice(last8, 1, F.size(last8) - F.lit(1)), F.slice(last8, 2, F.size(last8) - F.lit(1)),
                       lambda prev, cur: F.try_divide(cur, F.when(prev != F.lit(0.0), prev)) - F.lit(1.0))
    ok = F.filter(pairs, lambda v: v.isNotNull())
    trend = _mean(ok)
    pred = _uv_formula(_mean(_tail(arr, 7)), trend, doy, weekday)
    return F.when(n >= F.lit(7), F.greatest(F.lit(0.0), pred)).otherwise(F.element_at(arr, -1))


def _push(arr: Column, v: Column) -> Column:
    return _tail(F.concat(arr, F.array(v)), HIST)


def recursive_forecast(df: DataFrame, start, n_days: int = 7, targets=TARGETS, key: str = K, date: str = D) -> DataFrame:
    """each day's heuristic forecast joins the history before the next day is computed.

    Per fund only the last 30 values (what the heuristics read) and the row
    count travel; the fold over the N days is one expression per fund.
    """
    uvs = present_uv(df.columns)
    series = list(targets) + uvs
    real = df.where(F.col(date) < _lit_date(start))
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    last = real.select(key, date, *series, F.row_number().over(w).alias("__rn"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("__n"))
    last = last.where(F.col("__rn") <= F.lit(HIST))
    g = last.groupBy(key).agg(
        F.max("__n").alias("__n"),
        F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), *[F.col(s).cast("double").alias(s) for s in series]))).alias("__h"),
    )
    def field(s):
        return lambda e: e[s]

    init = F.struct(
        F.col("__n").alias("n"),
        *[F.transform(F.col("__h"), field(s)).alias(s) for s in series],
        F.array().cast("array<struct<day_idx:int," + ",".join(f"{s}:double" for s in series) + ">>").alias("out"),
    )

    def step(acc, d):
        day = F.date_add(_lit_date(start), d)
        doy, wd = F.dayofyear(day), F.weekday(day)
        n = acc["n"]
        vals = {t: _step_amount(acc[t], n, doy) for t in targets}
        vals.update({u: _step_uv(acc[u], n, doy, wd) for u in uvs})
        rec = F.struct(d.alias("day_idx"), *[vals[s].alias(s) for s in series])
        return F.struct(
            (n + F.lit(1)).alias("n"),
            *[_push(acc[s], vals[s]).alias(s) for s in series],
            F.concat(acc["out"], F.array(rec)).alias("out"),
        )

    folded = F.aggregate(F.sequence(F.lit(0), F.lit(n_days - 1)), init, step)
    out = g.select(key, F.explode(folded["out"]).alias("__o"))
    return out.select(
        key, F.date_add(_lit_date(start), F.col("__o.day_idx")).alias(date), "__o.day_idx", *[F.col(f"__o.{s}").alias(s) for s in series]
    )
