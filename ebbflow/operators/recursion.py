"""Recursive forecast with a trained model (F10): each day's prediction joins the history before the next day.

Features are those known before a day begins (``add_model_features``): lags, rolling statistics,
changes, running moments, exponential means, RSI, MACD and Bollinger bands of the rows
before it, and the day's calendar.  For the recursion a fund is reduced to a state of
fixed size (``initial_state``): the last ``RING`` values, running sums about the first value,
extremes, and decayed sums.  A new value moves the state on in constant work
(``advanced``), and the same features are read from it (``state_features``), so a forecast of N days
costs N passes over one row a fund, whatever the history's length.

Each day's state is a reliable checkpoint in the shared folder: a lost executor repeats
one day, not the history.  Rows with a NULL target are left out of the history.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions.exprs import eps_ratio, fund_window
from ebbflow.operators import technical as TE
from ebbflow.operators import windows as W
from ebbflow.schema import D, EPS, K, TARGETS, FlowConfig
from ebbflow.session import cut_lineage, spread

#: Values of a fund that the features read: 30 rows and the one before them.
RING = 31
Predict = Callable[[DataFrame], DataFrame]


def calendar_columns(date: Column) -> list[Column]:
    doy = F.dayofyear(date)
    return [
        F.month(date).alias("month"),
        F.weekday(date).alias("day_of_week"),
        F.dayofmonth(date).alias("day_of_month"),
        F.when(F.weekday(date) >= 5, 1).otherwise(0).alias("is_weekend"),
        F.when(date == F.last_day(date), 1).otherwise(0).alias("is_month_end"),
        F.sin(F.lit(2 * math.pi) * doy / F.lit(365.0)).alias("sin_day_of_year"),
        F.cos(F.lit(2 * math.pi) * doy / F.lit(365.0)).alias("cos_day_of_year"),
    ]


def _ema_specs(targets):
    fast, slow, _ = TE.MACD_SPANS
    return [x for t in targets for x in ((f"__{t}_f", t, TE.span_alpha(fast)), (f"__{t}_s", t, TE.span_alpha(slow)))]


def _ewm_names(targets, cfg):
    return [(f"__{t}_e{TE.alpha_tag(a)}", t, a) for t in targets for a in cfg.ewm_alphas]


def _with_sums(df: DataFrame, targets, cfg: FlowConfig, key: str, date: str) -> DataFrame:
    """Adds to every row the sums that a state holds after it."""
    w = fund_window(key, date)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = TE.add_row_numbers(df, key, date)
    df = df.select("*", *[F.first(F.col(t).cast("double"), ignorenulls=True).over(run).alias(f"__{t}_x1") for t in targets])
    df = TE.add_decayed_sums(df, [TE.ewm_spec(n, t, a) for n, t, a in _ewm_names(targets, cfg)], key, date)
    more = []
    for t in targets:
        off = F.col(t) - F.col(f"__{t}_x1")
        more += [
            F.sum(off).over(run).alias(f"__{t}_r1"),
            F.sum(off * off).over(run).alias(f"__{t}_r2"),
            *TE.cumulative_columns(t, key, date),
        ]
    df = df.select("*", *more)
    df = TE.add_emas(df, _ema_specs(targets), key, date)
    df = df.select("*", *[(F.col(f"__{t}_f") - F.col(f"__{t}_s")).alias(f"{t}_macd") for t in targets])
    signal = TE.span_alpha(TE.MACD_SPANS[2])
    return TE.add_emas(df, [(f"{t}_macd_signal", f"{t}_macd", signal) for t in targets], key, date)


def _running(t: str, n: Column) -> list[Column]:
    """Mean and sample std of all values so far, from sums about the first."""
    r1, r2 = F.col(f"__{t}_r1"), F.col(f"__{t}_r2")
    var = F.when(n > 1, F.greatest(r2 - r1 * r1 / n, F.lit(0.0)) / (n - 1))
    return [(F.col(f"__{t}_x1") + r1 / n).alias(f"{t}_self_mean"), F.sqrt(var).alias(f"{t}_self_std")]


def _from_sums(t: str, n: Column, cfg: FlowConfig) -> list[Column]:
    out = _running(t, n)
    for a in cfg.ewm_alphas:
        tag = TE.alpha_tag(a)
        out += [TE.ewm_mean_col(f"__{t}_e{tag}", t).alias(f"{t}_ewm_{tag}"), TE.ewm_std_col(f"__{t}_e{tag}").alias(f"{t}_ewm_std_{tag}")]
    return out + [(F.col(f"{t}_macd") - F.col(f"{t}_macd_signal")).alias(f"{t}_macd_histogram")]


def _kept(t: str) -> list[str]:
    """Columns of a state that are features as they stand."""
    return [f"{t}_{c}" for c in ("cumsum", "cummax", "cummin", "cumprod_log", "macd", "macd_signal")]


def add_model_features(df: DataFrame, targets=TARGETS, cfg: FlowConfig = FlowConfig(), key: str = K, date: str = D) -> DataFrame:
    """Key, date, targets and, for each row, the features known before its day (those of the rows before it)."""
    targets = list(targets)
    w = fund_window(key, date)
    s = _with_sums(spread(df.select(key, date, *targets), key), targets, cfg, key, date)
    same_day = []
    for t in targets:
        same_day += [c for c in W.diff_columns([t], cfg.diff_periods, key, date, accel_max=0)]
        same_day += [*TE.gain_loss_columns(t, key, date), *TE.bollinger_columns(t, cfg.bollinger_windows, key, date)]
        same_day += _from_sums(t, F.col("__rn").cast("double"), cfg)
    s = s.select("*", *same_day)
    s = s.select("*", *[c for t in targets for c in TE.rsi_from_gains(t, cfg.rsi_periods, key, date)])
    names = [c for t in targets for c in _lagged_names(t, cfg)]
    before = [F.lag(c, 1).over(w).alias(c) for c in names]
    lags = W.lag_columns(targets, cfg.lag_periods, key, date) + W.rolling_columns(targets, cfg.rolling_windows, key, date, False)
    return s.select(key, date, *targets, *lags, *before, *calendar_columns(F.col(date)))


def _lagged_names(t: str, cfg: FlowConfig) -> list[str]:
    out = [f"{t}_{kind}_{n}" for n in cfg.diff_periods for kind in ("diff", "pct_change")]
    out += [f"{t}_bb_{kind}_{n}" for n in cfg.bollinger_windows for kind in ("upper", "lower", "width", "position")]
    out += [f"{t}_self_mean", f"{t}_self_std"]
    out += [f"{t}_{kind}_{TE.alpha_tag(a)}" for a in cfg.ewm_alphas for kind in ("ewm", "ewm_std")]
    return out + [f"{t}_macd_histogram", *_kept(t), *[f"{t}_rsi_{p}" for p in cfg.rsi_periods]]


def feature_names(targets=TARGETS, cfg: FlowConfig = FlowConfig()) -> list[str]:
    lags = [f"{t}_lag_{n}" for t in targets for n in cfg.lag_periods]
    rolls = [f"{t}_roll_{k}_{n}" for t in targets for n in cfg.rolling_windows for k in ("mean", "std", "max", "min")]
    days = ["month", "day_of_week", "day_of_month", "is_weekend", "is_month_end", "sin_day_of_year", "cos_day_of_year"]
    return lags + rolls + [c for t in targets for c in _lagged_names(t, cfg)] + days


# ------------------------------------------------------------------ the state
def _state_columns(targets, cfg: FlowConfig) -> list[str]:
    out = []
    for t in targets:
        out += [f"__{t}_x1", f"__{t}_r1", f"__{t}_r2", f"__{t}_f", f"__{t}_s", *_kept(t)]
        out += [f"__{t}_e{TE.alpha_tag(a)}_{k}" for a in cfg.ewm_alphas for k in ("w", "w2", "s1", "s2")]
    return out


def initial_state(df: DataFrame, targets=TARGETS, cfg: FlowConfig = FlowConfig(), key: str = K, date: str = D) -> DataFrame:
    """One row a fund: its last date, number of rows, ring of each target's last values, and the sums."""
    targets = list(targets)
    s = _with_sums(df.select(key, date, *targets).na.drop("any", subset=targets), targets, cfg, key, date)
    newest = Window.partitionBy(key).orderBy(F.col(date).desc())
    s = s.withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= RING)
    last = F.col("__back") == 1
    held = [F.max(F.when(last, F.col(c))).alias(c) for c in _state_columns(targets, cfg)]
    rings = F.array_sort(F.collect_list(F.struct(-F.col("__back"), *targets)))
    g = s.groupBy(key).agg(F.max(date).alias("last_date"), F.max("__rn").cast("double").alias("n"), rings.alias("ring"), *held)
    return g.select(
        key, "last_date", "n", *[F.transform("ring", _field(t)).alias(f"__{t}_ring") for t in targets], *_state_columns(targets, cfg)
    )


def _field(name: str):
    return lambda e: e[name].cast("double")


def _back(ring: Column, n: int) -> Column:
    """The n-th value from the end, NULL where there are fewer."""
    return F.try_element_at(ring, F.lit(-n))


def _frame(ring: Column, n: int) -> Column:
    size = F.size(ring)
    return F.slice(ring, F.greatest(size - n + 1, F.lit(1)), F.lit(n))


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values).cast("double"))


def _std(values: Column) -> Column:
    m = _mean(values)
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1)))


def _changes(ring: Column, n: Column, p: int) -> Column:
    """The last p day-on-day changes; the first row's counts as 0."""
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.size(ring)), lambda a, b: b - a)
    return _frame(F.when(n <= F.size(ring), F.concat(F.array(F.lit(0.0)), pairs)).otherwise(pairs), p)


def _up(change: Column) -> Column:
    return F.greatest(change, F.lit(0.0))


def _down(change: Column) -> Column:
    return F.greatest(-change, F.lit(0.0))


def state_features(state: DataFrame, day: dt.date, targets=TARGETS, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Adds the features of ``day``, read from the state of the day before it."""
    n = F.col("n")
    out = []
    for t in targets:
        ring = F.col(f"__{t}_ring")
        last = _back(ring, 1)
        out += [_back(ring, k).alias(f"{t}_lag_{k}") for k in cfg.lag_periods]
        for k in cfg.rolling_windows:
            f = _frame(ring, k)
            stats = {"mean": _mean(f), "std": _std(f), "max": F.array_max(f), "min": F.array_min(f)}
            out += [c.alias(f"{t}_roll_{name}_{k}") for name, c in stats.items()]
        for k in cfg.diff_periods:
            out.append((last - _back(ring, k + 1)).alias(f"{t}_diff_{k}"))
            out.append((F.try_divide(last, _back(ring, k + 1)) - F.lit(1.0)).alias(f"{t}_pct_change_{k}"))
        for k in cfg.bollinger_windows:
            mean, std = _mean(_frame(ring, k)), _std(_frame(ring, k))
            up, low = mean + F.lit(2.0) * std, mean - F.lit(2.0) * std
            out += [up.alias(f"{t}_bb_upper_{k}"), low.alias(f"{t}_bb_lower_{k}")]
            out += [eps_ratio(up - low, mean).alias(f"{t}_bb_width_{k}"), eps_ratio(last - low, up - low).alias(f"{t}_bb_position_{k}")]
        for p in cfg.rsi_periods:
            changes = _changes(ring, n, p)
            gain, loss = _mean(F.transform(changes, _up)), _mean(F.transform(changes, _down))
            rs = F.try_divide(gain, loss + F.lit(EPS))
            out.append((F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + rs)).alias(f"{t}_rsi_{p}"))
        out += _from_sums(t, n, cfg)
    return state.select("*", *out, *calendar_columns(F.lit(day).cast("date")))


def advanced(state: DataFrame, day: dt.date, targets=TARGETS, cfg: FlowConfig = FlowConfig(), key: str = K) -> DataFrame:
    """The state one row later, with the values of the columns ``{target}_pred``."""
    fast, slow, signal = (TE.span_alpha(s) for s in TE.MACD_SPANS)
    out = [F.col(key), F.lit(day).cast("date").alias("last_date"), (F.col("n") + 1).alias("n")]
    for t in targets:
        x, off = F.col(f"{t}_pred"), F.col(f"{t}_pred") - F.col(f"__{t}_x1")
        out.append(_frame(F.concat(F.col(f"__{t}_ring"), F.array(x)), RING).alias(f"__{t}_ring"))
        out += [
            F.col(f"__{t}_x1"),
            (F.col(f"__{t}_r1") + off).alias(f"__{t}_r1"),
            (F.col(f"__{t}_r2") + off * off).alias(f"__{t}_r2"),
            (F.col(f"{t}_cumsum") + x).alias(f"{t}_cumsum"),
            F.greatest(f"{t}_cummax", x).alias(f"{t}_cummax"),
            F.least(f"{t}_cummin", x).alias(f"{t}_cummin"),
            (F.col(f"{t}_cumprod_log") + F.log1p(x)).alias(f"{t}_cumprod_log"),
        ]
        f, s = F.col(f"__{t}_f") * (1 - fast) + x * fast, F.col(f"__{t}_s") * (1 - slow) + x * slow
        out += [f.alias(f"__{t}_f"), s.alias(f"__{t}_s"), (f - s).alias(f"{t}_macd")]
        out.append((F.col(f"{t}_macd_signal") * (1 - signal) + (f - s) * signal).alias(f"{t}_macd_signal"))
        for a in cfg.ewm_alphas:
            e = f"__{t}_e{TE.alpha_tag(a)}"
            out += [
                (F.col(f"{e}_w") * (1 - a) + 1).alias(f"{e}_w"),
                (F.col(f"{e}_w2") * (1 - a) ** 2 + 1).alias(f"{e}_w2"),
                (F.col(f"{e}_s1") * (1 - a) + off).alias(f"{e}_s1"),
                (F.col(f"{e}_s2") * (1 - a) + off * off).alias(f"{e}_s2"),
            ]
    return state.select(*out)


def recursive_model_forecast(df: DataFrame, predict: Predict, start: dt.date, n_days: int = 7, targets=TARGETS,
                             cfg: FlowConfig = FlowConfig(), floor: float = 0.0, key: str = K, date: str = D) -> DataFrame:
    """key, date, day_idx and the targets' forecasts for ``n_days`` days from ``start``.

    ``predict`` takes a frame with the features (``feature_names``) and adds ``{target}_pred``.  A prediction
    that is NULL or NaN is replaced by the fund's last value, one below ``floor`` by the floor.
    """
    targets = list(targets)
    state = cut_lineage(initial_state(df.where(F.col(date) < F.lit(start)), targets, cfg, key, date))
    names = state.columns
    out: DataFrame | None = None
    for i in range(n_days):
        day = start + dt.timedelta(days=i)
        known = predict(state_features(state, day, targets, cfg)).select(*names, *[f"{t}_pred" for t in targets])
        for t in targets:
            value = F.col(f"{t}_pred")
            usable = value.isNotNull() & ~F.isnan(value)
            carried = F.when(usable, F.greatest(value, F.lit(floor))).otherwise(_back(F.col(f"__{t}_ring"), 1))
            known = known.withColumn(f"{t}_pred", carried)
        state = cut_lineage(advanced(known, day, targets, cfg, key).select(*names))
        rows = state.select(
            key, F.col("last_date").alias(date), F.lit(i).alias("day_idx"), *[_back(F.col(f"__{t}_ring"), 1).alias(t) for t in targets]
        )
        out = rows if out is None else out.unionByName(rows)
    return out
