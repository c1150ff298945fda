"""Queries for the technical indicators.

The oracle writes exponential weights out as a self-join over row numbers with
``power(1 - alpha, distance)`` over the whole history, and takes squares about the
weighted mean in a second pass; Spark's side has running block sums.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import technical as TE
from ebbflow.plans.catalog import R, flows, query
from ebbflow.plans.oracle_sql import with_flows
from ebbflow.schema import D, K

T2 = ("apply_amt", "redeem_amt")
ALPHAS = (0.1, 0.2, 0.3, 0.5)
PART = "PARTITION BY fund_code ORDER BY transaction_date"


def _r(expr: str) -> str:
    return f"round({expr}, {R}) + 0.0"


def _tech(spark, sf):
    return TE.add_technical_features(flows(spark, sf).select(K, D, *T2), T2, ALPHAS)


def _pick(df, names):
    return df.select(K, D, *[F.round(F.col(c), R).alias(c) for c in names])


RN = (
    "r AS (SELECT fund_code, transaction_date, apply_amt, redeem_amt, "
    f"row_number() OVER ({PART}) AS rn FROM flows)"
)


def _weight(a: float) -> str:
    return f"power({1 - a!r}, a.rn - b.rn)"


def _ewm_sql(kind: str) -> str:
    """Weights over the whole earlier history of the fund (pandas' infinite horizon)."""
    pairs = [(t, a, TE.alpha_tag(a)) for t in T2 for a in ALPHAS]
    join = "JOIN r b ON a.fund_code = b.fund_code AND b.rn <= a.rn"
    means = ", ".join(f"sum({_weight(a)} * b.{t}) / sum({_weight(a)}) AS m_{t}_{tag}" for t, a, tag in pairs)
    first = f"m AS (SELECT a.fund_code, a.transaction_date, a.rn, {means} FROM r a {join} GROUP BY ALL)"
    if kind == "mean":
        sel = ", ".join(f"{_r(f'm_{t}_{tag}')} AS {t}_ewm_{tag}" for t, _, tag in pairs)
        return with_flows(f"SELECT fund_code, transaction_date, {sel} FROM m", extra_ctes=f"{RN},\n{first}")
    sel = []
    for t, a, tag in pairs:
        w = _weight(a)
        dev = f"sum({w} * (b.{t} - a.m_{t}_{tag}) * (b.{t} - a.m_{t}_{tag}))"
        den = f"(sum({w}) * sum({w}) - sum({w} * {w}))"
        std = f"CASE WHEN count(*) > 1 THEN sqrt({dev} * sum({w}) / {den}) END"
        sel.append(f"{_r(std)} AS {t}_ewm_std_{tag}")
    body = f"SELECT a.fund_code, a.transaction_date, {', '.join(sel)} FROM m a {join} GROUP BY a.fund_code, a.transaction_date"
    return with_flows(body, extra_ctes=f"{RN},\n{first}")


@query("ewm_mean", _ewm_sql("mean"))
def ewm_mean(spark, sf):
    """Adjusted EWM mean, alpha 0.1 / 0.2 / 0.3 / 0.5."""
    return _pick(_tech(spark, sf), [f"{t}_ewm_{TE.alpha_tag(a)}" for t in T2 for a in ALPHAS])


@query("ewm_std", _ewm_sql("std"))
def ewm_std(spark, sf):
    """Bias-corrected adjusted EWM std."""
    return _pick(_tech(spark, sf), [f"{t}_ewm_std_{TE.alpha_tag(a)}" for t in T2 for a in ALPHAS])


@query(
    "cumulatives",
    with_flows(
        "SELECT fund_code, transaction_date, "
        + ", ".join(
            f"sum({t}) OVER wc AS {t}_cumsum, max({t}) OVER wc AS {t}_cummax, min({t}) OVER wc AS {t}_cummin, "
            f"{_r(f'sum(ln(1 + {t})) OVER wc')} AS {t}_cumprod_log"
            for t in T2
        )
        + f" FROM flows WINDOW wc AS ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ),
)
def cumulatives(spark, sf):
    """T3 + T4: running sum, max, min and sum of log(1+x)."""
    df = _tech(spark, sf)
    return df.select(
        K,
        D,
        *[
            c
            for t in T2
            for c in (
                F.col(f"{t}_cumsum"),
                F.col(f"{t}_cummax"),
                F.col(f"{t}_cummin"),
                F.round(F.col(f"{t}_cumprod_log"), R).alias(f"{t}_cumprod_log"),
            )
        ],
    )


def _rsi_sql() -> str:
    gl = ", ".join(
        f"CASE WHEN {t} - lag({t}) OVER ({PART}) > 0 THEN {t} - lag({t}) OVER ({PART}) ELSE 0 END AS g_{t}, "
        f"CASE WHEN {t} - lag({t}) OVER ({PART}) < 0 THEN lag({t}) OVER ({PART}) - {t} ELSE 0 END AS l_{t}"
        for t in T2
    )
    sel = []
    for t in T2:
        for p in (7, 14, 21):
            w = f"({PART} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
            sel.append(f"{_r(f'100 - 100 / (1 + avg(g_{t}) OVER {w} / (avg(l_{t}) OVER {w} + 1e-8))')} AS {t}_rsi_{p}")
    return with_flows(f"SELECT fund_code, transaction_date, {', '.join(sel)} FROM (SELECT *, {gl} FROM flows)")


@query("rsi", _rsi_sql())
def rsi(spark, sf):
    """T5: simple-mean RSI 7 / 14 / 21 including today."""
    return _pick(_tech(spark, sf), [f"{t}_rsi_{p}" for t in T2 for p in (7, 14, 21)])


def _ema_terms(alpha: float, x: str) -> str:
    """EMA (adjust=False) at row a over all rows b <= a, seeded by the fund's first value."""
    w = f"power({1 - alpha!r}, a.rn - b.rn)"
    return f"sum(CASE WHEN b.rn = 1 THEN {w} ELSE {alpha!r} * {w} END * {x})"


def _macd_sql() -> str:
    fast, slow, sig = TE.MACD_SPANS
    af, asl, ag = TE.span_alpha(fast), TE.span_alpha(slow), TE.span_alpha(sig)
    m_sel = ", ".join(f"{_ema_terms(af, 'b.' + t)} - {_ema_terms(asl, 'b.' + t)} AS m_{t}" for t in T2)
    s_sel = ", ".join(
        f"{_r('a.m_' + t)} AS {t}_macd, {_r(_ema_terms(ag, 'b.m_' + t))} AS {t}_macd_signal, "
        f"{_r('a.m_' + t + ' - ' + _ema_terms(ag, 'b.m_' + t))} AS {t}_macd_histogram"
        for t in T2
    )
    m_cte = (
        f"m AS (SELECT a.fund_code, a.transaction_date, a.rn, {m_sel} FROM r a JOIN r b "
        f"ON a.fund_code = b.fund_code AND b.rn <= a.rn "
        "GROUP BY a.fund_code, a.transaction_date, a.rn)"
    )
    return with_flows(
        f"""SELECT a.fund_code, a.transaction_date, {s_sel}
FROM m a JOIN m b ON a.fund_code = b.fund_code AND b.rn <= a.rn
GROUP BY a.fund_code, a.transaction_date, {', '.join('a.m_' + t for t in T2)}""",
        extra_ctes=RN + ",\n" + m_cte,
    )


@query("macd", _macd_sql())
def macd(spark, sf):
    """MACD (EMA12 - EMA26), its EMA9 signal and the histogram."""
    return _pick(_tech(spark, sf), [f"{t}_{s}" for t in T2 for s in ("macd", "macd_signal", "macd_histogram")])


def _bb_sql() -> str:
    sel = []
    for t in T2:
        for n in (14, 21):
            w = f"({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            sma, sd = f"avg({t}) OVER {w}", f"stddev_samp({t}) OVER {w}"
            up, lo = f"({sma} + 2 * {sd})", f"({sma} - 2 * {sd})"
            sel += [
                f"{_r(up)} AS {t}_bb_upper_{n}",
                f"{_r(lo)} AS {t}_bb_lower_{n}",
                f"{_r(f'({up} - {lo}) / ({sma} + 1e-8)')} AS {t}_bb_width_{n}",
                f"{_r(f'({t} - {lo}) / ({up} - {lo} + 1e-8)')} AS {t}_bb_position_{n}",
            ]
    return with_flows(f"SELECT fund_code, transaction_date, {', '.join(sel)} FROM flows")


@query("bollinger", _bb_sql())
def bollinger(spark, sf):
    """Bollinger bands 14 / 21 including today: upper, lower, width, position."""
    names = [f"{t}_bb_{s}_{n}" for t in T2 for n in (14, 21) for s in ("upper", "lower", "width", "position")]
    return _pick(_tech(spark, sf), names)
