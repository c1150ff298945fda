"""Semantic per-fund attributes.

The attribute step works in three tables, all keyed by fund:

* prompts   (fund, kind, temperature, prompt)  built from A1-A17   (L1)
* responses (fund, kind, response)             free text answers   (input)
* attributes one row per fund, 48 named columns + embed_0..15      (L2-L10)

No model is called here: answering prompts is outside the data plane.
Responses are parsed with ``regexp_extract`` + ``from_json`` into a
``map<string,string>``; numeric keys are cast and clamped by a rule on the
key name, missing or bad values take the defaults, and the four kinds are
merged with later kinds winning on a shared key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.operators.stats import all_fund_stats
from ebbflow.schema import D, K

KINDS = ("fund", "behavior", "signal", "risk")
TEMPERATURES = {"fund": 0.2, "behavior": 0.3, "signal": 0.2, "risk": 0.2}

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Default answers per kind, in the reference order.  None marks the fund-kind
# keys whose default comes from the fund code.
DEFAULTS: dict[str, list[tuple[str, object]]] = {
    "fund": [
        ("fund_description", None),
        ("fund_category", None),
        ("fund_style", None),
        ("risk_level", None),
        ("expected_return", None),
        ("volatility_level", None),
        ("liquidity_rating", 6.0),
        ("management_capability", 7.0),
        ("market_beta", 1.0),
        ("sector_concentration", "适中"),
        ("investment_horizon", 12),
        ("expense_ratio_level", "中"),
        ("performance_consistency", 6.0),
    ],
    "behavior": [
        ("investor_type", "混合型"),
        ("trading_pattern", "长期持有"),
        ("flow_stability", 6.0),
        ("momentum_factor", 0.3),
        ("reversion_factor", 0.4),
        ("seasonality_score", 0.2),
        ("sentiment_sensitivity", 0.5),
        ("liquidity_demand", "中"),
        ("concentration_risk", 0.3),
        ("behavioral_bias", "无明显偏差"),
        ("stress_response", "理性调整"),
        ("market_timing", 0.4),
    ],
    "signal": [
        ("trend_direction", "震荡"),
        ("trend_strength", 0.3),
        ("momentum_signal", 0.0),
        ("overbought_oversold", "正常"),
        ("volume_confirmation", "中"),
        ("breakout_probability", 0.3),
        ("reversal_probability", 0.3),
        ("volatility_forecast", "正常"),
        ("support_level", 0.5),
        ("resistance_level", 0.5),
        ("signal_quality", 0.5),
        ("prediction_confidence", 0.5),
    ],
    "risk": [
        ("overall_risk", "中"),
        ("systematic_risk", 0.6),
        ("idiosyncratic_risk", 0.4),
        ("liquidity_risk", 0.3),
        ("concentration_risk", 0.3),
        ("tail_risk_level", 0.3),
        ("stress_resilience", 0.6),
        ("downside_protection", 0.5),
        ("volatility_regime", "中"),
        ("risk_adjusted_return", 0.5),
        ("stability_score", 0.6),
        ("crisis_performance", "一般"),
    ],
}
# Code-derived fund defaults: (category, style, risk_level, expected_return, volatility)
# for first digit 0; 1; 2 or prefix 51; 3 or 4; 5; anything else.
CODE_RULES = [
    (("0",), ("股票型", "成长", 4, 8.0, "中高")),
    (("1",), ("债券型", "价值", 2, 4.0, "低")),
    (("2", "51"), ("混合型", "平衡", 3, 6.0, "中")),
    (("3", "4"), ("货币型", "稳健", 1, 2.5, "低")),
    (("5",), ("指数型", "被动", 3, 7.0, "中")),
]
CODE_OTHER = ("混合型", "平衡", 3, 6.0, "中")
QUANT_MARKS = ("88", "99")  # codes containing these: style 量化, expected return + 1
QUANT_STYLE = "量化"
QDII_SUFFIXES = ("01", "02", "03")  # six-digit codes ending so: QDII, risk 4, volatility 高
QDII = ("QDII", 4, "高")
DESCRIPTION_FORMAT = "%s基金，%s投资策略"  # (category without 型, style)
SHORT_TEXT_DEFAULT = "混合型基金，多元化投资策略"
EMBED_DIMS = (0, 1, 2, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65)
# Clamp rule keyed by name fragments, first match wins.
CLAMP_LEVEL = ("level", "rating", "score")
CLAMP_UNIT = ("factor", "probability", "confidence")
# ---------------------------------------------------------------------------

ATTRIBUTE_KEYS: list[str] = list(dict.fromkeys(k for kind in KINDS for k, _ in DEFAULTS[kind]))
NUMERIC_KEYS = {"risk_level", "expected_return", "investment_horizon"} | {
    k for kind in KINDS for k, v in DEFAULTS[kind] if isinstance(v, (int, float)) and not isinstance(v, bool)
}
TEXT_KEYS = [k for k in ATTRIBUTE_KEYS if k not in NUMERIC_KEYS]


def clamp_range(key: str, default) -> tuple[float, float] | None:
    """L3: the clamp interval the reference applies to a numeric answer, by key name."""
    if any(m in key for m in CLAMP_LEVEL):
        return (1.0, 10.0) if "10" in str(default) else (1.0, 5.0)
    if any(m in key for m in CLAMP_UNIT) or key.endswith("_score"):
        return (0.0, 1.0)
    if "beta" in key:
        return (0.1, 3.0)
    if "return" in key or "volatility" in key:
        return (-100.0, 100.0)
    return None


def clamp_rules(spark) -> DataFrame:
    """(kind, key, is_numeric, lo, hi) for every default key: the L3 rule table."""
    rows = []
    for kind in KINDS:
        for k, v in DEFAULTS[kind]:
            num = k in NUMERIC_KEYS
            dflt = v if v is not None else {"risk_level": 3, "expected_return": 6.0}.get(k, "")
            rng = clamp_range(k, dflt) if num else None
            rows.append((kind, k, num, rng[0] if rng else None, rng[1] if rng else None))
    return spark.createDataFrame(rows, "kind string, key string, is_numeric boolean, lo double, hi double")


# ------------------------------------------------------------------------ L5
def code_inference_columns(code: Column) -> dict[str, Column]:
    """Category, style, risk level, expected return, volatility and description from the code."""

    def pick(i):
        expr = None
        for prefixes, vals in CODE_RULES:
            cond = None
            for p in prefixes:
                c = code.startswith(p)
                cond = c if cond is None else (cond | c)
            expr = F.when(cond, F.lit(vals[i])) if expr is None else expr.when(cond, F.lit(vals[i]))
        return expr.otherwise(F.lit(CODE_OTHER[i]))

    category, style, risk, ret, vol = (pick(i) for i in range(5))
    quant = code.contains(QUANT_MARKS[0]) | code.contains(QUANT_MARKS[1])
    style = F.when(quant, F.lit(QUANT_STYLE)).otherwise(style)
    ret = F.when(quant, ret + F.lit(1.0)).otherwise(ret)
    qdii = (F.length(code) == F.lit(6)) & (
        code.endswith(QDII_SUFFIXES[0]) | code.endswith(QDII_SUFFIXES[1]) | code.endswith(QDII_SUFFIXES[2])
    )
    category = F.when(qdii, F.lit(QDII[0])).otherwise(category)
    risk = F.when(qdii, F.lit(QDII[1])).otherwise(risk)
    vol = F.when(qdii, F.lit(QDII[2])).otherwise(vol)
    desc = F.format_string(DESCRIPTION_FORMAT, F.regexp_replace(category, "型", ""), style)
    return {
        "fund_category": category,
        "fund_style": style,
        "risk_level": risk.cast("double"),
        "expected_return": ret.cast("double"),
        "volatility_level": vol,
        "fund_description": desc,
    }


# ------------------------------------------------------------------------ L6
def default_value_columns(code: Column, only: str | None = None) -> dict[str, Column]:
    """Every attribute's default as a column (code-derived for the fund kind); of one kind at will.

    A key that two kinds have takes the later kind's default, as it does in merged answers.
    """
    inferred = code_inference_columns(code)
    out: dict[str, Column] = {}
    for kind in KINDS if only is None else (only,):
        for k, v in DEFAULTS[kind]:
            if v is None:
                out[k] = inferred[k]
            elif k in NUMERIC_KEYS:
                out[k] = F.lit(float(v))
            else:
                out[k] = F.lit(v)
    return out


def default_attributes(funds: DataFrame, key: str = K) -> DataFrame:
    """L6 + L5: the default attribute row of every fund (48 attributes + 16 zero embeddings)."""
    cols = default_value_columns(F.col(key))
    return funds.select(key).distinct().select(
        key, *[cols[k].alias(k) for k in ATTRIBUTE_KEYS], *[F.lit(0.0).alias(f"embed_{i}") for i in range(16)]
    )


# ------------------------------------------------------------------------ L1
PROMPT_STATS = {
    "fund": ["history_days", "avg_apply", "avg_redeem", "std_apply", "std_redeem", "max_apply", "max_redeem", "avg_net_flow"],
    "behavior": ["correlation", "net_flow_vol", "apply_trend", "redeem_trend", "weekend_ratio", "month_end_ratio", "concentration"],
    "signal": ["rsi", "momentum", "bollinger_pos", "volume_trend", "trend_strength", "support_resistance"],
    "risk": ["var95", "max_drawdown", "sharpe", "volatility", "skewness", "kurtosis", "tail_risk"],
}
PROMPT_TITLE = {
    "fund": "fundamentals",
    "behavior": "investor behaviour",
    "signal": "quantitative signals",
    "risk": "risk profile",
}


def prompt_table(stats: DataFrame, key: str = K) -> DataFrame:
    """L1: (fund, kind, temperature, prompt) from the A1-A17 statistics (one row per fund and kind)."""
    rows = []
    for kind in KINDS:
        lines = [F.format_string(f"- {s}: %.3f", F.coalesce(F.col(s).cast("double"), F.lit(0.0))) for s in PROMPT_STATS[kind]]
        keys = ", ".join(k for k, _ in DEFAULTS[kind])
        text = F.concat_ws(
            "\n",
            F.format_string(f"Analyse the {PROMPT_TITLE[kind]} of fund %s over its recent history.", F.col(key)),
            *lines,
            F.lit(f"Answer with one JSON object with the keys: {keys}."),
        )
        rows.append(F.struct(F.lit(kind).alias("kind"), F.lit(TEMPERATURES[kind]).alias("temperature"), text.alias("prompt")))
    return stats.select(key, F.explode(F.array(*rows)).alias("p")).select(key, "p.kind", "p.temperature", "p.prompt")


# ----------------------------------------------------------------- L2-L4
def extract_json_map(response: Column) -> Column:
    """L2: first '{' to last '}' (across lines) parsed as map<string,string>; NULL when absent or malformed.

    The text is read as the one element of a JSON array: two objects, or one with
    something after it, are not one element, and single quotes are no quotes.
    """
    body = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    array = F.from_json(
        F.concat(F.lit("["), body, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    )
    return F.when((F.length(body) > F.lit(0)) & (F.size(array) == F.lit(1)), F.try_element_at(array, F.lit(1)))


def parse_responses(responses: DataFrame, key: str = K) -> DataFrame:
    """L2-L4 per (fund, kind): numeric answers cast + clamped, bad or missing ones NULL (-> default later).

    Output: key, kind, ``parsed`` (map of the kind's known keys to cleaned text
    values), ``extra`` (keys outside the defaults, kept as text).
    """
    m = extract_json_map(F.col("response"))
    known_by_kind = {kind: [k for k, _ in DEFAULTS[kind]] for kind in KINDS}
    entries = []
    for kind in KINDS:
        for k, v in DEFAULTS[kind]:
            raw = F.try_element_at(m, F.lit(k))
            if k in NUMERIC_KEYS:
                dflt = v if v is not None else {"risk_level": 3, "expected_return": 6.0}[k]
                x = F.trim(raw).try_cast("double")
                x = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
                rng = clamp_range(k, dflt)
                if rng:
                    # greatest/least skip NULL: a failed cast must stay NULL (-> default)
                    x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(rng[0])), F.lit(rng[1])))
                val = x.cast("string")
            else:
                val = raw
            entries.append((kind, k, val))
    parsed = F.map_from_entries(
        F.filter(
            F.array(
                *[
                    F.struct(F.lit(k).alias("key"), F.when(F.col("kind") == F.lit(kind), v).alias("value"))
                    for kind, k, v in entries
                ]
            ),
            lambda e: e["value"].isNotNull(),
        )
    )
    known = F.create_map(*[x for kind in KINDS for k in known_by_kind[kind] for x in (F.lit(f"{kind}:{k}"), F.lit(True))])
    extra = F.map_filter(m, lambda k, v: F.try_element_at(known, F.concat(F.col("kind"), F.lit(":"), k)).isNull())
    empty = F.create_map().cast("map<string,string>")
    return responses.select(key, "kind", parsed.alias("parsed"), F.coalesce(extra, empty).alias("extra"), "response")


def kind_defaults(kind: str, code: Column) -> Column:
    """The default answer of a kind as map<string,string>."""
    values = default_value_columns(code, kind)
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def over(first: Column, then: Column) -> Column:
    """Both maps' keys; where both have one, the value of ``then``."""
    return F.map_zip_with(first, then, lambda k, a, b: F.coalesce(b, a))


def merge_kinds(parsed: DataFrame, key: str = K) -> DataFrame:
    """L4 + L8: one row per fund with ``answers`` (map): each kind's answer is completed with its own
    defaults, then a later kind's values replace an earlier one's.

    Of several answers of one kind, the one with the largest text counts.
    """
    picked = parsed.where(F.col("kind").isin(*KINDS)).groupBy(key).agg(
        *[
            F.max_by(
                F.when(F.col("kind") == F.lit(kind), over(F.col("extra"), F.col("parsed"))),
                F.when(F.col("kind") == F.lit(kind), F.coalesce("response", F.lit(""))),
            ).alias(f"__{kind}")
            for kind in KINDS
        ]
    )
    empty = F.create_map().cast("map<string,string>")
    merged = None
    for kind in KINDS:
        full = over(kind_defaults(kind, F.col(key)), F.coalesce(F.col(f"__{kind}"), empty))
        merged = full if merged is None else over(merged, full)
    return picked.select(key, merged.alias("answers"))


def attributes_from_responses(funds: DataFrame, responses: DataFrame, embeddings: DataFrame | None = None,
                              min_rows: int = 7, key: str = K, date: str = D) -> DataFrame:
    """Attribute row per fund; funds with < 7 rows (or no answer) take the defaults.

    ``embeddings`` (key, embedding) fills the embedding columns (L9), 0.0 without one.  Keys that
    no kind knows are kept, as text, in the map ``extra``.
    """
    counts = funds.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    answers = merge_kinds(parse_responses(responses, key), key)
    j = counts.join(answers, key, "left")
    if embeddings is None:
        vectors = [F.lit(0.0).alias(f"embed_{i}") for i in range(16)]
    else:
        j = j.join(embeddings.select(key, F.col("embedding").alias("__vec")), key, "left")
        vectors = embedding_columns(F.when(F.col("__rows") >= F.lit(min_rows), F.col("__vec")))
    dflt = default_value_columns(F.col(key))
    given = F.when(F.col("__rows") >= F.lit(min_rows), F.col("answers"))
    cols = []
    for k in ATTRIBUTE_KEYS:
        got = F.try_element_at(given, F.lit(k))
        got = got.try_cast("double") if k in NUMERIC_KEYS else got
        cols.append(F.coalesce(got, dflt[k]).alias(k))
    rest = F.map_filter(given, lambda k, v: ~k.isin(ATTRIBUTE_KEYS))
    extra = F.coalesce(rest, F.create_map().cast("map<string,string>")).alias("extra")
    return j.select(key, *cols, *vectors, extra)


# --------------------------------------------------------------- L9 / L10
def embedding_columns(arr: Column) -> list[Column]:
    """Dims 0,1,2,5,10,...,65 when the vector is longer than 65, else the first 16; 0.0 when missing."""
    long = F.size(arr) > F.lit(max(EMBED_DIMS))
    out = []
    for i, dim in enumerate(EMBED_DIMS):
        v = F.when(long, F.try_element_at(arr, F.lit(dim + 1))).otherwise(F.try_element_at(arr, F.lit(i + 1)))
        out.append(F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"embed_{i}"))
    return out


def description_text(text: Column) -> Column:
    """Text shorter than 10 characters (or NULL) becomes the fixed default description."""
    return F.when(text.isNull() | (F.length(text) < F.lit(10)), F.lit(SHORT_TEXT_DEFAULT)).otherwise(text)


# ------------------------------------------------------------------------ J1
def join_attributes(flows: DataFrame, attrs: DataFrame, key: str = K) -> DataFrame:
    """J1 + C15: left join of the per-fund attributes, then NULL numerics -> 0, text -> 'unknown'.

    The attribute table has one row per fund; it is broadcast only below
    Spark's size threshold (AQE decides from its runtime size).
    """
    j = flows.join(attrs, key, "left")
    num = [c for c in attrs.columns if c != key and c in NUMERIC_KEYS or c.startswith("embed_")]
    txt = [c for c in attrs.columns if c in TEXT_KEYS]
    return j.fillna(0.0, subset=num).fillna("unknown", subset=txt)


# --------------------------------------------------------------- L12 / L13
def stats_as_of(df: DataFrame, cutoff, key: str = K, date: str = D) -> DataFrame:
    """Rows up to ``cutoff`` only (the caller then runs A1-A17)."""
    return df.where(F.col(date) <= F.to_date(F.lit(str(cutoff))))


def monthly_fund_stats(df: DataFrame, n: int = 60, key: str = K, date: str = D) -> DataFrame:
    """A1 statistics as of each month end, from the last ``n`` rows up to that month.

    One bounded sliding frame per row; the month-end row of each (fund, month)
    carries the month's as-of values.  No month x rows join.
    """
    a, r = F.col("apply_amt"), F.col("redeem_amt")
    w = Window.partitionBy(key).orderBy(date).rowsBetween(-(n - 1), 0)
    month = F.trunc(F.col(date), "MM")
    s = df.select(
        key,
        date,
        month.alias("month"),
        F.avg(a).over(w).alias("avg_apply"),
        F.avg(r).over(w).alias("avg_redeem"),
        F.stddev_samp(a).over(w).alias("std_apply"),
        F.stddev_samp(r).over(w).alias("std_redeem"),
        F.max(a).over(w).alias("max_apply"),
        F.max(r).over(w).alias("max_redeem"),
        F.avg(a - r).over(w).alias("avg_net_flow"),
        F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)).alias("history_days"),
        F.row_number().over(Window.partitionBy(key, month).orderBy(F.col(date).desc())).alias("__last"),
    )
    return s.where(F.col("__last") == F.lit(1)).drop("__last", date)


def monthly_all_stats(df: DataFrame, n: int = 60, key: str = K, date: str = D) -> DataFrame:
    """A1-A17 as of each month end: key, month, history_days and every statistic of the last ``n`` rows up to it.

    Each row goes to the month ends among its own and the next ``n`` - 1 rows of its key, at most ``n`` and for
    daily rows about two, and the statistics run on (key, month) as they do on a key.
    """
    w = Window.partitionBy(key).orderBy(date)
    month = F.trunc(F.col(date), "MM")
    rows = df.select(key, date, "apply_amt", "redeem_amt", F.row_number().over(w).alias("__rn"), month.alias("__month"))
    last = F.coalesce(F.lead("__month", 1).over(w) != F.col("__month"), F.lit(True))
    rows = rows.withColumn("__end", F.when(last, F.col("__month")))
    rows = rows.withColumn("__ends", F.collect_set("__end").over(w.rowsBetween(0, n - 1)))
    sent = rows.withColumn("__as_of", F.explode("__ends"))
    sent = sent.select(F.struct(F.col(key).alias("key"), F.col("__as_of").alias("month")).alias("__asof"), date, "apply_amt", "redeem_amt", "__rn")
    history = sent.groupBy("__asof").agg(F.max("__rn").cast("long").alias("history_days"))
    stats = all_fund_stats(sent.drop("__rn"), n, "__asof", date).drop("history_days").join(history, "__asof")
    return stats.select(F.col("__asof.key").alias(key), F.col("__asof.month").alias("month"), *[c for c in stats.columns if c != "__asof"])


# ------------------------------------------------------------------------ L14
def repeat_consistency(runs: DataFrame, key: str = K) -> DataFrame:
    """Per (fund, attribute) the share of runs agreeing with the most common value.

    Input (key, run, attr, value).  Counts are a two-level groupBy, so a fund
    with many runs is still spread over tasks.
    """
    counts = runs.groupBy(key, "attr", "value").agg(F.count(F.lit(1)).alias("__c"))
    return counts.groupBy(key, "attr").agg(
        (F.max("__c") / F.sum("__c")).alias("consistency"), F.sum("__c").alias("runs")
    )
