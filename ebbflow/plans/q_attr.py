"""Queries for the semantic attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import attributes as AT
from ebbflow.operators import stats as S
from ebbflow.plans.catalog import R, flows, query, round_floats
from ebbflow.plans.oracle_sql import FLOWS_SQL, with_flows
from ebbflow.schema import D, K
from ebbflow.sources import adapters as A
from ebbflow.sources import io as IO

FUNDS_CTE = f"""fev AS ({FLOWS_SQL['events']}),
funds AS (SELECT DISTINCT fund_code FROM flows UNION SELECT DISTINCT fund_code FROM fev)"""


def _r(expr: str) -> str:
    return f"round({expr}, {R}) + 0.0"


def all_funds(spark, sf):
    return flows(spark, sf).select(K).unionByName(A.flows_from_events(spark, sf).select(K)).distinct()


def _code_sql(c: str = "fund_code") -> dict[str, str]:
    cat = (
        f"CASE WHEN starts_with({c}, '0') THEN '股票型' WHEN starts_with({c}, '1') THEN '债券型' "
        f"WHEN starts_with({c}, '2') OR starts_with({c}, '51') THEN '混合型' "
        f"WHEN starts_with({c}, '3') OR starts_with({c}, '4') THEN '货币型' WHEN starts_with({c}, '5') THEN '指数型' ELSE '混合型' END"
    )
    style = (
        f"CASE WHEN starts_with({c}, '0') THEN '成长' WHEN starts_with({c}, '1') THEN '价值' "
        f"WHEN starts_with({c}, '2') OR starts_with({c}, '51') THEN '平衡' "
        f"WHEN starts_with({c}, '3') OR starts_with({c}, '4') THEN '稳健' WHEN starts_with({c}, '5') THEN '被动' ELSE '平衡' END"
    )
    risk = (
        f"CASE WHEN starts_with({c}, '0') THEN 4 WHEN starts_with({c}, '1') THEN 2 "
        f"WHEN starts_with({c}, '2') OR starts_with({c}, '51') THEN 3 "
        f"WHEN starts_with({c}, '3') OR starts_with({c}, '4') THEN 1 WHEN starts_with({c}, '5') THEN 3 ELSE 3 END"
    )
    ret = (
        f"CASE WHEN starts_with({c}, '0') THEN 8.0 WHEN starts_with({c}, '1') THEN 4.0 "
        f"WHEN starts_with({c}, '2') OR starts_with({c}, '51') THEN 6.0 "
        f"WHEN starts_with({c}, '3') OR starts_with({c}, '4') THEN 2.5 WHEN starts_with({c}, '5') THEN 7.0 ELSE 6.0 END"
    )
    vol = (
        f"CASE WHEN starts_with({c}, '0') THEN '中高' WHEN starts_with({c}, '1') THEN '低' "
        f"WHEN starts_with({c}, '2') OR starts_with({c}, '51') THEN '中' "
        f"WHEN starts_with({c}, '3') OR starts_with({c}, '4') THEN '低' WHEN starts_with({c}, '5') THEN '中' ELSE '中' END"
    )
    quant = f"(contains({c}, '88') OR contains({c}, '99'))"
    qdii = f"(length({c}) = 6 AND (ends_with({c}, '01') OR ends_with({c}, '02') OR ends_with({c}, '03')))"
    category = f"CASE WHEN {qdii} THEN 'QDII' ELSE {cat} END"
    style_f = f"CASE WHEN {quant} THEN '量化' ELSE {style} END"
    return {
        "fund_category": category,
        "fund_style": style_f,
        "risk_level": f"CAST(CASE WHEN {qdii} THEN 4 ELSE {risk} END AS DOUBLE)",
        "expected_return": f"CAST({ret} + CASE WHEN {quant} THEN 1.0 ELSE 0.0 END AS DOUBLE)",
        "volatility_level": f"CASE WHEN {qdii} THEN '高' ELSE {vol} END",
        "fund_description": f"replace({category}, '型', '') || '基金，' || {style_f} || '投资策略'",
    }


CODE_COLS = ("fund_category", "fund_style", "risk_level", "expected_return", "volatility_level", "fund_description")


@query(
    "code_inference",
    with_flows(
        "SELECT fund_code, " + ", ".join(f"{v} AS {k}" for k, v in _code_sql().items()) + " FROM funds",
        extra_ctes=FUNDS_CTE,
    ),
)
def code_inference(spark, sf):
    """Category, style, risk, return, volatility and description inferred from the fund code."""
    funds = all_funds(spark, sf)
    cols = AT.code_inference_columns(F.col(K))
    return funds.select(K, *[cols[c].alias(c) for c in CODE_COLS])


def _defaults_sql() -> str:
    code = _code_sql()
    sel = []
    for k in AT.ATTRIBUTE_KEYS:
        if k in code:
            sel.append(f"{code[k]} AS {k}")
            continue
        v = next(v for kind in AT.KINDS for kk, v in AT.DEFAULTS[kind] if kk == k)
        sel.append(f"CAST({float(v)!r} AS DOUBLE) AS {k}" if k in AT.NUMERIC_KEYS else f"'{v}' AS {k}")
    sel += [f"CAST(0.0 AS DOUBLE) AS embed_{i}" for i in range(16)]
    return with_flows(f"SELECT fund_code, {', '.join(sel)} FROM funds", extra_ctes=FUNDS_CTE)


@query("default_attributes", _defaults_sql())
def default_attributes(spark, sf):
    """L6 (+L5): the default attribute row of every fund."""
    return AT.default_attributes(all_funds(spark, sf))


@query(
    "embedding_dims",
    "SELECT vec_id, "
    + ", ".join(
        f"coalesce(CAST(CASE WHEN len(embedding) > 65 THEN embedding[{d + 1}] ELSE embedding[{i + 1}] END AS DOUBLE), 0.0) AS embed_{i}"
        for i, d in enumerate(AT.EMBED_DIMS)
    )
    + " FROM embeddings",
)
def embedding_dims(spark, sf):
    """16 embedding dimensions from the embedding column (first 16 for vectors of <= 65 values)."""
    e = spark.read.parquet(f"{sf.rstrip('/')}/embeddings.parquet")
    return e.select("vec_id", *AT.embedding_columns(F.col("embedding")))


ATTR_SUBSET = "attrs AS (SELECT * FROM dflt WHERE fund_code IN (SELECT fund_code FROM flows GROUP BY fund_code HAVING count(*) >= 1500))"


def _attr_join_sql() -> str:
    d = _defaults_sql()
    dflt_body = d[d.index("SELECT fund_code, "):]
    return with_flows(
        "SELECT f.fund_code, f.transaction_date, f.apply_amt, coalesce(a.fund_category, 'unknown') AS fund_category, "
        "coalesce(a.risk_level, 0.0) AS risk_level, coalesce(a.market_beta, 0.0) AS market_beta, "
        "coalesce(a.embed_0, 0.0) AS embed_0 FROM flows f LEFT JOIN attrs a USING (fund_code)",
        extra_ctes=FUNDS_CTE + f",\ndflt AS ({dflt_body}),\n" + ATTR_SUBSET,
    )


def _attrs_subset(spark, sf):
    f = flows(spark, sf)
    keep = f.groupBy(K).count().where("count >= 1500").select(K)
    return f, AT.default_attributes(all_funds(spark, sf)).join(keep, K, "left_semi")


@query("attr_join", _attr_join_sql())
def attr_join(spark, sf):
    """J1 + C15: flows left-joined with the per-fund attributes; missing ones zero / 'unknown' filled."""
    f, attrs = _attrs_subset(spark, sf)
    j = AT.join_attributes(f, attrs)
    return j.select(K, D, "apply_amt", "fund_category", "risk_level", "market_beta", "embed_0")


def _audit_sql() -> str:
    d = _defaults_sql()
    dflt_body = d[d.index("SELECT fund_code, "):]
    cols = [c for c in ["fund_code", "transaction_date"] + AT.ATTRIBUTE_KEYS + [f"embed_{i}" for i in range(16)]
            if any(m in c for m in IO.SEMANTIC_MARKERS)]
    parts = [
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE a.{c} IS NULL) AS BIGINT) AS nulls, {len(cols)} AS n_semantic_columns "
        "FROM flows f LEFT JOIN attrs a USING (fund_code)"
        for c in cols
    ]
    return with_flows(" UNION ALL ".join(parts), extra_ctes=FUNDS_CTE + f",\ndflt AS ({dflt_body}),\n" + ATTR_SUBSET)


@query("attr_audit", _audit_sql())
def attr_audit(spark, sf):
    """S2 + S12: semantic columns found by name and their NULL counts after the attribute join."""
    f, attrs = _attrs_subset(spark, sf)
    j = f.join(attrs, K, "left")
    return IO.attribute_audit(j)


SAMPLED = ("fund_category", "risk_level", "embed_0")


@query(
    "attr_sample",
    f"SELECT fund_code, transaction_date, {', '.join(SAMPLED)} FROM ({_attr_join_sql()}) ORDER BY fund_code, transaction_date LIMIT 5",
)
def attr_sample(spark, sf):
    """The semantic columns of the first five rows after the attribute join."""
    f, attrs = _attrs_subset(spark, sf)
    return IO.attribute_sample(AT.join_attributes(f, attrs)).select(K, D, *SAMPLED)


MONTHLY_SQL = f"""SELECT fund_code, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
  {_r('avg(apply_amt) OVER w')} AS avg_apply, {_r('avg(redeem_amt) OVER w')} AS avg_redeem,
  {_r('stddev_samp(apply_amt) OVER w')} AS std_apply, {_r('stddev_samp(redeem_amt) OVER w')} AS std_redeem,
  max(apply_amt) OVER w AS max_apply, max(redeem_amt) OVER w AS max_redeem,
  {_r('avg(apply_amt - redeem_amt) OVER w')} AS avg_net_flow,
  count(*) OVER (PARTITION BY fund_code ORDER BY transaction_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history_days
FROM flows
WINDOW w AS (PARTITION BY fund_code ORDER BY transaction_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)
QUALIFY row_number() OVER (PARTITION BY fund_code, date_trunc('month', transaction_date) ORDER BY transaction_date DESC) = 1"""


@query("monthly_stats", with_flows(MONTHLY_SQL))
def monthly_stats(spark, sf):
    """A1 statistics as of every month end (last 60 rows up to that month)."""
    return round_floats(AT.monthly_fund_stats(flows(spark, sf)))


@query(
    "consistency",
    with_flows(
        f"""SELECT fund_code, attr, {_r('max(c) / sum(c)')} AS consistency, sum(c) AS runs FROM (
  SELECT fund_code, attr, value, count(*) AS c FROM (
    SELECT fund_code, month, 'flow_sign' AS attr, CASE WHEN avg_net_flow > 0 THEN 'in' ELSE 'out' END AS value FROM m
    UNION ALL
    SELECT fund_code, month, 'dispersion' AS attr, CASE WHEN std_apply > avg_apply THEN 'high' ELSE 'low' END AS value FROM m)
  GROUP BY fund_code, attr, value)
GROUP BY fund_code, attr""",
        extra_ctes=f"m AS ({MONTHLY_SQL})",
    ),
)
def consistency(spark, sf):
    """Agreement of monthly re-derived attributes per fund (share of the most common value)."""
    m = AT.monthly_fund_stats(flows(spark, sf))
    runs = m.select(
        K, F.col("month").alias("run"), F.lit("flow_sign").alias("attr"),
        F.when(F.col("avg_net_flow") > F.lit(0), F.lit("in")).otherwise(F.lit("out")).alias("value"),
    ).unionByName(
        m.select(
            K, F.col("month").alias("run"), F.lit("dispersion").alias("attr"),
            F.when(F.col("std_apply") > F.col("avg_apply"), F.lit("high")).otherwise(F.lit("low")).alias("value"),
        )
    )
    return round_floats(AT.repeat_consistency(runs))


def answer_stats(flows_df):
    """A few statistics per fund that the generated answers hold."""
    a, r = F.col("apply_amt"), F.col("redeem_amt")
    return flows_df.groupBy(K).agg(
        F.count(F.lit(1)).alias("n"), F.max(a).alias("top"), F.min(a).alias("low"), F.sum(a).alias("total"), F.sum(r).alias("out")
    )


def generated_answers(stats):
    """Answer texts derived from each fund's statistics: JSON in prose, some broken, some out of range, some missing keys."""
    h = F.substring(K, 1, 6).cast("int") % F.lit(5)
    out = []
    for kind in AT.KINDS:
        parts = {
            "fund": F.struct(
                (F.col("n") % F.lit(9)).alias("risk_level"),
                F.col("n").cast("string").alias("liquidity_rating"),
                (F.col("n") / F.lit(512.0)).alias("market_beta"),
                F.lit("成长").alias("fund_style"),
                F.col("n").alias("history"),
            ),
            "behavior": F.struct(
                (F.col("n") / F.lit(2048.0)).alias("momentum_factor"),
                F.lit("散户主导").alias("investor_type"),
                F.lit(0.9).alias("concentration_risk"),
            ),
            "signal": F.struct(F.lit("high").alias("signal_quality"), F.lit("上涨").alias("trend_direction")),
            "risk": F.struct(F.lit(0.8).alias("systematic_risk"), F.lit("高").alias("overall_risk")),
        }[kind]
        js = F.to_json(parts)
        text = (
            F.when(h == F.lit(0), F.concat(F.lit("analysis: {broken "), js))
            .when(h == F.lit(1), F.lit("no structured answer"))
            .when(h == F.lit(2), F.concat(F.lit("Result:\n"), js, F.lit("\nend")))
            .when(h == F.lit(3), F.concat(js, F.lit(" and "), js))
            .otherwise(js)
        )
        out.append(F.struct(F.lit(kind).alias("kind"), text.alias("response")))
    return stats.select(K, F.explode(F.array(*out)).alias("r")).select(K, "r.kind", "r.response")


PARSED_COLS = (
    "risk_level", "liquidity_rating", "market_beta", "fund_style", "momentum_factor", "investor_type", "concentration_risk",
    "signal_quality", "trend_direction", "systematic_risk", "overall_risk", "flow_stability",
)


def _parsed_sql() -> str:
    code = _code_sql()
    ok = "h IN (2, 4)"  # one JSON object, in prose or alone
    pick = {
        "risk_level": f"CASE WHEN {ok} THEN least(greatest(n % 9, 1), 5) ELSE {code['risk_level']} END",
        "liquidity_rating": f"CASE WHEN {ok} THEN least(greatest(n, 1), 5) ELSE 6 END",
        "market_beta": f"CASE WHEN {ok} THEN least(greatest(n / 512.0, 0.1), 3) ELSE 1 END",
        "fund_style": f"CASE WHEN {ok} THEN '成长' ELSE {code['fund_style']} END",
        "momentum_factor": f"CASE WHEN {ok} THEN least(greatest(n / 2048.0, 0), 1) ELSE 0.3 END",
        "investor_type": f"CASE WHEN {ok} THEN '散户主导' ELSE '混合型' END",
        "concentration_risk": "0.3",  # the risk answer comes later and lacks it: its default
        "signal_quality": "0.5",  # no number: the default
        "trend_direction": f"CASE WHEN {ok} THEN '上涨' ELSE '震荡' END",
        "systematic_risk": f"CASE WHEN {ok} THEN 0.8 ELSE 0.6 END",
        "overall_risk": f"CASE WHEN {ok} THEN '高' ELSE '中' END",
        "flow_stability": "6.0",
    }
    text = {"fund_style", "investor_type", "trend_direction", "overall_risk"}
    cols = [f"{v} AS {c}" if c in text else f"{_r(f'CAST({v} AS DOUBLE)')} AS {c}" for c, v in pick.items()]
    return with_flows(
        f"SELECT fund_code, {', '.join(cols)}, CASE WHEN {ok} THEN CAST(n AS VARCHAR) END AS history "
        "FROM (SELECT fund_code, count(*) AS n, CAST(fund_code AS INT) % 5 AS h FROM flows GROUP BY fund_code)"
    )


@query("parse_response", _parsed_sql())
def parse_response(spark, sf):
    """Answers parsed, clamped, defaulted per kind and merged into one attribute row per fund."""
    f = flows(spark, sf)
    rows = AT.attributes_from_responses(f, generated_answers(answer_stats(f)))
    return round_floats(rows.select(K, *PARSED_COLS, F.try_element_at("extra", F.lit("history")).alias("history")))


@query("prompt_table", None)
def prompt_table(spark, sf):
    """L1: the four analysis prompts per fund built from A1-A17 (rows-only)."""
    return AT.prompt_table(S.all_fund_stats(flows(spark, sf)))
