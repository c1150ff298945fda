"""Queries for fits over many folds, ensembles, boosted trees, saved bundles and the model's recursion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.operators import boosting as BO
from ebbflow.operators import bundle as BU
from ebbflow.operators import calendar as CAL
from ebbflow.operators import clean as C
from ebbflow.operators import ensemble as EN
from ebbflow.operators import lunisolar as LU
from ebbflow.operators import metrics as ME
from ebbflow.operators import normal_eq as NE
from ebbflow.operators import recursion as RE
from ebbflow.operators import split as SP
from ebbflow.plans import pipeline as PL
from ebbflow.plans.catalog import R, flows, query, written_flows
from ebbflow.plans.oracle_sql import with_flows
from ebbflow.plans.q_more import shared_path
from ebbflow.schema import D, K, TARGETS, FlowConfig
from ebbflow.session import cut_lineage
from ebbflow.sources import adapters as A
from ebbflow.sources.incremental import IncrementalFeatures

T2 = list(TARGETS)
PART = "PARTITION BY fund_code ORDER BY transaction_date"
LAGS = ("lag_1", "lag_7")
WINDOW, STEP = 90, 7


def lagged(spark, sf) -> DataFrame:
    """apply_amt and two of its lags, rows that have both."""
    w = Window.partitionBy(K).orderBy(D)
    cols = [F.lag("apply_amt", n).over(w).alias(f"lag_{n}") for n in (1, 7)]
    return flows(spark, sf).select(K, D, "apply_amt", *cols).na.drop("any")


LAGGED_CTE = f"""x AS (SELECT * FROM (SELECT fund_code, transaction_date AS d, apply_amt AS y, lag(apply_amt, 1) OVER ({PART}) AS a,
  lag(apply_amt, 7) OVER ({PART}) AS b FROM flows) WHERE b IS NOT NULL),
days AS (SELECT *, date_diff('day', (SELECT min(d) FROM x), d) AS n FROM x),
folds AS (SELECT unnest(range(0, CAST(floor(((SELECT max(n) FROM days) - {WINDOW}) / {STEP}.0) AS BIGINT) + 1)) AS fold),
m AS (SELECT fold, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
  covar_pop(a, y) AS ay, covar_pop(b, y) AS cy FROM folds JOIN days ON n >= fold * {STEP} AND n < fold * {STEP} + {WINDOW} GROUP BY fold),
fit AS (SELECT *, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS ca, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m)"""


@query(
    "walk_forward_scores",
    with_flows(
        f"SELECT fold, count(*) AS n, round(sum(abs(y - (my + ca * (a - ma) + cb * (b - mb)))) / sum(abs(y)), {R}) + 0.0 AS wmape "
        f"FROM fit JOIN days ON n >= fold * {STEP} + {WINDOW} AND n < fold * {STEP} + {WINDOW + STEP} GROUP BY fold",
        extra_ctes=LAGGED_CTE,
    ),
)
def walk_forward_scores(spark, sf):
    """M3: every fold of 90 days, a linear model of two lags, scored on the 7 days after it; one pass over the rows."""
    scores = NE.walk_forward_scores(lagged(spark, sf), list(LAGS), "apply_amt", WINDOW, STEP, l2=0.0)
    return scores.select("fold", "n", F.round("wmape", R).alias("wmape"))


@query("walk_forward_features", None)
def walk_forward_features(spark, sf):
    """M3: every fold over all features known the day before, for both targets."""
    f = cut_lineage(C.clean_flows(written_flows(spark, sf)).select(K, D, *T2))
    table = cut_lineage(RE.add_model_features(f))
    parts = [NE.walk_forward_scores(table, RE.feature_names(), t, WINDOW, STEP).select(F.lit(t).alias("target"), "*") for t in T2]
    return parts[0].unionByName(parts[1]).select("target", "fold", "n", F.round("wmape", R).alias("wmape"))


# ------------------------------------------------------------------------- M5
CANDIDATES = ("last", "week", "mean7", "mean14", "mean30")
ROUNDS = 6


def candidates(spark, sf) -> DataFrame:
    w = Window.partitionBy(K).orderBy(D)
    means = [F.avg("apply_amt").over(w.rowsBetween(-n, -1)).alias(f"mean{n}") for n in (7, 14, 30)]
    lags = [F.lag("apply_amt", n).over(w).alias(c) for n, c in ((1, "last"), (7, "week"))]
    return flows(spark, sf).select(K, D, "apply_amt", *lags, *means).na.drop("any")


def _selection_sql() -> str:
    mean = "avg(apply_amt) OVER ({0} ROWS BETWEEN {1} PRECEDING AND 1 PRECEDING) AS mean{1}"
    cols = ", ".join(mean.format(PART, n) for n in (7, 14, 30))
    ctes = [
        f"c AS (SELECT * FROM (SELECT apply_amt AS y, lag(apply_amt, 1) OVER ({PART}) AS last, lag(apply_amt, 7) OVER ({PART}) AS week, "
        f"{cols} FROM flows) WHERE week IS NOT NULL)",
        "w0 AS (SELECT " + ", ".join(f"0 AS n_{c}" for c in CANDIDATES) + ", 1e300 AS score, 0 AS k)",
    ]
    picked = " + ".join(f"n_{c} * {c}" for c in CANDIDATES)
    for k in range(1, ROUNDS + 1):
        errors = ", ".join(f"sum(abs(y - ({picked} + {c}) / {k}.0)) / sum(abs(y)) AS e_{c}" for c in CANDIDATES)
        ctes.append(f"e{k} AS (SELECT {errors} FROM c, w{k - 1})")
        least = "least(" + ", ".join(f"e_{c}" for c in CANDIDATES) + ")"
        adds = []
        for i, c in enumerate(CANDIDATES):
            earlier = "".join(f" AND e_{o} > {least}" for o in CANDIDATES[:i])
            adds.append(f"n_{c} + CASE WHEN e_{c} = {least}{earlier} THEN 1 ELSE 0 END AS n_{c}")
        ctes.append(f"w{k} AS (SELECT {', '.join(adds)}, {least} AS score, {k} AS k FROM e{k}, w{k - 1})")
    all_ = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, ROUNDS + 1))
    ctes.append(f"best AS (SELECT * FROM ({all_}) ORDER BY round(score, {EN.DIGITS}), k LIMIT 1)")
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS model, n_{c}::INTEGER AS picks, round(n_{c} / k::DOUBLE, {R}) + 0.0 AS weight, round(score, {R}) + 0.0 AS wmape FROM best"
        for c in CANDIDATES
    )
    return with_flows(rows, extra_ctes=",\n".join(ctes))


@query("ensemble_selection", _selection_sql())
def ensemble_selection(spark, sf):
    """M5: greedy selection with replacement among five simple forecasts."""
    out = EN.selection_table(cut_lineage(candidates(spark, sf)), "apply_amt", list(CANDIDATES), ROUNDS)
    return out.select("model", "picks", F.round("weight", R).alias("weight"), F.round("wmape", R).alias("wmape"))


@query("stacked_forecast", None)
def stacked_forecast(spark, sf):
    """M5: models of lags, rolling frames and indicators out of fold, a second level on them, and the selection."""
    f = cut_lineage(C.clean_flows(written_flows(spark, sf)).select(K, D, "apply_amt"))
    table = cut_lineage(RE.add_model_features(f, ["apply_amt"]))
    names = RE.feature_names(["apply_amt"])
    groups = {
        "lags": [c for c in names if "_lag_" in c or "_diff_" in c],
        "rolling": [c for c in names if "_roll_" in c],
        "all": names,
    }
    span = table.agg(F.min(D).alias("a"), F.datediff(F.max(D), F.min(D)).alias("n")).first()
    block = F.least(F.floor(F.datediff(D, F.lit(span["a"])) * 5 / F.lit((span["n"] or 0) + 1)), F.lit(4))
    out, _ = EN.stacked(table, groups, "apply_amt", block)
    return out.select(K, D, "apply_amt", *[F.round(c, R).alias(c) for c in ("base_lags", "base_rolling", "base_all", "level2", "ensemble")])


@query("bagged_scores", None)
def bagged_scores(spark, sf):
    """M5: five models, each of four fifths of the rows, scored on the rows they left out."""
    _, oof = NE.bagged(lagged(spark, sf), list(LAGS), "apply_amt")
    scores = ME.error_metrics(oof.withColumn("fold", NE.hash_fold(5)), "apply_amt", "apply_amt_oof", by=("fold",))
    return scores.select("fold", *[F.round(c, R).alias(c) for c in scores.columns if c != "fold"])


# ------------------------------------------------------------------------- M4
@query("boosted_trees", None)
def boosted_trees(spark, sf):
    """M4: boosted trees (20 of depth 4) from histograms on every feature known the day before, scored on the hold-out rows."""
    f = cut_lineage(C.clean_flows(written_flows(spark, sf)).select(K, D, *T2))
    table = cut_lineage(RE.add_model_features(f))
    train, valid = SP.holdout_split(table)
    parts = []
    for t in T2:
        scored = BO.fit_boosted(train, RE.feature_names(), t, trees=20, depth=4).transform(valid, f"{t}_pred")
        parts.append(ME.error_metrics(scored, t, f"{t}_pred").select(F.lit(t).alias("target"), "*"))
    out = parts[0].unionByName(parts[1])
    return out.select("target", *[F.round(c, R).alias(c) for c in out.columns if c != "target"])


# ------------------------------------------------------------- S10 / E2 / F10
@query("predict_only", None)
def predict_only(spark, sf):
    """The preparation and models saved as one bundle, loaded again, and the forecast made from them alone."""
    f = written_flows(spark, sf)
    table = cut_lineage(PL.training_table(f, A.holidays_for(f), select=False, fill=False))  # every pass of the fit reads it
    path = shared_path(spark, "bundle")
    BU.FlowEstimator("linear").fit(table).write().save(path)
    model = BU.FlowModel.load(path)
    start = f.agg(F.max(D)).first()[0] + dt.timedelta(days=1)
    return PL.submission(PL.predict_from_bundle(table, model, start))


@query("recursive_model", None)
def recursive_model(spark, sf):
    """seven days, each predicted by the model from features that hold the days predicted before it."""
    f = cut_lineage(C.clean_flows(written_flows(spark, sf)).select(K, D, *T2))  # the features, the state and the last date read it
    table = cut_lineage(RE.add_model_features(f))
    model = BU.FlowEstimator("linear").fit(table)
    start = f.agg(F.max(D)).first()[0] + dt.timedelta(days=1)
    return RE.recursive_model_forecast(f, model.transform, start, FlowConfig().prediction_days).select(
        K, D, "day_idx", *[F.round(t, R).alias(t) for t in T2]
    )


# ------------------------------------------------------------------- S5 / J4
@query(
    "incremental_features",
    with_flows(
        f"SELECT fund_code, transaction_date, apply_amt, lag(apply_amt, 1) OVER w AS apply_amt_lag_1, lag(apply_amt, 7) OVER w AS apply_amt_lag_7, "
        f"round(avg(apply_amt) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), {R}) + 0.0 AS apply_amt_roll_mean_7, "
        f"round(stddev_samp(apply_amt) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), {R}) + 0.0 AS apply_amt_roll_std_30, "
        "sum(apply_amt) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS apply_amt_cumsum, "
        "max(redeem_amt) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS redeem_amt_cummax "
        "FROM flows WINDOW w AS (PARTITION BY fund_code ORDER BY transaction_date)"
    ),
)
def incremental_features(spark, sf):
    """A feature table of all days but the last two, the days appended one after the other, and read whole."""
    f = cut_lineage(flows(spark, sf).select(K, D, *T2))
    last = f.agg(F.max(D)).first()[0]
    table = IncrementalFeatures(spark, shared_path(spark, "features"))
    for back in (2, 0):
        table.append(f.where(F.col(D) <= F.lit(last - dt.timedelta(days=back))))
    if not table.covers(f):
        raise ValueError("the appended table lacks rows")
    means = [F.round(c, R).alias(c) for c in ("apply_amt_roll_mean_7", "apply_amt_roll_std_30")]
    return table.read().select(
        K, D, "apply_amt", "apply_amt_lag_1", "apply_amt_lag_7", *means, "apply_amt_cumsum", "redeem_amt_cummax"
    )


# ------------------------------------------------------------------------ D5
@query("lunisolar_holidays", None)
def lunisolar_holidays(spark, sf):
    """Holiday, eve and day-after flags from the Chinese calendar's statutory days, new moons and solar terms computed."""
    f = flows(spark, sf).select(K, D, *T2)
    return CAL.add_holiday_flags(f, LU.chinese_holidays(f))
