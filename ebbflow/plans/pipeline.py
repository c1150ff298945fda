"""Composed plans: the reference's training run (E1) and prediction run.

``create_features`` issues every per-fund stage (calendar, windows,
history, interactions, technicals) as ``select``s over one window
partitioning, so the whole feature table costs one Exchange on
``fund_code`` (plus broadcast joins of the holiday flags); the optional
same-day cross-sectional stage adds one Exchange on the date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.operators import attributes as AT
from ebbflow.operators import calendar as CAL
from ebbflow.operators import clean as C
from ebbflow.operators import forecast as FC
from ebbflow.operators import interact as I
from ebbflow.operators import market as M
from ebbflow.operators import models as ML
from ebbflow.operators import select as SEL
from ebbflow.operators import split as SP
from ebbflow.operators import technical as TE
from ebbflow.operators import windows as W
from ebbflow.schema import D, K, FlowConfig
from ebbflow.session import cut_lineage, spread
from ebbflow.sources import io as IO

CALENDAR_COLS = (
    "month", "day_of_week", "day_of_month", "day_of_year", "week_of_year", "quarter", "is_weekend",
    "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end",
    "sin_month", "cos_month", "sin_day_of_week", "cos_day_of_week", "sin_day_of_year", "cos_day_of_year",
    "is_holiday", "is_before_holiday", "is_after_holiday", "work_days_since_month_start",
)


def create_features(flows: DataFrame, holidays: DataFrame | None = None, cfg: FlowConfig = FlowConfig(),
                    select: bool = False, fill: bool = True, cross_sectional: bool = False) -> DataFrame:
    """The reference feature stages in order; returns the wide feature table."""
    base_cols = list(flows.columns)
    # Stages that need their own sort run first, while rows are narrow: the
    # exact percentile (log2 levels) and the exponential block sums.
    df = M.add_historical_percentile(spread(flows, K), cfg.targets, cfg.rolling_windows)
    x5_cols = [c for c in df.columns if c not in base_cols]
    df = TE.add_technical_features(df, cfg.targets, cfg.ewm_alphas)
    tech_cols = [c for c in df.columns if c not in base_cols and c not in x5_cols]
    before = set(df.columns)
    df = CAL.add_date_features(df, holidays)
    date_cols = [c for c in df.columns if c not in before]
    # Every remaining stage is a select over the one (key, date) window.
    before = set(df.columns)
    df = W.add_time_series_features(df, cfg)
    ts_cols = [c for c in df.columns if c not in before]
    before = set(df.columns)
    df = df.select("*", *M.expanding_columns(cfg.targets), *M.historical_window_columns(cfg.targets, cfg.rolling_windows))
    hist_cols = [c for c in df.columns if c not in before]
    cs_cols = []
    if cross_sectional:
        before = set(df.columns)
        df = M.add_daily_features(df, cfg.targets)
        cs_cols = [c for c in df.columns if c not in before]
    before = set(df.columns)
    df = I.add_interaction_features(df)
    inter_cols = [c for c in df.columns if c not in before]
    # the reference column order
    df = df.select(*base_cols, *date_cols, *ts_cols, *hist_cols, *x5_cols, *cs_cols, *inter_cols, *tech_cols)
    if cfg.as_of == "previous_day":
        df = lag_same_day(df, [c for c in df.columns if c not in (K, D, *cfg.targets, *cfg.uv_cols, *CALENDAR_COLS)])
    return finish_features(df, cfg, select, fill)


def finish_features(df: DataFrame, cfg: FlowConfig = FlowConfig(), select: bool = True, fill: bool = True) -> DataFrame:
    """Validation and selection, then the fills, over the table written once to the shared folder."""
    if select or fill:
        df = cut_lineage(df)  # data-dependent decisions follow: do not recompute the table for each
    if select:
        df, _ = SEL.validate_and_select(df, cfg.max_correlation, cfg.max_missing_ratio, cfg.min_variance, cfg.max_feature_count, cfg.targets)
    return C.smart_fill(df) if fill else df


def training_table(flows: DataFrame, holidays: DataFrame | None = None, attrs: DataFrame | None = None,
                   cfg: FlowConfig = FlowConfig(), select: bool = True, fill: bool = True) -> DataFrame:
    """E1's table: clean (C1-C4), features, per-fund attributes (J1), selection (V1-V5), fills.

    The cleaned flows are written once: several later stages read them.
    """
    flows = cut_lineage(C.clean_flows(flows))
    feats = create_features(flows, holidays, cfg, select=False, fill=False)
    if attrs is not None:
        feats = AT.join_attributes(feats, attrs)
    return finish_features(feats, cfg, select, fill)


def lag_same_day(df: DataFrame, cols, key: str = K, date: str = D) -> DataFrame:
    """as_of='previous_day': every listed feature takes its value of the previous row."""
    w = Window.partitionBy(key).orderBy(date)
    cs = set(cols)
    return df.select(*[(F.lag(F.col(f"`{c}`"), 1).over(w).alias(c) if c in cs else F.col(f"`{c}`")) for c in df.columns])


def train(features: DataFrame, cfg: FlowConfig = FlowConfig(), kind: str = "gbt", overlap: bool = False):
    """E1 training part: hold-out split (M1), preparation (C8-C14), one model per target (M4).

    Returns the models and, per target, the prepared (train, valid) frames.
    """
    train_df, valid_df = SP.holdout_split(features, overlap=overlap)
    tr, va = C.prepare_frames(C.drop_all_null_rows(train_df), C.drop_all_null_rows(valid_df), cfg.targets)
    tr, va = cut_lineage(tr), cut_lineage(va)  # every tree level reads them
    models, prepared = {}, {}
    for t in cfg.targets:
        both = [C.floor_target_drop_nulls(df, t) for df in (tr, va)]
        models[f"{t}_model"] = ML.fit_target(both[0], t, kind, cfg.targets)
        prepared[t] = tuple(both)
    return models, prepared


def model_values_for_latest(features: DataFrame, models: dict, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Model value per fund from its latest feature row (the only model input the forecast uses)."""
    last = FC.latest_rows(features)
    out = last.select(K)
    for t in cfg.targets:
        m = models.get(f"{t}_model")
        if m is None:
            continue
        p = m.transform(last).select(K, F.col(f"{t}_pred").alias(f"{t}_model"))
        out = out.join(p, K, "left")
    return out


def predict(features: DataFrame, models: dict | None, start, cfg: FlowConfig = FlowConfig(), as_of_date=None) -> DataFrame:
    """Forecast rows for ``cfg.prediction_days`` days from ``start``."""
    mp = model_values_for_latest(features, models, cfg) if models else None
    return FC.forecast(features.select(K, D, *cfg.targets), start, cfg.prediction_days, mp, as_of_date, cfg.targets)


def predict_from_bundle(features: DataFrame, model, start, cfg: FlowConfig = FlowConfig(), as_of_date=None) -> DataFrame:
    """E2 from one loaded bundle (``FlowModel``): the model's value of each fund's latest row, blended into the forecast."""
    values = model.transform(FC.latest_rows(features)).select(K, *[F.col(f"{t}_pred").alias(f"{t}_model") for t in cfg.targets])
    return FC.forecast(features.select(K, D, *cfg.targets), start, cfg.prediction_days, values, as_of_date, cfg.targets)


def submission(fc: DataFrame, date_name: str = D) -> DataFrame:
    """The 4-column output with the date as yyyyMMdd text."""
    renamed = fc.select(K, D, F.col("apply_amt").alias("apply_amt_pred"), F.col("redeem_amt").alias("redeem_amt_pred"))
    return IO.submission(renamed, date_name)
