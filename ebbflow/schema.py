"""Column names, input schema and the run configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Key, date and targets of the flow table.
K = "fund_code"
D = "transaction_date"
TARGETS = ("apply_amt", "redeem_amt")
UV_COLS = ("uv_key_page_1", "uv_key_page_2", "uv_key_page_3")

# Guard added to denominators, as in the reference formulas.
EPS = 1e-8

FLOW_CSV_SCHEMA = T.StructType(
    [
        T.StructField(D, T.StringType()),
        T.StructField(K, T.StringType()),
        T.StructField("apply_amt", T.DoubleType()),
        T.StructField("redeem_amt", T.DoubleType()),
        T.StructField("uv_key_page_1", T.LongType()),
        T.StructField("uv_key_page_2", T.LongType()),
        T.StructField("uv_key_page_3", T.LongType()),
    ]
)


@dataclass(frozen=True)
class FlowConfig:
    """Parameters of the feature, selection and forecast steps.

    Fixed values that must equal the reference for equal results:
    lags 1, 3, 7, 14; rolling windows 7, 14, 30; difference periods 1, 7, 14;
    60 context rows for per-fund statistics; 7 forecast days; minimum 30 rows
    per fund; IQR factor 3; correlation threshold 0.95; missing ratio 0.8;
    variance floor 1e-8; feature-count warning at 500; top-k 200.
    """

    lag_periods: tuple[int, ...] = (1, 3, 7, 14)
    rolling_windows: tuple[int, ...] = (7, 14, 30)
    diff_periods: tuple[int, ...] = (1, 7, 14)
    ewm_alphas: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5)
    rsi_periods: tuple[int, ...] = (7, 14, 21)
    bollinger_windows: tuple[int, ...] = (14, 21)
    context_days: int = 60
    prediction_days: int = 7
    min_rows_per_fund: int = 30
    iqr_factor: float = 3.0
    max_correlation: float = 0.95
    max_missing_ratio: float = 0.8
    min_variance: float = 1e-8
    max_feature_count: int = 500
    top_k_features: int = 200
    targets: tuple[str, ...] = TARGETS
    uv_cols: tuple[str, ...] = UV_COLS
    # 'same_day' reproduces the reference (features may read today's target);
    # 'previous_day' lags every such feature by one row.
    as_of: str = "same_day"


def present_uv(df_columns) -> list[str]:
    """UV columns that exist in the frame, in their fixed order."""
    cols = set(df_columns)
    return [c for c in UV_COLS if c in cols]


def series_cols(df_columns, cfg: FlowConfig | None = None) -> list[str]:
    """Targets plus the UV columns present (the reference's extended list)."""
    cfg = cfg or FlowConfig()
    return list(cfg.targets) + present_uv(df_columns)
