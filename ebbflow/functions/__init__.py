"""Column-expression helpers (native Catalyst expressions only)."""

from ebbflow.functions.exprs import (  # noqa: F401
    average_rank,
    bias_corrected_kurt,
    bias_corrected_skew,
    clip,
    eps_ratio,
    finite_or_null,
    fund_window,
    pct_change,
    safe_ratio,
    sample_corr,
)
