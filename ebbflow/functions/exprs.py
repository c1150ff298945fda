"""Column-expression helpers shared by the operators.

Everything here builds native Catalyst expressions (no Python UDF), so the
operators stay inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ebbflow.schema import EPS, D, K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fund_window(key: str = K, date: str = D):
    """The per-key, date-ordered window every series feature uses."""
    return Window.partitionBy(key).orderBy(date)


def eps_ratio(num, den) -> Column:
    """``num / (den + 1e-8)``; NULL instead of an error or infinity."""
    return F.try_divide(col(num), col(den) + F.lit(EPS))


def safe_ratio(num, den) -> Column:
    """``num / den`` or NULL when ``den`` is 0 or NULL."""
    return F.try_divide(col(num), col(den))


def finite_or_null(c) -> Column:
    """NaN and +-infinity become NULL (the reference's ``replace([inf,-inf], nan)``)."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def pct_change(c, lagged) -> Column:
    """``c / lagged - 1``; NULL where the earlier value is 0 (pandas gives inf/NaN)."""
    return F.try_divide(col(c), col(lagged)) - F.lit(1.0)


def clip(c, lo, hi) -> Column:
    c = col(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def average_rank(order_col: str, partition_cols: list[str], ascending: bool = True) -> Column:
    """pandas ``rank(method='average')``: ties share the mean of their positions."""
    order = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    w = Window.partitionBy(*partition_cols).orderBy(order)
    w_ties = Window.partitionBy(*partition_cols, order_col)
    return F.rank().over(w) + (F.count(F.lit(1)).over(w_ties) - F.lit(1)) / F.lit(2.0)


def bias_corrected_skew(n: Column, g1: Column) -> Column:
    """pandas ``skew()`` from Spark's population skewness ``g1``."""
    return F.when(
        n > F.lit(2),
        g1 * F.sqrt(n * (n - F.lit(1))) / (n - F.lit(2)),
    )


def bias_corrected_kurt(n: Column, g2: Column) -> Column:
    """pandas ``kurt()`` (excess, unbiased) from Spark's population excess kurtosis."""
    return F.when(
        n > F.lit(3),
        (n - F.lit(1)) / ((n - F.lit(2)) * (n - F.lit(3))) * ((n + F.lit(1)) * g2 + F.lit(6.0)),
    )


def sample_corr(x, y) -> Column:
    """Pearson correlation aggregate that never raises under ANSI: NULL if undefined."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x)
    yy = F.when(both, y)
    return F.try_divide(F.covar_samp(xx, yy), F.stddev_samp(xx) * F.stddev_samp(yy))
