"""Interaction features (I1-I6): per-row arithmetic, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.exprs import eps_ratio
from ebbflow.schema import present_uv


def flow_columns(a: str = "apply_amt", r: str = "redeem_amt") -> list[Column]:
    """I1 + I5: ratio, net flow, net-flow ratio, total volume, momentum, volatility."""
    A, Rd = F.col(a), F.col(r)
    return [
        eps_ratio(a, r).alias("apply_redeem_ratio"),
        (A - Rd).alias("net_flow"),
        eps_ratio(A - Rd, A + Rd).alias("net_flow_ratio"),
        (A + Rd).alias("total_volume"),
        (A * Rd).alias("flow_momentum"),
        F.sqrt(A * A + Rd * Rd).alias("flow_volatility"),
    ]


def uv_columns(df_columns, a: str = "apply_amt", r: str = "redeem_amt") -> list[Column]:
    """Total UV (NULL as 0), page shares, amounts per UV, conversions."""
    uvs = present_uv(df_columns)
    if not uvs:
        return []
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in uvs[1:]), F.coalesce(F.col(uvs[0]).cast("double"), F.lit(0.0)))
    out = [total.alias("total_uv")]
    for i, c in enumerate(uvs, 1):
        out.append(eps_ratio(c, total).alias(f"uv_page_{i}_ratio"))
    out += [
        eps_ratio(a, total).alias("apply_per_uv"),
        eps_ratio(r, total).alias("redeem_per_uv"),
        eps_ratio(F.col(a) + F.col(r), total).alias("volume_per_uv"),
    ]
    for c in uvs:
        out.append(eps_ratio(a, c).alias(f"{c}_apply_conversion"))
        out.append(eps_ratio(r, c).alias(f"{c}_redeem_conversion"))
    return out


def calendar_effect_columns(targets=("apply_amt", "redeem_amt")) -> list[Column]:
    """Target times the weekend / month-end / holiday flags (needs D2, D3, D5)."""
    out = []
    for t in targets:
        out += [
            (F.col(t) * F.col("is_weekend")).alias(f"{t}_weekend_effect"),
            (F.col(t) * F.col("is_month_end")).alias(f"{t}_month_end_effect"),
            (F.col(t) * F.col("is_holiday")).alias(f"{t}_holiday_effect"),
        ]
    return out


def add_interaction_features(df: DataFrame) -> DataFrame:
    """I1-I6 in the reference column order."""
    A, Rd = F.col("apply_amt"), F.col("redeem_amt")
    first = [
        eps_ratio("apply_amt", "redeem_amt").alias("apply_redeem_ratio"),
        (A - Rd).alias("net_flow"),
        eps_ratio(A - Rd, A + Rd).alias("net_flow_ratio"),
        (A + Rd).alias("total_volume"),
    ]
    tail = [(A * Rd).alias("flow_momentum"), F.sqrt(A * A + Rd * Rd).alias("flow_volatility")]
    cal = calendar_effect_columns() if "is_weekend" in df.columns else []
    return df.select("*", *first, *uv_columns(df.columns), *tail, *cal)
