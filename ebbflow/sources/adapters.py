"""Adapters from the driver tables to the flow table (one row per fund and day).

The flow table is an aggregate: its size is bounded by funds x calendar days,
whatever the size of the raw tables.  The raw scans get column pruning and
partial (map-side) aggregation from Catalyst; the join strategy is left to
Spark, whose broadcast threshold is the size check for the small side.

A fund-day of lineitems counts three keys distinctly.  Spark's count of several distinct columns
writes every row four times; sets of keys write it once, but a group's sets are held whole.  So days
of at most ``SET_ROWS`` lineitems, which bound their groups, are counted by sets and busier days by
Spark's distinct counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.schema import D, K

#: Lineitems of a day (or week) up to which the distinct keys of its funds are counted by sets.
SET_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code(expr) -> "F.Column":
    """Six-digit fund code with leading zeros."""
    return F.lpad(expr.cast("string"), 6, "0")


def _lineitem_amounts(li: DataFrame, day) -> DataFrame:
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    returned = F.col("l_returnflag") == F.lit("R")
    return li.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        day.alias(D),
        F.when(~returned, net).otherwise(F.lit(0.0)).alias("_apply"),
        F.when(returned, net).otherwise(F.lit(0.0)).alias("_redeem"),
    )


def _set_size(c: str) -> Column:
    return F.size(F.collect_set(c)).cast("bigint")


def _flow_agg(df: DataFrame, distinct: Callable[[str], Column]) -> DataFrame:
    return df.groupBy(K, D).agg(
        F.round(F.sum("_apply")).alias("apply_amt"),
        F.round(F.sum("_redeem")).alias("redeem_amt"),
        distinct("l_orderkey").alias("uv_key_page_1"),
        distinct("l_suppkey").alias("uv_key_page_2"),
        distinct("l_partkey").alias("uv_key_page_3"),
    )


def _flows(amounts: DataFrame, coded: Callable[[DataFrame], DataFrame], set_rows: int = SET_ROWS) -> DataFrame:
    """The flow table of lineitem amounts; ``coded`` adds the fund.  A day is counted by one of the two ways."""
    busy = amounts.groupBy(F.col(D).alias("__busy")).count().where(F.col("count") > F.lit(set_rows)).select("__busy")
    on_it = F.col(D).eqNullSafe(F.col("__busy"))
    few, many = (amounts.join(F.broadcast(busy), on_it, how) for how in ("left_anti", "left_semi"))
    return _flow_agg(coded(few), _set_size).unionByName(_flow_agg(coded(many), F.count_distinct))


def flows_from_lineitem(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    """Adapter A (fund = part brand); ``weekly=True`` is the dense A-week variant."""
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey",
        _code(F.substring("p_brand", 7, 10).cast("int") * F.lit(23801)).alias(K),
    )
    ship = F.col("l_shipdate")
    day = F.to_date(F.date_trunc("week", ship)) if weekly else F.to_date(ship)
    amounts = _lineitem_amounts(li, day)
    return _flows(amounts, lambda rows: rows.join(part, rows["l_partkey"] == part["p_partkey"], "inner").drop("p_partkey"))


def flows_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter C (fund = supplier), the bench input: no join."""
    li = read_table(spark, sf_dir, "lineitem")
    return _flows(_lineitem_amounts(li, F.to_date("l_shipdate")), lambda rows: rows.withColumn(K, _code(F.col("l_suppkey"))))


def flows_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B (fund = user bucket), short and dense."""
    ev = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return (
        ev.select(
            _code((F.col("user_id") % F.lit(20)) * F.lit(29003)).alias(K),
            F.to_date("ts").alias(D),
            F.when(et.isin("purchase", "signup"), F.col("value")).otherwise(F.lit(0.0)).alias("_apply"),
            F.when(et == F.lit("error"), F.col("value")).otherwise(F.lit(0.0)).alias("_redeem"),
            F.when(et == F.lit("view"), F.lit(1)).otherwise(F.lit(0)).alias("_view"),
            F.when(et == F.lit("click"), F.lit(1)).otherwise(F.lit(0)).alias("_click"),
            "user_id",
        )
        .groupBy(K, D)
        .agg(
            F.round(F.sum("_apply")).alias("apply_amt"),
            F.round(F.sum("_redeem")).alias("redeem_amt"),
            F.sum("_view").cast("bigint").alias("uv_key_page_1"),
            F.sum("_click").cast("bigint").alias("uv_key_page_2"),
            F.count_distinct("user_id").alias("uv_key_page_3"),
        )
    )


# Fixed holiday rule of the test fixtures: 1 January, 1 May and 1-7 October.
HOLIDAY_MONTH_DAYS = ((1, 1), (5, 1), (10, 1), (10, 2), (10, 3), (10, 4), (10, 5), (10, 6), (10, 7))


def holidays_for(flows: DataFrame) -> DataFrame:
    """Holiday table for every year the flows touch, plus one year either side.

    Its size is 9 rows per calendar year, so it is safe to broadcast.
    """
    years = flows.agg(
        (F.year(F.min(D)) - F.lit(1)).alias("y0"), (F.year(F.max(D)) + F.lit(1)).alias("y1")
    ).select(F.explode(F.sequence("y0", "y1")).alias("y"))
    md = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in HOLIDAY_MONTH_DAYS])
    return years.select(F.explode(md).alias("md"), "y").select(
        F.make_date("y", F.col("md.m"), F.col("md.d")).alias("holiday_date")
    )


ADAPTERS = {
    "lineitem": flows_from_lineitem,
    "lineitem_week": lambda spark, sf: flows_from_lineitem(spark, sf, weekly=True),
    "events": flows_from_events,
    "supplier": flows_by_supplier,
}
