"""Ranks of all rows of a table in a total order, without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import blocks_for, written

#: Rows of one range, about.
RANGE_ROWS = 50_000
PLACE_BITS = 33


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``rank``, from 0, in this order; rows that tie are ranked as they happen to lie.

    Rows are dealt into ranges and sorted there; a row's place in its range is written with
    it, and the ranges' row counts give what goes before each.
    """
    n_ranges = blocks_for(df.count(), RANGE_ROWS)
    lying = df.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    held = written(lying.withColumn("_lies", F.monotonically_increasing_id()), name)
    held = held.withColumn("_range", F.shiftright("_lies", PLACE_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.groupBy("_range").agg(F.count("*").alias("_rows"))  # a row for each range: few
    offsets = ranges.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_lies") - F.shiftleft("_range", PLACE_BITS)
    return held.join(offsets, "_range").withColumn("rank", place + F.col("_offset")).drop("_lies", "_range", "_offset")
