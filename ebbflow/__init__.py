"""ebbflow — keyed daily flow analytics on Spark.

Every public operator takes one or more Spark ``DataFrame`` objects and
returns a ``DataFrame``; nothing is collected to the driver unless the
*shape* of a later plan depends on the data (feature selection, model fit).

Sub-packages
------------
sources    adapters from the raw tables, readers and sinks
operators  cleaning, calendar, window, market, interaction, technical,
           per-key statistics, attributes, selection, split, models,
           metrics, forecast and leakage checks
functions  column-expression helpers shared by the operators
plans      composed pipelines (train, predict) and the query catalogue
streaming  nothing yet: the workload is batch only (see its docstring)
"""

from ebbflow.schema import FlowConfig, K, D, TARGETS, UV_COLS  # noqa: F401

__all__ = ["FlowConfig", "K", "D", "TARGETS", "UV_COLS"]
