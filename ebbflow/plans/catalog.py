"""Query catalogue: one Spark query per operator of the inventory.

Every query reads the driver tables at ``sf_dir`` through an adapter, so its
work grows with the tables.  Float outputs are rounded to ``R`` places in
both the Spark query and its DuckDB oracle (``oracle_sql.ORACLE``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.plans import oracle_sql as O
from ebbflow.session import cut_lineage
from ebbflow.sources import adapters as A

R = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            O.register(name, sql)
        return fn

    return deco


def rnd(c, places: int = R):
    """Round a float column for comparison; keeps the name of a string column."""
    name = c if isinstance(c, str) else None
    e = F.round(F.col(c) if isinstance(c, str) else c, places)
    return e.alias(name) if name else e


def round_floats(df: DataFrame, places: int = R) -> DataFrame:
    from pyspark.sql import types as T

    return df.select(
        *[
            (F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name))
            for f in df.schema.fields
        ]
    )


def flows(spark: SparkSession, sf: str, adapter: str = "lineitem") -> DataFrame:
    return A.ADAPTERS[adapter](spark, sf)


def written_flows(spark: SparkSession, sf: str, adapter: str = "lineitem") -> DataFrame:
    """The flow table for queries that read it several times: the raw tables are aggregated once."""
    return cut_lineage(flows(spark, sf, adapter))


def sql_round(expr: str, places: int = R) -> str:
    return f"round({expr}, {places})"


# Import the query modules so they register themselves.
from ebbflow.plans import q_attr, q_basic, q_features, q_forecast, q_leak, q_market, q_more, q_score, q_select, q_stats, q_tech, q_train  # noqa: E402,F401
