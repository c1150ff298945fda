"""Column helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.session import checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone; texts of ASCII alone take the fast way."""
    other = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(other)


def blocks_for(rows: int, per_block: int) -> int:
    """Blocks of about ``per_block`` rows: their number, not their size, grows."""
    return max(1, -(-rows // per_block))


def with_row_id(docs: DataFrame) -> DataFrame:
    """rid and row (all columns, packed so that no name can clash); rid is doc_id, or a hash of the text without one."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(whole_text()))
    return docs.select(own.alias("rid"), F.struct("*").alias("row"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")  # the table stands for the rows: what was shuffled for it can go
    try:
        df.write.mode("error").parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)
