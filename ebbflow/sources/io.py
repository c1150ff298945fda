"""Readers, sinks, profiles and the feature cache.

Sinks write to a new path and never overwrite the path being read; the
untouched source is the backup the reference kept by copying the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.schema import D, FLOW_CSV_SCHEMA, K, TARGETS

# Substrings that mark semantic-attribute columns.
SEMANTIC_MARKERS = (
    "fund_description",
    "fund_category",
    "fund_style",
    "risk_level",
    "investor_type",
    "trend_direction",
    "overall_risk",
    "embed_",
)


# ------------------------------------------------------------------------- S1
def load_flows_csv(spark: SparkSession, path: str, schema=FLOW_CSV_SCHEMA) -> DataFrame:
    """Flow CSV with a string key (leading zeros kept) and a yyyyMMdd date; columns go by name, in any order."""
    df = spark.read.option("header", True).csv(path)
    kinds = {f.name: f.dataType for f in schema.fields}
    df = df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])
    return df.withColumn(D, F.to_date(F.col(D), "yyyyMMdd"))


def load_flows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return load_flows_csv(spark, path)
    df = spark.read.format(fmt).load(path)
    if dict(df.dtypes).get(D) == "string":
        df = df.withColumn(D, F.to_date(F.col(D), "yyyyMMdd"))
    return df


# ------------------------------------------------------------------------- S2
def semantic_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(m in c for m in SEMANTIC_MARKERS)]


def has_semantic_columns(df: DataFrame) -> bool:
    return bool(semantic_columns(df))


# ------------------------------------------------------------------------- S3
def profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min(D).alias("min_date"),
        F.max(D).alias("max_date"),
        F.count_distinct(K).alias("n_funds"),
    )


# ------------------------------------------------------------------ S4 / S7
def with_text_date(df: DataFrame, date: str = D, name: str | None = None) -> DataFrame:
    return df.withColumn(name or date, F.date_format(F.col(date), "yyyyMMdd"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by=None) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_enriched(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The enriched table with the date back in yyyyMMdd text."""
    write_table(with_text_date(df), path, fmt)


# ------------------------------------------------------------------------- S5
class FeatureCache:
    """Per-key feature table in Parquet; only missing keys are computed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _existing(self) -> DataFrame | None:
        """The cached table; None only if its path does not exist. Any other failure surfaces."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.path) if found else None

    def missing_keys(self, keys: DataFrame, key: str = K) -> DataFrame:
        cached = self._existing()
        if cached is None:
            return keys.select(key).distinct()
        return keys.select(key).distinct().join(cached.select(key), key, "left_anti")

    def covers(self, keys: DataFrame, key: str = K) -> bool:
        """Cached keys are a superset of the requested keys."""
        return self._existing() is not None and self.missing_keys(keys, key).isEmpty()

    def get_or_compute(self, keys: DataFrame, compute, key: str = K) -> DataFrame:
        """Return features for ``keys``; compute and append only the missing ones."""
        missing = self.missing_keys(keys, key)
        if self._existing() is None or not missing.isEmpty():
            fresh = compute(missing).withColumn("generated_at", F.current_timestamp())
            fresh.write.mode("append").parquet(self.path)
        cached = self.spark.read.parquet(self.path)
        return cached.join(keys.select(key).distinct(), key, "left_semi")


# ------------------------------------------------------------------ S6 / S8
def submission(forecast: DataFrame, date_name: str = D) -> DataFrame:
    """S6 (``date_name='transaction_date'``) / S8 (``'date'``): the 4-column output."""
    return forecast.select(
        F.col(K),
        F.date_format(F.col(D), "yyyyMMdd").alias(date_name),
        F.col("apply_amt_pred").cast("double").alias("apply_amt_pred"),
        F.col("redeem_amt_pred").cast("double").alias("redeem_amt_pred"),
    )


def write_submission(forecast: DataFrame, path: str, date_name: str = D) -> None:
    """One folder of CSV parts, in the partitions that the forecast has."""
    write_table(submission(forecast, date_name), path, "csv")


# ------------------------------------------------------------------------- S9
def forecast_summary(forecast: DataFrame, targets=TARGETS, suffix: str = "_pred") -> DataFrame:
    aggs = [
        F.count_distinct(K).alias("n_funds"),
        F.count_distinct(D).alias("n_days"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    for t in targets:
        c = f"{t}{suffix}"
        aggs += [F.min(c).alias(f"{t}_min"), F.max(c).alias(f"{t}_max")]
    return forecast.agg(*aggs)


# ------------------------------------------------------------------------ S11
def head_rows(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(K, D).limit(n)


# ------------------------------------------------------------------------ S12
def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """Long form (column, nulls) for the given columns, in one aggregate."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in cols])
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])).alias("x")
    ).select("x.*")


def attribute_audit(df: DataFrame) -> DataFrame:
    """Per semantic column its null count; the column count is in every row."""
    cols = semantic_columns(df)
    return null_counts(df, cols).withColumn("n_semantic_columns", F.lit(len(cols)))


def attribute_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """Key, date and the semantic columns of the first ``n`` rows."""
    return df.select(K, D, *[c for c in semantic_columns(df) if c not in (K, D)]).orderBy(K, D).limit(n)
